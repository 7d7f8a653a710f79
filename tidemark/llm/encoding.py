"""Encode texts with a published tokenizer, one distinct word at a time.

White space never ends up inside a token of the tokenizers this is meant for (their pre-tokenizer
drops it), so the ids of a text are the ids of its words in order. Words repeat far more often than
texts, hence each worker encodes a word once and keeps its ids.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Words kept by a worker; beyond that it starts afresh. Only speed depends on it.
KEPT_WORDS = 800_000
# Words encoded in one call, and bytes of text whose ids are held at once.
CALL_WORDS, ENCODE_BYTES = 300, 4_000_000
# Bytes of text handed on at once by ``text_slices``, unless its caller wants less.
SLICE_BYTES = 8_000_000
# Stands between the words of a call. Words that hold it are encoded one by one.
MARK = "|"

_ENCODERS: dict[str, "WordEncoder"] = {}


class WordEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        mark = self._ids(MARK)
        self.mark = mark[0] if len(mark) == 1 and self._ids(f"a {MARK} b") == [*self._ids("a"), *mark, *self._ids("b")] else None
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.offsets, self.ids = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _call(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of ``words`` one after the other, and how many each has; one call for all where marks tell them apart."""
        if self.mark is not None:
            ids = np.array(self._ids(f" {MARK} ".join(words)), np.uint32)
            marks = np.flatnonzero(ids == self.mark)
            if len(marks) == len(words) - 1:
                return np.delete(ids, marks), np.diff(marks, prepend=-1, append=len(ids)) - 1
        each = [self._ids(w) for w in words]
        return np.array([i for ids in each for i in ids], np.uint32), np.array([len(ids) for ids in each], np.int64)

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Row of each word in the kept table, adding the new ones."""
        if len(self.known) > KEPT_WORDS:
            self._reset()
        new = [w for w in words if w not in self.known]
        if new:
            marked = [w for w in new if MARK in w]
            if marked:
                new = [w for w in new if MARK not in w]
            calls = [new[a : a + CALL_WORDS] for a in range(0, len(new), CALL_WORDS)] + [[w] for w in marked]
            flat, counts = (np.concatenate(x) for x in zip(*map(self._call, calls)))
            new += marked
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.offsets = np.concatenate([self.offsets, len(self.ids) + np.cumsum(counts)])
            self.ids = np.concatenate([self.ids, flat])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of ``texts`` (no nulls) and the offsets of each text in them."""
        split = pc.ascii_split_whitespace(texts)
        bounds = split.offsets.to_numpy().astype(np.int64)
        words = split.flatten().dictionary_encode()
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        rows = self._numbers(words.dictionary.to_pylist())
        # The ids of the distinct words here, then those of all words in order.
        own = pa.LargeListArray.from_arrays(self.offsets, self.ids).take(pa.array(rows))
        ids = own.take(words.indices)
        ends = ids.offsets.to_numpy()
        return ids.values.to_numpy()[ends[0] : ends[-1]], (ends - ends[0])[bounds - bounds[0]]


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def text_slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive parts of a text column, about ``size`` bytes each; nulls become empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + size, side="right")))
        yield start, texts.slice(start, stop - start)
        start = stop
