"""Remove repeated byte strings: a radix sort of all suffixes, no deeper than the threshold.

A suffix matters only through its first ``LENGTH`` bytes, its window. The windows of all documents are
partitioned by most-significant-digit passes, and windows alone in their group drop out after each:

1. The first digit is read at a spot that the window's content chooses (its smallest 16-byte hash), so
   that neighbouring windows share one digit, and equal windows have it at the same place. It is the
   33 or 34 bytes beside that spot. Runs of windows with one digit are the units of the pass.
2. The second digit is the whole text under a unit. Units that agree in both digits agree in all their
   windows; a digit-1 group with one digit 2 only is decided by its smallest document.
3. Where units of a group differ, their windows go on one by one, down to all ``LENGTH`` bytes. Groups
   that are equal at this depth are exactly the repeated windows.

A pass sends hashes of digits to hash ranges, one per batch and digit with the batch's smallest
document, and gets back the smallest document of the corpus: a passage that a third of all documents
share is one entry per batch. Texts are never sent in passes, only joined with the answers.

Defined results: a null text is empty; texts shorter than a window lose nothing; rows with equal
``doc_id`` do not see each other; a null ``doc_id`` counts as larger than all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, release
from tidemark.llm.exchange import pack, range_bits, ranges_of, tails, totals, unpack
from tidemark.llm.shingles import mixed

LENGTH = 50
GRAM = 16
BLOCK_BYTES = 3_000_000
NULL_KEY = (1 << 63) - 1
# Requests of a hash range that are sorted at a time.
SORTED_KEYS = 500_000

_RANDOM = np.random.default_rng(50)
_BYTE = _RANDOM.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_BASE = [int(b) * 8 + 5 for b in _RANDOM.integers(1 << 50, 1 << 60, 2)]
_INVERSE = [pow(b, -1, 1 << 64) for b in _BASE]


@lru_cache(maxsize=4)
def _powers(which: int, inverse: bool, size: int) -> np.ndarray:
    base = (_INVERSE if inverse else _BASE)[which] % (1 << 64)
    steps = np.full(size, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


class Digests:
    """Hashes of any stretch of a text from running sums of its bytes."""

    def __init__(self, data: np.ndarray, which: int):
        size = 1 << max(16, int(len(data)).bit_length())
        self.inverse = _powers(which, True, size)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[which][data] * _powers(which, False, size)[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray, salt: int = 0) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.inverse[start] + np.uint64(salt) + (stop - start).astype(np.uint64))

    def grams(self, width: int) -> np.ndarray:
        """Hash of every stretch of ``width`` bytes."""
        n = len(self.sums) - width
        return mixed((self.sums[width:] - self.sums[:n]) * self.inverse[:n])


class Units(NamedTuple):
    """Runs of windows that read their first digit at the same place; ``low..high`` are their starts."""

    doc: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray  # hash of the first digit


def units_of(data: np.ndarray, bounds: np.ndarray, digests: Digests, length: int = LENGTH) -> Units:
    """Units of the documents that lie one after the other in ``data``."""
    span = length - GRAM + 1  # grams of a window
    none = np.zeros(0, np.int64)
    windows = len(data) - length + 1
    if windows <= 0:
        return Units(none, none, none, none.astype(np.uint64))
    place = np.arange(len(data) - GRAM + 1, dtype=np.uint64)
    least = (digests.grams(GRAM) & np.uint64(0xFFFFFFFF00000000)) | place
    width = 1
    while width * 2 <= span:  # smallest hash, then leftmost, of ever longer stretches
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: windows], least[span - width : span - width + windows])
    spot = (least[:windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts, stops = bounds[:-1], bounds[1:] - length + 1  # window starts of each document
    real = np.zeros(windows + 1, np.int32)
    ok = stops > starts
    np.add.at(real, starts[ok], 1)
    np.add.at(real, stops[ok], -1)
    valid = np.cumsum(real[:-1]) > 0
    new = np.ones(windows, bool)
    new[1:] = spot[1:] != spot[:-1]
    new[starts[ok]] = True
    low = np.flatnonzero(new & valid)
    change = np.flatnonzero(new | ~valid)
    after = np.searchsorted(change, low, side="right")
    high = np.where(after < len(change), change[np.minimum(after, len(change) - 1)], windows) - 1
    at = spot[low]
    # Windows with the spot in their right half have half of the rest on its left, the others on its
    # right; either stretch lies inside all windows of its half.
    half = (length - GRAM) // 2
    rest = length - GRAM - (half - 1)
    left = low <= at - half
    right = high > at - half
    lows = np.concatenate([low[left], np.maximum(low, at - half + 1)[right]])
    highs = np.concatenate([np.minimum(high, at - half)[left], high[right]])
    first = np.concatenate([
        digests.of(at[left] - half, at[left] + GRAM, 1), digests.of(at[right], at[right] + GRAM + rest, 2)
    ])
    doc = np.searchsorted(bounds, lows, side="right") - 1
    return Units(doc, lows, highs, first)


# --- blocks and passes ---------------------------------------------------------------------------

BLOCKS = "batch long, ids binary, nulls binary, bounds binary, data binary"


def blocks_of(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, text) gathered into blocks, whole and in any order."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = pa.schema([("batch", pa.int64())] + [(n, pa.binary()) for n in ("ids", "nulls", "bounds", "data")])

    def gather(records: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for record in records:
            ids = record.column("doc_id")
            texts = record.column("text").cast(pa.large_binary())
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            start = 0
            while start < len(texts):
                done = int(ends[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, done + BLOCK_BYTES, side="right")))
                part = ids.slice(start, stop - start)
                bounds = np.concatenate([[0], ends[start:stop] - done]).astype(np.int64)
                yield pa.RecordBatch.from_pylist([{
                    "batch": number, "ids": pc.fill_null(part, NULL_KEY).to_numpy(zero_copy_only=False).tobytes(),
                    "nulls": part.is_null().to_numpy(zero_copy_only=False).tobytes(), "bounds": bounds.tobytes(),
                    "data": b"".join(texts.slice(start, stop - start).to_pylist()),
                }], schema=schema)
                number, start = number + 1, stop

    return source.mapInArrow(gather, BLOCKS)


class Block:
    """A block with what the passes before have found out about its units."""

    def __init__(self, row, answers: pd.DataFrame, length: int):
        self.length = length
        self.batch = int(row.batch)
        self.ids = np.frombuffer(row.ids, np.int64)
        self.bounds = np.frombuffer(row.bounds, np.int64)
        self.data = np.frombuffer(row.data, np.uint8)
        self.answers = answers
        self.digests = Digests(self.data, 0)
        self.units = units_of(self.data, self.bounds, self.digests, length)

    def _answer(self, step: int, column: str, kind) -> np.ndarray:
        parts = self.answers[self.answers["step"] == step].sort_values("range")[column]
        return np.concatenate([unpack(p, kind) for p in parts]) if len(parts) else np.zeros(0, kind)

    def first_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct first digits, the place of each unit's among them, documents that hold each."""
        keys, place = np.unique(self.units.first, return_inverse=True)
        order = np.lexsort((self.units.doc, place))
        p, d = place[order], self.units.doc[order]
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1]) | (d[1:] != d[:-1])
        return keys, place, np.bincount(p[new], minlength=len(keys))

    def repeated(self) -> Units:
        """Units whose first digit another document has as well."""
        keys, place, _ = self.first_keys()
        again = self._answer(1, "result", np.uint8).astype(bool)
        return Units(*(a[again[place]] for a in self.units)) if len(keys) else self.units

    def second_keys(self, units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (first, second) digits, each unit's place among them, smallest document of each."""
        second = self.digests.of(units.low, units.high + self.length, 3)
        return distinct_pairs(units.first, second, self.ids[units.doc])

    def decided(self) -> tuple[Units, np.ndarray, np.ndarray]:
        """Repeated units; whether a smaller document has all of the unit; whether its group differs."""
        units = self.repeated()
        first, _, place, _ = self.second_keys(units)
        smallest = self._answer(2, "result", np.int64)
        differs = self._answer(2, "differs", np.uint8).astype(bool)
        if not len(first):
            return units, np.zeros(0, bool), np.zeros(0, bool)
        return units, smallest[place] < self.ids[units.doc], differs[place]

    def open_windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and documents of the windows that the second digit left open."""
        units, covered, differs = self.decided()
        left = differs & ~covered
        counts = (units.high - units.low + 1)[left]
        starts = np.repeat(units.low[left] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        return starts, np.repeat(units.doc[left], counts)

    def window_keys(self, starts: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        one = self.digests.of(starts, starts + self.length, 4)
        two = Digests(self.data, 1).of(starts, starts + self.length, 5)
        return distinct_pairs(one, two, self.ids[doc])

    def removed(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of all maximal stretches that repeat a smaller document."""
        units, covered, _ = self.decided()
        starts, doc = self.open_windows()
        if len(starts):
            _, _, place, _ = self.window_keys(starts, doc)
            starts = starts[self._answer(3, "result", np.int64)[place] < self.ids[doc]]
        change = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(change, units.low[covered], 1)
        np.add.at(change, units.high[covered] + self.length, -1)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + self.length, -1)
        # A stretch ends with its document, even where the next one begins with another.
        gone = np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])
        edge = np.zeros(len(gone), bool)
        edge[self.bounds[:-1] + 1] = True
        begin = np.flatnonzero(gone[1:-1] & (~gone[:-2] | edge[1:-1]))
        end = np.flatnonzero(gone[1:-1] & (~gone[2:] | edge[2:])) + 1
        return begin, end


def distinct_pairs(one: np.ndarray, two: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (one, two) ascending, each input's place among them, the smallest id of each."""
    order = np.lexsort((ids, two, one))
    a, b = one[order], two[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    place = np.empty(len(a), np.int64)
    place[order] = np.cumsum(new) - 1
    return a[new], b[new], place, ids[order][new]


ASKED = "range int, batch long, tails binary, second binary, ids binary"
ANSWERED = "step int, batch long, range int, result binary, differs binary"


def first_requests(block: Block, bits: int) -> Iterator[dict]:
    keys, _, documents = block.first_keys()
    tail = tails(keys, bits)
    several = np.minimum(documents, 2).astype(np.uint8)
    for r, a, b in ranges_of(keys, bits):
        yield {"range": r, "batch": block.batch, "tails": tail[a:b].tobytes(), "second": pack(several[a:b]), "ids": None}


def pair_requests(block: Block, one: np.ndarray, two: np.ndarray, ids: np.ndarray, bits: int) -> Iterator[dict]:
    tail = tails(one, bits)
    for r, a, b in ranges_of(one, bits):
        yield {"range": r, "batch": block.batch, "tails": tail[a:b].tobytes(), "second": two[a:b].tobytes(), "ids": pack(ids[a:b])}


def answer_first(part: pd.DataFrame) -> pd.DataFrame:
    sums = totals([(np.frombuffer(t, np.uint32), unpack(c, np.uint8)) for t, c in zip(part["tails"], part["second"])])
    return pd.DataFrame({
        "step": 1, "batch": part["batch"], "range": part["range"], "result": [pack((s > 1).astype(np.uint8)) for s in sums], "differs": None,
    })


def answer_pairs(step: int):
    """Smallest document of each (first, second) digit, and whether a first digit has several second ones.

    Requests are ascending by first digit, so a range is answered in slices of that digit: besides the requests and
    their answers only one slice is in memory, however many windows of a range are open.
    """

    def answer(part: pd.DataFrame) -> pd.DataFrame:
        one = [np.frombuffer(t, np.uint32) for t in part["tails"]]
        two = [np.frombuffer(t, np.uint64) for t in part["second"]]
        smallest = [unpack(i, np.int64).copy() for i in part["ids"]]  # ids, until they are answered
        differs = [np.empty(len(t), np.uint8) for t in one]
        slices = max(1, -(-sum(map(len, one)) // SORTED_KEYS))
        edges = np.arange(1, slices, dtype=np.uint64) * np.uint64(2**32) // np.uint64(slices)
        borders = [[0, *np.searchsorted(t, edges).tolist(), len(t)] for t in one]
        for k in range(slices):
            spans = [slice(b[k], b[k + 1]) for b in borders]
            keys = np.concatenate([t[s] for t, s in zip(one, spans)])
            if not len(keys):
                continue
            second = np.concatenate([t[s] for t, s in zip(two, spans)])
            order = np.lexsort((second, keys))
            sorted_keys, second = keys[order], second[order]
            new_key = np.ones(len(keys), bool)
            new_key[1:] = sorted_keys[1:] != sorted_keys[:-1]
            new_pair = new_key.copy()
            new_pair[1:] |= second[1:] != second[:-1]
            pair, key = np.cumsum(new_pair) - 1, np.cumsum(new_key) - 1
            ids = np.concatenate([i[s] for i, s in zip(smallest, spans)])
            found, varied = np.empty_like(ids), np.empty(len(ids), np.uint8)
            found[order] = np.minimum.reduceat(ids[order], np.flatnonzero(new_pair))[pair]
            varied[order] = (np.bincount(key[new_pair]) > 1)[key]
            start = 0
            for i, d, s in zip(smallest, differs, spans):
                stop = start + s.stop - s.start
                i[s], d[s], start = found[start:stop], varied[start:stop], stop
        out = pd.DataFrame({
            "step": step, "batch": part["batch"], "range": part["range"],
            "result": [pack(x) for x in smallest], "differs": [pack(x) for x in differs],
        })
        del one, two, smallest, differs
        if slices > 1:
            release()
        return out

    return answer


RESULT = "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary"


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): removed byte stretches and the remaining bytes per document.

    ``length`` is at least 34 bytes (a window must hold a spot and what is read beside it).
    """
    if length < 2 * GRAM + 2:
        raise ValueError("windows must have at least 34 bytes")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    bits = range_bits(docs)
    blocks = scratch.write(blocks_of(docs), "blocks")

    def with_answers(answers: DataFrame, make, schema: str) -> DataFrame:
        def run(part: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
            try:
                return make(Block(part.iloc[0], found, length)) if len(part) else make(None)
            finally:
                release()

        return blocks.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(run, schema)

    columns = ["range", "batch", "tails", "second", "ids"]

    def ask_first(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nothing = pd.DataFrame(columns=["step", "range", "result", "differs"])
        for part in parts:
            for row in part.itertuples():
                yield pd.DataFrame(list(first_requests(Block(row, nothing, length), bits)), columns=columns)

    def ask_second(block: Block | None) -> pd.DataFrame:
        rows = []
        if block is not None:
            one, two, _, ids = block.second_keys(block.repeated())
            rows = list(pair_requests(block, one, two, ids, bits))
        return pd.DataFrame(rows, columns=columns)

    def ask_windows(block: Block | None) -> pd.DataFrame:
        rows = []
        if block is not None:
            one, two, _, ids = block.window_keys(*block.open_windows())
            rows = list(pair_requests(block, one, two, ids, bits))
        return pd.DataFrame(rows, columns=columns)

    def finish(block: Block | None) -> pd.DataFrame:
        out = []
        if block is not None:
            begin, end = block.removed()
            owner = np.searchsorted(block.bounds, begin, side="right") - 1
            first = np.searchsorted(owner, np.arange(len(block.ids) + 1))
            for d, (key, a, b) in enumerate(zip(block.ids.tolist(), block.bounds[:-1].tolist(), block.bounds[1:].tolist())):
                spans = list(zip(begin[first[d] : first[d + 1]].tolist(), end[first[d] : first[d + 1]].tolist()))
                cuts = [a, *(x for s in spans for x in s), b]
                kept = b"".join(block.data[x:y].tobytes() for x, y in zip(cuts[::2], cuts[1::2]))
                out.append((key, b - a, [{"start": x - a, "stop": y - a} for x, y in spans], kept))
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "spans", "kept"])

    asked = blocks.mapInPandas(ask_first, ASKED)
    answers = scratch.write(asked.groupBy("range").applyInPandas(answer_first, ANSWERED), "pass-1")
    for step, ask in ((2, ask_second), (3, ask_windows)):
        asked = with_answers(answers, ask, ASKED)
        more = scratch.write(asked.groupBy("range").applyInPandas(answer_pairs(step), ANSWERED), f"pass-{step}")
        answers = answers.union(more)
    rows = with_answers(answers, finish, RESULT)
    return rows.withColumn("doc_id", F.when(F.col("doc_id") != NULL_KEY, F.col("doc_id")))
