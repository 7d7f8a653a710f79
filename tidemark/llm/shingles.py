"""Hashed sets of word shingles, computed for many documents at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

WIDTH = 5
_ODD = np.random.default_rng(5).integers(1 << 62, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``texts`` (A-Z lower-cased, cut at ASCII white space) and text offsets."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    bounds = split.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    words = split.flatten().dictionary_encode()
    names = np.array(words.dictionary.to_pylist(), dtype=object)
    numbers = pd.util.hash_array(names, categorize=False) if len(names) else np.zeros(0, np.uint64)
    index = words.indices.to_numpy()
    filled = (pc.binary_length(words.dictionary).to_numpy(zero_copy_only=False) > 0)[index] if len(names) else np.zeros(0, bool)
    kept = np.concatenate([[0], np.cumsum(filled)])  # white space at the ends leaves empty words
    return numbers[index][filled], kept[bounds]


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, one after the other, and their offsets.

    A text of fewer words than ``width`` is one shingle, one without words has none.
    """
    words, bounds = word_hashes(texts)
    counts = np.diff(bounds)
    doc = np.repeat(np.arange(len(counts)), counts)
    total = len(words)
    whole = max(0, total - width + 1)
    rolled = np.zeros(whole, np.uint64)
    for k in range(width if whole else 0):
        rolled += words[k : k + whole] * _ODD[k]
    inside = doc[:whole] == doc[width - 1 : width - 1 + whole] if whole else np.zeros(0, bool)
    hashes, owner = mixed(rolled[inside]), doc[:whole][inside]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = [mixed((words[bounds[d] : bounds[d + 1]] * _ODD[: counts[d]]).sum(keepdims=True) + _ODD[width + counts[d]])[0] for d in short]
        hashes = np.concatenate([hashes, np.array(extra, np.uint64)])
        owner = np.concatenate([owner, short])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[new], owner[new]
    return hashes, np.searchsorted(owner, np.arange(len(counts) + 1))
