"""Which hashes occur more than once, at a few bytes per hash.

Tasks send the distinct hashes of a batch to hash ranges, packed: the high bits are the range, only
the next 32 bits travel. A range counts its hashes over all batches and answers every batch with the
counts, in the batch's own order. Hashes cut short can only make a count too large.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bytes of a table's estimated size for each hash range.
RANGE_BYTES = 8_000_000


# Planners name sizes they know nothing about with numbers beyond any table.
UNKNOWN_BYTES = 1 << 60


def bits_for(size: int) -> int:
    """Bits of a hash that name its range: one range for every ``RANGE_BYTES``, 16 at least."""
    return max(4, (-(-size // RANGE_BYTES) - 1).bit_length())


def range_bits(df: DataFrame) -> int:
    """Bits for ``df`` (with ``text``): from the planner's estimate, or the bytes of its texts if it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= UNKNOWN_BYTES:
        size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return bits_for(size)


def ranges_of(sorted_hashes: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(range, start, end) of each range met in an ascending array of hashes (their top ``bits`` bits)."""
    tops = (sorted_hashes >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(tops, prepend=-1, append=-1)) if len(tops) else np.zeros(1, np.int64)
    starts = cuts[:-1]
    return zip(tops[starts].tolist(), starts.tolist(), cuts[1:].tolist())


def tails(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The 32 bits below the range."""
    return ((hashes << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)


def totals(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Sum counts per hash tail over all parts; the answer has each part's own order."""
    keys = np.concatenate([k for k, _ in parts])
    counts = np.concatenate([c for _, c in parts]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    start = np.ones(len(ordered), bool)
    start[1:] = ordered[1:] != ordered[:-1]
    group = np.cumsum(start) - 1
    sums = np.bincount(group, weights=counts[order]).astype(np.int64)
    out = np.empty(len(keys), np.int64)
    out[order] = sums[group]
    return np.split(out, np.cumsum([len(k) for k, _ in parts])[:-1])


def pack(array: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(array).tobytes(), 1)


def unpack(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), kind)


def distinct_counts(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes ascending, how often each occurs, and for each input its place among them."""
    return np.unique(hashes, return_inverse=True, return_counts=True)  # type: ignore[return-value]


def requests(batch: int, distinct: np.ndarray, counts: np.ndarray, bits: int) -> Iterator[dict]:
    """Rows for the ranges; counts above 255 travel as 255, which only the order of hashes sees."""
    tail, small = tails(distinct, bits), np.minimum(counts, 255).astype(np.uint8)
    for r, a, b in ranges_of(distinct, bits):
        yield {"range": r, "batch": batch, "tails": tail[a:b].tobytes(), "counts": pack(small[a:b])}
