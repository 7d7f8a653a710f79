"""Find benchmark passages in documents, with a few edits, by counting shared q-grams.

A match is a whole short item, or a part of a longer one that has one of the lengths ``PARTS`` and
starts anywhere. Within ``e`` edits, a part of ``m`` characters keeps at least ``m - q + 1 - q * e`` of
its q-grams, and their diagonals (place in the text minus place in the item) differ by at most ``e``.
Parts that start within ``STEP`` characters share one segment, which reaches to the end of the last of
them. Shared q-grams are counted in overlapping bands of diagonals of each segment; in bands that reach
the bound they are counted for every part, and the parts that reach it are aligned within the band.

Texts and items are compared as lower-cased letters and digits, anything else being one space.

Defined results: null or empty texts match nothing; items are compared as a set of distinct texts,
each named by its smallest id (null ids last); items of fewer than ``LEAST`` characters say nothing
about a document and are left out; rows with equal ``doc_id`` are searched separately.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ship
from tidemark.llm.shingles import mixed

Q = 12
SEGMENT, STEP = 100, 50
# Lengths of the parts of longer items: a part of 100 characters may hold 6 edits anywhere, and one of
# 60, about ten words, may hold 3.
PARTS = (SEGMENT, 60)
PERCENT = 6  # edits allowed for a hundred characters
LEAST = 2 * Q
# Items are searched in blocks of at most so many characters, which bounds what a task holds.
BLOCK_CHARACTERS = 2_000_000
TEXT_SLICE = 1_500_000
FILTER_BITS = 22
CANDIDATES = 4_096  # aligned together

_BASE = 0x9E3779B97F4A7C15 | 5


@lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """For each code point its lower-case form, or a space where it is no letter or digit."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        one = chr(c)
        if one.isalnum():
            low = one.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def normalized(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points that are compared, and where each comes from in the text."""
    codes = _fold()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = codes != 32
    if len(codes):
        keep[1:] |= codes[:-1] != 32
    place = np.flatnonzero(keep)
    return codes[place], place


@lru_cache(maxsize=2)
def _powers(size: int, inverse: bool) -> np.ndarray:
    step = pow(_BASE, -1, 1 << 64) if inverse else _BASE
    out = np.full(size, step, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of every q-gram."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    size = 1 << max(16, len(codes).bit_length())
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(codes.astype(np.uint64)) * _powers(size, False)[: len(codes)])])
    return mixed((sums[Q:] - sums[:-Q]) * _powers(size, True)[:n])


def budget(m: int) -> int:
    """Edits allowed for a segment: the percentage, as far as the q-gram bound stays positive."""
    return max(0, min(m * PERCENT // 100, (m - Q) // Q))


class Searcher:
    """A block of benchmark items, ready to be searched for."""

    def __init__(self, items: list[tuple[int | None, str]]):
        self.items = items

    def __getstate__(self):
        return {"items": self.items}

    @cached_property
    def segments(self) -> list[tuple[int, int, np.ndarray]]:
        """(item, length of its parts, codes): whole short items, and places where parts of longer ones start.

        A segment of ``c`` codes holds the parts that start at its first ``c - length + 1`` places.
        """
        out, seen = [], set()
        for i, (_, text) in enumerate(self.items):
            codes, _ = normalized(text.strip())
            if len(codes) and codes[-1] == 32:
                codes = codes[:-1]
            if len(codes) and codes[0] == 32:
                codes = codes[1:]
            if len(codes) < LEAST or codes.tobytes() in seen:
                continue
            seen.add(codes.tobytes())
            for length in sorted({min(n, len(codes)) for n in PARTS}):
                last = len(codes) - length
                starts = sorted({*range(0, last, STEP), last})
                out += [(i, length, codes[s : max(s + 1, e) + length - 1]) for s, e in zip(starts, [*starts[1:], last + 1])]
        return out

    @cached_property
    def index(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted gram hashes with the bounds, segments and places of their occurrences; a filter."""
        grams = [gram_hashes(c) for _, _, c in self.segments]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        segment = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        keys, first = np.unique(flat[order], return_index=True)
        maybe = np.zeros(1 << FILTER_BITS, bool)
        maybe[(keys & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
        return keys, np.append(first, len(flat)), segment[order], place[order], maybe

    @cached_property
    def limits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Length, edit budget and least number of shared q-grams of the parts of each segment."""
        m = np.array([n for _, n, _ in self.segments], np.int64)
        e = np.array([budget(n) for n in m.tolist()], np.int64)
        return m, e, m - Q + 1 - Q * e

    @cached_property
    def starts(self) -> np.ndarray:
        """Number of parts of each segment."""
        return np.array([len(c) - n + 1 for _, n, c in self.segments], np.int64)

    def hits(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the text, segment, place in the segment) of all shared q-grams."""
        keys, first, segment, place, maybe = self.index
        hashes = gram_hashes(codes)
        at = np.flatnonzero(maybe[(hashes & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)])
        where = np.searchsorted(keys, hashes[at])
        same = keys[np.minimum(where, len(keys) - 1)] == hashes[at]
        at, where = at[same], where[same]
        counts = first[where + 1] - first[where]
        pick = np.repeat(first[where] - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))
        return np.repeat(at, counts), segment[pick], place[pick]

    def candidates(
        self, at: np.ndarray, segment: np.ndarray, place: np.ndarray
    ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(segment, first diagonal, shared q-grams of each of its parts) of the bands that hold enough.

        Bands are ``2 (e + 1)`` wide and start every ``e + 1``, so diagonals that differ by at most
        ``e`` always lie in one band together.
        """
        lengths, edits, least = self.limits
        half = edits[segment] + 1
        low = (at - place) // half
        band = np.concatenate([low, low - 1])
        both, spot, inner = (np.concatenate([x, x]) for x in (segment, at, place))
        order = np.lexsort((spot, band, both))
        s, b, p, inner = both[order], band[order], spot[order], inner[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (b[1:] != b[:-1])
        fresh = new.copy()
        fresh[1:] |= p[1:] != p[:-1]  # a text position counts once
        group = np.cumsum(new) - 1
        counts = np.bincount(group[fresh], minlength=int(group[-1]) + 1 if len(group) else 0)
        head = np.flatnonzero(new)
        found = np.flatnonzero(counts >= least[s[head]])
        ends = np.append(head[1:], len(s))
        for a in range(0, len(found), CANDIDATES):
            some = found[a : a + CANDIDATES]
            sizes = ends[some] - head[some]
            rows = np.repeat(np.arange(len(some)), sizes)
            pick = np.repeat(head[some] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
            here = s[head[some]]
            shared = np.zeros((len(some), SEGMENT + STEP), np.int64)
            shared[rows, inner[pick] + 1] = 1  # a place of the segment counts once
            shared = shared.cumsum(axis=1)
            starts = np.arange(STEP)[None, :]
            stops = np.minimum(starts + lengths[here][:, None] - Q + 1, shared.shape[1] - 1)
            parts = np.take_along_axis(shared, stops, axis=1) - shared[:, :STEP]
            parts[starts >= self.starts[here][:, None]] = -1
            yield here, b[head[some]] * (edits[here] + 1), parts

    def best_parts(
        self, codes: np.ndarray, segment: np.ndarray, diagonal: np.ndarray, shared: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Fewest edits of the parts of each candidate, and the text position where the first such part ends.

        The part that shares most is aligned first; of the others only those that may have fewer edits,
        as each edit costs at most ``Q`` shared q-grams.
        """
        m, e, least = self.limits
        bound = np.where(shared >= least[segment][:, None], -(-(m[segment][:, None] - Q + 1 - shared) // Q), 1 << 20)
        top = shared.argmax(axis=1)
        edits, end = np.full(len(segment), 1 << 20), np.zeros(len(segment), np.int64)
        row, first = np.arange(len(segment)), top
        possible = bound[row, top] <= e[segment]
        row, first = row[possible], first[possible]
        for _ in range(2):
            for a in range(0, len(row), CANDIDATES):
                r, f = row[a : a + CANDIDATES], first[a : a + CANDIDATES]
                cost, stop = self.aligned(codes, segment[r], diagonal[r], f)
                order = np.lexsort((f, cost, r))
                lead = order[np.concatenate([[True], r[order][1:] != r[order][:-1]])]
                lead = lead[cost[lead] < edits[r[lead]]]
                edits[r[lead]], end[r[lead]] = cost[lead], stop[lead]
            better = bound < np.minimum(edits, e[segment] + 1)[:, None]
            better[np.arange(len(segment)), top] = False
            row, first = np.nonzero(better)
        return edits, end

    def aligned(
        self, codes: np.ndarray, segment: np.ndarray, diagonal: np.ndarray, first: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Fewest edits of each part, which starts at ``first``, within its band, and the text position where it ends.

        All candidates advance together, one item character at a time; cell d of a row is the
        text position ``row + diagonal + first - e + d``.
        """
        m, e, _ = self.limits
        most = int(e[segment].max())
        width = 4 * (most + 1)
        rows = int(m[segment].max())
        pattern = np.full((len(segment), rows), 1 << 24, np.int64)
        for k, (s, a) in enumerate(zip(segment.tolist(), first.tolist())):
            pattern[k, : m[s]] = self.segments[s][2][a : a + m[s]]
        shift = diagonal + first - most
        steps = np.arange(width)
        text = np.concatenate([codes.astype(np.int64), [-1]])
        cost = np.zeros((len(segment), width), np.int64)  # a match may start anywhere in the band
        cost[(shift[:, None] + steps) < 0] = 1 << 20
        edits, end = np.full(len(segment), 1 << 20), np.zeros(len(segment), np.int64)
        for row in range(rows):
            at = shift[:, None] + row + steps  # the character a diagonal step consumes
            inside = (at >= 0) & (at < len(codes))
            letter = text[np.where(inside, at, len(codes))]
            through = cost + (letter != pattern[:, row : row + 1])
            through[~inside] = 1 << 20
            drop = np.full_like(cost, 1 << 20)
            drop[:, :-1] = cost[:, 1:] + 1  # an item character without partner
            cost = np.minimum(through, drop)
            cost = np.minimum.accumulate(cost - steps, axis=1) + steps  # text characters without partner
            done = np.flatnonzero(m[segment] == row + 1)
            if len(done):
                best = cost[done].argmin(axis=1)
                edits[done] = cost[done, best]
                end[done] = shift[done] + row + 1 + best
        return edits, np.clip(end, 0, len(codes))

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) of the matches, the best part of each segment, in code points of ``text``."""
        if not self.segments:
            return []
        codes, origin = normalized(text)
        at, segment, place = self.hits(codes)
        if len(at) < int(self.limits[2].min()):
            return []
        m, e, _ = self.limits
        out = {}
        for seg, dia, shared in self.candidates(at, segment, place):
            edits, end = self.best_parts(codes, seg, dia, shared)
            for k in np.flatnonzero(edits <= e[seg]):
                s, stop = int(seg[k]), int(end[k])
                start = max(0, min(stop - int(m[s]), len(codes) - 1))
                key = (s, stop // SEGMENT)
                row = (self.segments[s][0], int(origin[start]), int(origin[stop - 1]) + 1, int(edits[k]))
                if key not in out or row[3] < out[key][3]:
                    out[key] = row
        return sorted(set(out.values()))


def item_blocks(items: DataFrame) -> Iterator[Searcher]:
    """Distinct items (item_id, text) in blocks of bounded size, one after the other."""
    distinct = items.filter(F.col("text").isNotNull()).groupBy("text").agg(F.min("item_id").alias("item_id"))
    total = distinct.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * total // BLOCK_CHARACTERS))
    keyed = distinct.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)))
    for b in range(blocks):
        rows = keyed.filter(F.col("block") == b).orderBy("item_id", "text").collect()
        yield Searcher([(r["item_id"], r["text"]) for r in rows])


MATCHES = "array<struct<item_id:long,start:long,stop:long,edits:int>>"


def matches(searcher: Searcher) -> Column:
    """The matches of column ``text``, each item's best first."""

    @F.pandas_udf(MATCHES)
    def found(texts: pd.Series) -> pd.Series:
        names = [i for i, _ in searcher.items]
        return pd.Series([
            [dict(item_id=names[i], start=a, stop=b, edits=e) for i, a, b, e in searcher.search(text)] for text in texts
        ], dtype=object)

    # Evaluated once per row: a filter on the result must not run it again.
    return found.asNondeterministic()(F.coalesce(F.col("text").cast("string"), F.lit("")))


def benchmark_matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, stop, edits): every benchmark passage in every document."""
    ship(docs.sparkSession)
    parts = [
        docs.select("doc_id", F.explode(matches(s)).alias("m")).select("doc_id", "m.*") for s in item_blocks(items)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def without_benchmark(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, with their columns as they are."""
    ship(docs.sparkSession)
    mark = "benchmark_matches"
    while mark in {c.lower() for c in docs.columns}:
        mark += "_"
    for searcher in item_blocks(items):
        docs = docs.withColumn(mark, matches(searcher)).filter(F.size(mark) == 0).drop(mark)
    return docs
