"""Word vectors by random indexing: sums of the random vectors of the words around a word.

Every context word has a fixed vector of signs, derived from its hash. The vector of a word is the
sum of its contexts' sign vectors, weighted by how often they stand near it, scaled to length 1. This
is a random projection of the table of co-occurrences, which never exists in full: (word, context)
pairs are counted by slices of texts, meet in ranges of words and are summed there, and nothing but the
hashes of frequent words is held by the driver. The vectors depend on the texts alone, not on the machine, the
partitions or the number of documents seen at a time.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import spread, written, written_parts

# Tokens whose pairs a task counts at a time; pairs of a range, each counted as often as it stands in the texts.
SLICE_TOKENS, RANGE_PAIRS = 600_000, 3_000_000
# Pairs of a round, counted so; rounds at most: each reads the tokens again, and only its pairs lie on disk.
ROUND_PAIRS, MOST_ROUNDS = 300_000_000, 8
# A word with more than this part of all tokens is frequent: there are fewer of them.
FREQUENT = 1000


def context_pairs(docs: DataFrame, window: int, by: Sequence[str] = ()) -> DataFrame:
    """(by, word, context, cnt): how often two words stand at most ``window`` places apart.

    Pairs are listed inside the row and counted before they are shuffled; a text of any length is
    one context.
    """
    rows = docs.select(*by, "tokens", F.posexplode("tokens").alias("pos", "word"))
    near = F.slice("tokens", F.greatest(F.col("pos") - window, F.lit(0)) + 1, F.least(F.col("pos"), F.lit(window)) + window + 1)
    pairs = rows.select(*by, "word", "pos", F.posexplode(near).alias("at", "context"))
    other = F.col("at") != F.least(F.col("pos"), F.lit(window))
    return pairs.filter(other).groupBy(*by, "word", "context").agg(F.count(F.lit(1)).alias("cnt"))


def frequent_words(counts: DataFrame, total: int, size: int, seed: int = 42) -> list[int]:
    """First hash of the words of ``counts`` (word, n) with more than a ``FREQUENT``-th of all ``total`` tokens."""
    rows = counts.filter(F.col("n") * FREQUENT > total).select(*hashes(F.col("word"), size, seed)[:1]).distinct()
    return [r["h0"] for r in rows.collect()]


def summed_contexts(
    docs: DataFrame, sets: Mapping[str, Sequence[str]], window: int, size: int, total: int, frequent: Sequence[int], seed: int = 42
) -> DataFrame:
    """(train, word, vector) of all words of the cells of each training set; ``docs`` is (cell, tokens).

    A task counts the pairs of a slice of its tokens as numbers and deals them by word to ranges, as many as
    ``total`` tokens ask for. A range adds up the counts of each training set and sums sign vectors, so that a pair
    moves once, as two or three bytes, whatever the number of training sets. Pairs of ``frequent`` words are
    dealt by context too, and their sums are added up afterwards. Words and contexts go by their hashes. Ranges are
    worked on in rounds, so that the pairs of one round only lie on disk at a time.
    """
    cells = sorted({c for own in sets.values() for c in own})
    place, members = {c: i for i, c in enumerate(cells)}, {t: np.isin(cells, list(own)) for t, own in sets.items()}
    ranges, kinds = max(1, -(-total * 2 * window // RANGE_PAIRS)), -(-size // 64)
    rounds = min(ranges, MOST_ROUNDS, max(1, -(-total * 2 * window // ROUND_PAIRS)))
    hot = np.sort(np.array(frequent, np.int64))

    def deal(
        tokens: pa.Array, codes: list[np.ndarray], cell: np.ndarray, doc: np.ndarray, own: int, turn: int
    ) -> Iterator[pa.RecordBatch]:
        """Pairs that begin in the first ``own`` tokens, counted and cut by range, of the ranges of one round."""
        _, first, ids, often = np.unique(codes[0], return_index=True, return_inverse=True, return_counts=True)
        # Frequent words get low numbers, which pack better.
        order = np.argsort(-often, kind="stable")
        number = np.empty_like(order)
        number[order] = np.arange(len(order))
        first, ids = first[order], number[ids]
        known, dictionary = len(first), np.stack([h[first] for h in codes], axis=1)
        is_hot = np.isin(dictionary[:, 0], hot)

        def range_of(word: np.ndarray, context: np.ndarray) -> np.ndarray:
            split = is_hot[word] & (context >= 0)
            key = dictionary[word, 0].view(np.uint64) + np.where(split, dictionary[context, 0], 0).view(np.uint64)
            return (key % np.uint64(ranges)).astype(np.int64)

        asked = is_hot | (range_of(np.arange(known), np.full(known, -1)) % rounds == turn)
        pairs = [np.empty(0, np.int64)]
        for d in range(1, window + 1):
            n = min(own, len(ids) - d)
            if n > 0:
                some = doc[:n] == doc[d : n + d]
                if rounds > 1:
                    some &= asked[ids[:n]] | asked[ids[d : n + d]]
                x, y = ids[:n][some], ids[d : n + d][some]
                # Both directions stand equally often: one is counted.
                pairs.append((cell[:n][some] * known + np.minimum(x, y)) * known + np.maximum(x, y))
        merged = np.sort(np.concatenate(pairs))
        starts = np.flatnonzero(np.diff(merged, prepend=-1))
        count, merged = np.diff(np.append(starts, len(merged))), merged[starts]
        entry, context = merged // known, merged % known
        same, place = entry % known == context, entry // known * known
        count = np.concatenate([np.where(same, 2 * count, count), count[~same]])
        entry, context = np.concatenate([entry, place[~same] + context[~same]]), np.concatenate([context, (entry % known)[~same]])
        # Words of these tokens without any other one near them.
        alone = np.setdiff1d(cell[:own] * known + ids[:own], entry)
        entry, context = np.concatenate([entry, alone]), np.concatenate([context, np.full(len(alone), -1)])
        count = np.concatenate([count, np.zeros(len(alone), count.dtype)])
        to = range_of(entry % known, context)
        mine = np.flatnonzero(to % rounds == turn) if rounds > 1 else np.arange(len(to))
        order = mine[np.argsort((to[mine] * (len(cells) * known) + entry[mine]) * (known + 1) + context[mine] + 1)]
        entry, context, count, to = entry[order], context[order], count[order], to[order]
        borders = np.flatnonzero(np.diff(to, prepend=-1, append=-1)) if len(to) else np.zeros(1, np.int64)
        for a, b in zip(borders[:-1], borders[1:]):
            at = np.flatnonzero(np.diff(entry[a:b], prepend=-1))
            listed, real = entry[a:b][at], context[a:b] >= 0
            lengths = np.add.reduceat(real.astype(np.int64), at)
            seen, used = np.unique(context[a:b][real], return_inverse=True)
            yield pa.RecordBatch.from_arrays([
                pa.array([int(to[a])], pa.int32()), pa.array([tokens.take(pa.array(first[listed % known])).to_pylist()], pa.list_(pa.string())),
                pa.array([len(used)], pa.int32()),
                *[pa.array([a.tobytes()], pa.binary()) for a in (dictionary[listed % known], dictionary[seen])],
                *[pa.array([shrunk(a)], pa.binary()) for a in (listed // known, lengths, np.diff(used, prepend=0), count[a:b][real])],
            ], schema=packed)

    def count(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0

        def out(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
            tokens = pa.concat_arrays([p[0] for p in parts])
            codes = [np.concatenate([p[1][i] for p in parts]) for i in range(kinds)]
            cell, size_of = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
            cell, doc = np.repeat(cell, size_of), np.repeat(np.arange(len(size_of)), size_of)
            for at in range(0, len(tokens), SLICE_TOKENS):
                end = min(at + SLICE_TOKENS, len(tokens))
                far = min(end + window, len(tokens))
                yield from deal(tokens[at:far], [h[at:far] for h in codes], cell[at:far], doc[at:far], end - at, turn)

        for batch in batches:
            lists = batch.column("tokens")
            sizes = np.diff(np.asarray(lists.offsets)).astype(np.int64)
            cell = np.array([place[c] for c in batch.column("cell").to_pylist()], np.int64)
            flat = [np.asarray(batch.column(f"h{i}").flatten()) for i in range(kinds)]
            held.append((lists.flatten().cast(pa.string()), flat, cell, sizes))
            waiting += int(sizes.sum())
            if waiting >= SLICE_TOKENS:
                yield from out(held)
                held, waiting = [], 0
        if held:
            yield from out(held)

    def signs(codes: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(np.ascontiguousarray(codes).view(np.uint8), axis=1, bitorder="little")[:, :size]
        return bits.astype(np.int8) * 2 - 1

    def add(table: pa.Table) -> pa.Table:
        rows = table.drop_columns("range").to_pylist()

        def joined(name: str) -> np.ndarray:
            return np.concatenate([np.frombuffer(r[name], np.int64) for r in rows]).reshape(-1, kinds)

        def grown_all(name: str, sizes: Sequence[int]) -> list[np.ndarray]:
            return [grown(r[name], n) for r, n in zip(rows, sizes)]

        listed, sizes = [len(r["words"]) for r in rows], [r["pairs"] for r in rows]
        at = np.repeat(np.arange(sum(listed)), np.concatenate(grown_all("lengths", listed)))
        codes, contexts = joined("hashes"), joined("contexts")
        shift = np.cumsum([0, *(len(r["contexts"]) // (8 * kinds) for r in rows[:-1])])
        used = np.concatenate([np.cumsum(u, dtype=np.int64) + s for u, s in zip(grown_all("used", sizes), shift)])
        cell, cnt = np.concatenate(grown_all("cells", listed)), np.concatenate(grown_all("counts", sizes))
        _, first, word = np.unique(codes[:, 0], return_index=True, return_inverse=True)
        _, first_context, context = np.unique(contexts[:, 0], return_index=True, return_inverse=True)
        names = list(itertools.chain.from_iterable(r["words"] for r in rows))
        names, own, table = [names[i] for i in first], codes[first], signs(contexts[first_context])
        is_hot = np.isin(own[:, 0], hot)
        known, one, other, from_cell = len(names), word[at], context[used], cell[at]
        width = max(1, len(first_context))
        key, pair = np.unique(one * np.int64(width) + other, return_inverse=True)
        whose, other = key // width, key % width
        del rows, at, used, one, context
        batches = []
        for train, member in members.items():
            mine = member[from_cell]
            there = np.bincount(word[member[cell]], minlength=known) > 0
            n = np.bincount(pair[mine], weights=cnt[mine], minlength=len(key))
            taken = np.flatnonzero(n)
            sums = np.zeros((known, size))
            for start in range(0, len(taken), 20_000):
                some = taken[start : start + 20_000]
                borders = np.flatnonzero(np.diff(whose[some], prepend=-1))
                values = table[other[some]] * (1 + np.log(n[some]))[:, None]
                sums[whose[some][borders]] += np.add.reduceat(values, borders, axis=0)
            raw = np.round(sums, 9)
            norm = np.sqrt((raw * raw).sum(axis=1))
            own_signs = signs(own) / math.sqrt(size)
            vector = np.where(norm[:, None] > 0, raw / np.where(norm > 0, norm, 1)[:, None], own_signs).astype(np.float32)
            for part, chosen in ((False, there & ~is_hot), (True, there & is_hot)):
                k = np.flatnonzero(chosen)
                offsets = pa.array(np.arange(len(k) + 1, dtype=np.int32) * size)
                values = pa.ListArray.from_arrays(offsets, pa.array(vector[k].ravel()))
                partial = pa.ListArray.from_arrays(offsets, pa.array(sums[k].ravel()))
                none = pa.nulls(len(k), values.type), pa.nulls(len(k), partial.type)
                batches.append(pa.RecordBatch.from_arrays(
                    [pa.array([train] * len(k), pa.string()), pa.array([names[i] for i in k], pa.string()), none[0] if part else values, partial if part else none[1]],
                    schema=summed,
                ))
        return pa.Table.from_batches(batches, schema=summed)

    packed = pa.schema([("range", pa.int32()), ("words", pa.list_(pa.string())), ("pairs", pa.int32())] + [
        (n, pa.binary()) for n in ("hashes", "contexts", "cells", "lengths", "used", "counts")
    ])
    summed = pa.schema([("train", pa.string()), ("word", pa.string()), ("vector", pa.list_(pa.float32())), ("sums", pa.list_(pa.float64()))])
    def hashed_by(number: int) -> Column:
        return F.transform("tokens", lambda w: F.xxhash64(w, F.lit(number)))

    hashed = [hashed_by(seed + i).alias(f"h{i}") for i in range(kinds)]
    # Tokens are dealt anew only where the documents lie in too few files: they take more room than their pairs.
    own = docs.filter(F.col("cell").isin(cells)).select("cell", "tokens")
    spread_out = spread(own, own, F.xxhash64("tokens"))
    names = "range int, words array<string>, pairs int, hashes binary, contexts binary, cells binary, lengths binary, used binary, counts binary"
    parts = [
        spread_out.select("cell", "tokens", *hashed).mapInArrow(lambda batches, turn=turn: count(batches, turn), names)
        .repartition(-(-ranges // rounds), "range").groupBy("range")
        .applyInArrow(add, "train string, word string, vector array<float>, sums array<double>")
        for turn in range(rounds)
    ]
    rows = written_parts(parts, "vector-parts")
    whole = rows.filter(F.col("vector").isNotNull()).select("train", "word", "vector")
    sums = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(size)]
    parts = rows.filter(F.col("vector").isNull()).groupBy("train", "word").agg(*sums)
    out = whole.unionByName(scaled(parts, size, seed, ["train"])) if frequent else whole
    out.scratch_paths = rows.scratch_paths
    return out


def shrunk(numbers: np.ndarray) -> bytes:
    """Numbers of four bytes, mostly small, with like bytes side by side and compressed."""
    if not len(numbers):
        return b""
    return pa.compress(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def grown(data: bytes, n: int) -> np.ndarray:
    """The ``n`` numbers that were ``shrunk``."""
    if not n:
        return np.zeros(0, np.int32)
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def hashes(word: Column, size: int, seed: int) -> list[Column]:
    """Columns h0, h1, ... of 64 sign bits each."""
    return [F.xxhash64(word, F.lit(seed + i)).alias(f"h{i}") for i in range(-(-size // 64))]


def sign(place: int) -> Column:
    """+1 or -1 by one bit of the word's hashes."""
    return (F.shiftright(F.col(f"h{place // 64}"), place % 64).bitwiseAND(F.lit(1)) * 2 - 1).cast("double")


def train_word2vec(
    docs: DataFrame, size: int = 100, window: int = 5, min_count: int = 1, seed: int = 42
) -> DataFrame:
    """(word, vector) of all words of ``tokens`` that occur at least ``min_count`` times.

    A word that never has another one near it has no context; its own sign vector stands for it.
    Weights are damped (1 + ln count); sums are rounded to nine digits before they are scaled, so
    the order of a distributed sum cannot show.
    """
    counts = docs.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts.filter(F.col("word").isNotNull()), "word-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    one = docs.filter(F.size("tokens") > 0).select(F.lit("all").alias("cell"), "tokens")
    vectors = summed_contexts(one, {"all": ["all"]}, window, size, total, frequent_words(counts, total, size, seed), seed)
    vectors_paths = vectors.scratch_paths
    if min_count > 1:
        vectors = vectors.join(counts.filter(F.col("n") >= min_count).select("word"), "word", "left_semi")
    out = vectors.select("word", "vector")
    out.scratch_paths = vectors_paths
    return out


def vectors_of(pairs: DataFrame, kept: DataFrame, size: int, seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """(by, word, vector) out of counted ``pairs`` (by, word, context, cnt) for all words of ``kept`` (by, word):
    the definition by joins and sums, for pairs that are at hand."""
    own_rows = kept.select(*by, "word", F.col("word").alias("context"), F.lit(0.0).alias("weight"))
    rows = pairs.select(*by, "word", "context", (1 + F.log("cnt")).alias("weight")).unionByName(own_rows)
    sums = [F.sum(F.col("weight") * sign(i)).alias(f"s{i}") for i in range(size)]
    hashed = rows.select(*by, "word", "weight", *hashes(F.col("context"), size, seed))
    return scaled(hashed.groupBy(*by, "word").agg(*sums), size, seed, by)


def scaled(sums: DataFrame, size: int, seed: int = 42, by: Sequence[str] = ()) -> DataFrame:
    """(by, word, vector) out of sums of sign vectors in the columns s0, s1, ..."""
    raw = F.array(*[F.round(f"s{i}", 9) for i in range(size)])
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda acc, x: acc + x * x))
    own = F.array(*[sign(i) / math.sqrt(size) for i in range(size)])
    vector = F.when(F.col("norm") > 0, F.transform("raw", lambda x: x / F.col("norm"))).otherwise(own)
    named = sums.select(*by, "word", raw.alias("raw"), *hashes(F.col("word"), size, seed)).withColumn("norm", norm)
    return named.select(*by, "word", vector.cast("array<float>").alias("vector"))
