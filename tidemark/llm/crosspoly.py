"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables.

A table rotates unit vectors pseudo-randomly (three rounds of random signs and a fast Hadamard
transform) and assigns each to the nearest signed axis. Rows enter their own bucket of every table;
queries also visit the buckets of their next-nearest axes. Each bucket ranks its rows for its queries
exactly and hands on the best few, which are merged over buckets and tables. Queries that meet fewer
than ``k`` rows so visit all axes of one table, which hold every row once.

Equal vectors are one entry that keeps the smallest ids (as many as can appear in an answer), so a
vector that makes up a third of the table is a single entry. Buckets are cut into blocks of bounded
size, each of which meets the bucket's queries; no bucket is capped.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no part;
vectors of another length than the (most frequent, then smallest) one of the table are refused; ties
go to the smaller id; rows that repeat an id count as candidates once each, a query id is searched
once, with its smallest vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch

TABLES, PROBES, SEED = 8, 16, 20_011
ALL_AXES = 1 << 30
BLOCK_ROWS = 4_096  # rows of a bucket that are ranked at once
QUERY_BLOCK = 2_048


def usable(vector: Column) -> Column:
    """Whether a vector can be compared: no null or non-finite component, not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of rows whose length is a power of two."""
    n, step = x.shape[1], 1
    while step < n:
        y = x.reshape(len(x), -1, 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        step *= 2
    return x / np.sqrt(n)


def rotated(vectors: np.ndarray, table: int, seed: int = SEED) -> np.ndarray:
    """Pseudo-random rotation of a table, padded to a power of two."""
    size = 1 << max(0, vectors.shape[1] - 1).bit_length()
    x = np.zeros((len(vectors), size))
    x[:, : vectors.shape[1]] = vectors
    signs = np.random.default_rng([seed, table]).choice([-1.0, 1.0], (3, size))
    for row in signs:
        x = hadamard(x * row)
    return x


def nearest_axes(vectors: np.ndarray, table: int, count: int) -> np.ndarray:
    """The ``count`` nearest signed axes (2i for +i, 2i + 1 for -i) of each vector, best first."""
    x = rotated(vectors, table)
    both = np.stack([x, -x], axis=2).reshape(len(x), -1)
    count = min(count, both.shape[1])
    if count == 1:
        return both.argmax(axis=1)[:, None]
    return np.argsort(-both, axis=1, kind="stable")[:, :count]


def unit_rows(column: pd.Series) -> np.ndarray:
    x = np.stack(column.to_numpy()).astype(np.float64)
    # Scaled first: squares of huge or tiny components would overflow or vanish.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by powers of two, which is exact, in extended precision."""
    _, power = np.frexp(np.abs(vectors).max(axis=1, keepdims=True))
    return np.ldexp(vectors, -power).astype(np.longdouble)


def cosines(vectors: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Cosine of each row and a vector; equal cosines come out equal where products and sums are exact."""
    x, y = scaled(vectors), scaled(one[None, :])[0]
    dot = (x * y).sum(axis=1)
    return (np.sign(dot) * np.sqrt(dot * dot / ((x * x).sum(axis=1) * (y * y).sum()))).astype(np.float64)


def buckets(entries: DataFrame, tables: int, probes: int) -> DataFrame:
    """Add (tab, axis) rows: each entry under its ``probes`` nearest axes in every table."""
    names = entries.columns

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 1024):
                batch = whole.iloc[at : at + 1024]
                units = unit_rows(batch["vector"])
                for tab in range(tables):
                    axes = nearest_axes(units, tab, probes)
                    out = batch.iloc[np.repeat(np.arange(len(batch)), axes.shape[1])].copy()
                    out["tab"], out["axis"] = tab, axes.reshape(-1)
                    yield out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema) + ", tab int, axis int"
    return entries.mapInPandas(rows, schema).select(*names, "tab", "axis")


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 5, tables: int = TABLES, probes: int = PROBES
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of ``vectors`` (vec_id, vector).

    ``is_query`` is an expression on ``vec_id``. A query never finds rows of its own id.
    """
    spark = vectors.sparkSession
    usable_rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector")
    ).filter(F.col("vec_id").isNotNull() & usable(F.col("vector")))
    scratch = Scratch(spark)
    clean = scratch.write(usable_rows.withColumn("content", F.xxhash64("vector")), "vectors")
    sizes = clean.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("c")).collect()
    if len(sizes) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(r['n'] for r in sizes)}")

    # The k + 1 smallest ids of equal vectors: one of them may be the query itself. Ranked in two
    # steps, so that no task sorts all copies of a hot vector.
    part = F.pmod(F.xxhash64("vec_id"), F.lit(64))
    first = Window.partitionBy("content", "vector", "part").orderBy("vec_id")
    second = Window.partitionBy("content", "vector").orderBy("vec_id")
    few = clean.withColumn("part", part).withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1)
    fewer = few.withColumn("r", F.row_number().over(second)).filter(F.col("r") <= k + 1)
    entries = scratch.write(
        fewer.groupBy("content", "vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).drop("content"), "entries"
    )
    queries = clean.filter(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector")).withColumnRenamed("vec_id", "query_id")

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            rows, ids = unit_rows(left["vector"]), left["ids"].to_numpy()
            vectors, smallest = np.stack(left["vector"].to_numpy()), np.array([i[0] for i in ids], np.int64)
            keep = min(k + 1, len(rows))  # one of them may be the query itself
            margin = 8 * (rows.shape[1] + 8) * np.finfo(np.float64).eps
            for at in range(0, len(right), QUERY_BLOCK):
                part = right.iloc[at : at + QUERY_BLOCK]
                scores = unit_rows(part["vector"]) @ rows.T
                least = np.partition(scores, len(rows) - keep, axis=1)[:, len(rows) - keep] - margin
                for q, vector, row_scores, low in zip(part["query_id"], part["vector"], scores, least):
                    near = np.flatnonzero(row_scores >= low)  # rounding may swap near ties
                    exact = cosines(vectors[near], np.asarray(vector))
                    for n in np.lexsort((smallest[near], -exact))[:keep]:
                        out += [(q, exact[n], i) for i in ids[near[n]] if i != q]
        found = pd.DataFrame(out, columns=["query_id", "score", "vec_id"])
        order = found.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
        return order.groupby("query_id").head(k).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    index = buckets(entries, tables, 1)
    # Cut every bucket into blocks; its queries meet each of them.
    cut = index.groupBy("tab", "axis").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    index = index.join(F.broadcast(cut), ["tab", "axis"]).withColumn(
        "block", F.pmod(F.xxhash64("vector"), F.col("blocks")).cast("int")
    ).drop("blocks")

    def search(asked: DataFrame, rows: DataFrame, tables: int, probes: int) -> DataFrame:
        visits = buckets(asked, tables, probes).join(F.broadcast(cut), ["tab", "axis"]).select(
            "*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
        ).drop("blocks")
        ranked = rows.groupBy("tab", "axis", "block").cogroup(visits.groupBy("tab", "axis", "block")).applyInPandas(
            best, "query_id long, score double, vec_id long"
        )
        merged = ranked.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
            "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
        )

    found = scratch.write(search(queries, index, tables, probes), "found")
    full = found.filter(F.col("rank") == k).select("query_id")
    # The axes of a table share out all rows: no query is left with fewer rows than there are candidates.
    short = scratch.write(queries.join(full, "query_id", "left_anti"), "short")
    if short.isEmpty():
        return found
    again = search(short, index.filter(F.col("tab") == 0), 1, ALL_AXES)
    return found.join(full, "query_id", "left_semi").select(*found.columns).unionByName(again)
