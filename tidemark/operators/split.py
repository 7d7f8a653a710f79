"""Train/test splits and folds.

A fold is described by a small table (fold, domain, part, role). Single-domain runs, all
train/test pairs and leave-one-domain-out runs differ in that table only, so every experiment
is one plan whatever the number of folds.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.lookup import lookup
from tidemark.session import small_table, written

# Bits of the hash by which documents are ordered, and of each of its digits.
HASH_BITS, DIGIT_BITS = 60, 15

Cell = tuple[str, str, str, str]


def hash_part(doc_id: Column, seed: int = 42) -> Column:
    """'test' for one fifth of the documents, else 'train'.

    The part depends on the key alone: it does not change when a task is run again or the
    data are partitioned in another way, as a random split would.
    """
    head = F.substring(F.md5(F.concat(doc_id.cast("string"), F.lit(f"-{seed}"))), 1, 8)
    return F.when(head < "33333333", "test").otherwise("train")


def split_exactly(docs: DataFrame, key: str, by: Sequence[str] = (), share: int = 5, seed: int = 42) -> DataFrame:
    """``docs`` with ``part``: 'test' for exactly ceil(n / ``share``) documents of each stratum ``by``, else 'train'.

    Test documents are those with the smallest hashes of the key, so a stratum's part depends on its keys alone. The
    hash that ends the test part is found without sorting: rows are counted by the leading ``DIGIT_BITS`` bits of
    their hash, the digit where the wanted number is reached is kept, and the rows with that digit are counted
    by the next bits, four times. A pass hands on at most 2^15 counts per stratum. Nulls in ``by`` are a stratum of their own
    and a null key hashes as the word null. Rows of one key are never parted: where a repeated key lies on
    the border, all its rows are test rows, so a test part can then be larger by the repeats of one key.
    """
    text = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(f"-{seed}"))
    point = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    # One text names a stratum, null or not, so that strata join like any other key.
    stratum = F.to_json(F.struct(*by)) if by else F.lit("{}")
    hashed = docs.withColumn("__stratum", stratum).withColumn("__hash", point)
    rows = written(hashed.select("__stratum", "__hash"), "hashes")
    sizes = rows.groupBy("__stratum").agg(F.ceil(F.count(F.lit(1)) / share).alias("wanted"))
    found = written(sizes.withColumn("prefix", F.lit(0).cast("bigint")), "borders")
    for level in range(1, HASH_BITS // DIGIT_BITS + 1):
        rest = HASH_BITS - level * DIGIT_BITS
        place = F.shiftright("__hash", rest)
        open_rows = lookup(rows, found, "__stratum").filter(F.shiftright("__hash", rest + DIGIT_BITS) == F.col("prefix"))
        counts = open_rows.groupBy("__stratum", "wanted", place.alias("place")).agg(F.count(F.lit(1)).alias("n"))
        up_to = F.sum("n").over(W.partitionBy("__stratum").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow))
        reached = counts.withColumn("up_to", up_to).filter(F.col("up_to") >= F.col("wanted"))
        first = reached.groupBy("__stratum").agg(F.min_by(F.struct("place", "wanted", "up_to", "n"), "place").alias("f"))
        before = F.col("f.up_to") - F.col("f.n")
        found = written(first.select("__stratum", (F.col("f.wanted") - before).alias("wanted"), F.col("f.place").alias("prefix")), "borders")
    ends = found.select("__stratum", F.col("prefix").alias("__end"))
    parted = lookup(hashed, ends, "__stratum").withColumn("part", F.when(F.col("__hash") <= F.col("__end"), "test").otherwise("train"))
    return parted.drop("__stratum", "__hash", "__end")


def hash_bucket(doc_id: Column, buckets: int, seed: int) -> Column:
    """Pseudo-random bucket of a document, for inner folds and hold-outs."""
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(buckets)).cast("int")


def single_cells(domains: Sequence[str]) -> list[Cell]:
    """One fold per domain: train and test on the two parts of that domain."""
    return [(d, d, part, part) for d in domains for part in ("train", "test")]


def transfer_cells(pairs: Sequence[tuple[str, str]]) -> list[Cell]:
    """One fold per pair: train on all of the first domain, test on all of the second."""
    return [
        (f"{a}-{b}", d, part, role)
        for a, b in pairs
        for d, role in ((a, "train"), (b, "test"))
        for part in ("train", "test")
    ]


def all_pairs(domains: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for a in domains for b in domains if a != b]


def leave_one_out_cells(domains: Sequence[str]) -> list[Cell]:
    """One fold per domain: test on it, train on all the others."""
    return [
        (t, d, part, "test" if d == t else "train")
        for t in domains
        for d in domains
        for part in ("train", "test")
    ]


def fold_table(spark: SparkSession, cells: Sequence[Cell]) -> DataFrame:
    """The cells as a DataFrame; its size is set by the number of domains, not by the data."""
    names = ("fold", "domain", "part", "role")
    return small_table(spark, {n: (pa.string(), [c[i] for c in cells]) for i, n in enumerate(names)})


def in_role(df: DataFrame, folds: DataFrame, role: str) -> DataFrame:
    """Rows of ``df`` (with domain and part) once per fold in which they have the role."""
    wanted = folds.filter(F.col("role") == role).drop("role")
    return df.join(F.broadcast(wanted), ["domain", "part"])
