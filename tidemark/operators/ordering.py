"""Running sums and ranks over any number of values.

Rows are cut into ranges of the order, whose number follows the number of rows; a task sorts its range only.
What lies before a range is the sum of the ranges before it, taken in levels of ``LEVEL`` entries, so no
task ever sees all ranges either. Range bounds steer the load and not the result: rows of equal order keys lie in
one range, and the ranges are written down before anything is added up.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.lookup import lookup
from tidemark.session import written

PER_RANGE = 1_000_000
LEVEL = 1_000


def _before(totals: DataFrame, by: Sequence[str], place: str, sums: Sequence[str], places: int) -> DataFrame:
    """Totals per (by, place) -> the sums over all smaller places; ``places`` bounds the places from above."""
    block = f"{place}_block"
    marked = totals.withColumn(block, F.floor(F.col(place) / LEVEL).cast("int"))
    inside = W.partitionBy(*by, block).orderBy(place).rowsBetween(W.unboundedPreceding, -1)
    within = marked.select(*by, place, block, *[F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(s) for s in sums])
    if places <= LEVEL:
        return within.drop(block)
    blocks = marked.groupBy(*by, block).agg(*[F.sum(s).alias(s) for s in sums])
    return _added(within, _before(blocks, by, block, sums, -(-places // LEVEL)), [*by, block], sums).drop(block)


def _added(rows: DataFrame, offsets: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """``rows`` with the sums of ``offsets`` for the same keys added to theirs; null keys are equal keys."""
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    columns = [(F.col(f"l.{c}") + F.col(f"o.{c}")).alias(c) if c in sums else F.col(f"l.{c}") for c in rows.columns]
    return rows.alias("l").join(offsets.alias("o"), same).select(*columns)


def running_sums(
    df: DataFrame, order: Sequence[str], sums: Mapping[str, Column], by: Sequence[str] = (), per_range: int = PER_RANGE
) -> DataFrame:
    """``df`` with, for each name in ``sums``, the sum of its expression over the rows that come earlier.

    Earlier means smaller by ``order`` (ascending, nulls first) within the same ``by``. The order must name a row: rows
    of equal keys are put in any order among each other. ``df`` is computed once.
    """
    names = list(sums)
    made = written(df.select("*", *[e.alias(f"__v_{n}") for n, e in sums.items()]), "unordered")
    ranges = max(1, -(-made.count() // per_range))
    cut = made.repartitionByRange(ranges, *by, *order).withColumn("__range", F.spark_partition_id())
    placed = written(cut, "ranges")
    totals = placed.groupBy(*by, "__range").agg(*[F.sum(f"__v_{n}").alias(n) for n in names])
    offsets = _before(totals, by, "__range", names, ranges)
    inside = W.partitionBy(*by, "__range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = placed.select(*df.columns, "__range", *[F.coalesce(F.sum(f"__v_{n}").over(inside), F.lit(0)).alias(n) for n in names])
    return _added(local, offsets, [*by, "__range"], names).drop("__range")


def value_codes(df: DataFrame, column: str, per_range: int = PER_RANGE) -> DataFrame:
    """(column, n, code): each distinct value, its rows and its place among the sorted values, from 0. Nulls have none."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return running_sums(counts, [column], {"code": F.lit(1).cast("bigint")}, per_range=per_range)


def encode_values(df: DataFrame, column: str, out: str = "label", per_range: int = PER_RANGE) -> DataFrame:
    """``df`` with the index of each value among the sorted distinct values of ``column``; null for null.

    Any number of values will do: the codes are joined by ``lookup``, which broadcasts a small table and keeps frequent
    values out of the shuffle of a large one. ``df`` is read twice.
    """
    codes = value_codes(df, column, per_range).select(column, F.col("code").alias(out))
    return lookup(df, written(codes, "codes"), column)


def mid_ranks(df: DataFrame, column: str, by: Sequence[str] = (), out: str = "rank", per_range: int = PER_RANGE) -> DataFrame:
    """(by, column, n, rank): each distinct value, its rows and the mean of their ranks from 1. Nulls have none."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_sums(counts, [column], {"__before": F.col("n")}, by, per_range)
    return ranked.select(*by, column, "n", (F.col("__before") + (F.col("n") + 1) / 2).alias(out))
