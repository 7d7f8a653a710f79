"""Rank tests over score tables (slice, dataset, method, score).

The tables are small (datasets times methods), yet all steps are plain aggregations, so many
slices (accuracy, precision, ...) are tested in one plan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.special import chi2_tail, normal_cdf


def mid_ranks(scores: DataFrame, block: str = "dataset", treatment: str = "method") -> DataFrame:
    """Rank of every score within its block, from 1; equal scores share their mean rank."""
    inside = W.partitionBy("slice", block)
    same = F.count(F.lit(1)).over(W.partitionBy("slice", block, "score"))
    return scores.select(
        "slice",
        F.col(block).alias("block"),
        F.col(treatment).alias("treatment"),
        (F.rank().over(inside.orderBy("score")) + (same - 1) / 2).alias("rank"),
        same.alias("tied"),
        F.count(F.lit(1)).over(inside).alias("width"),
        F.count(F.lit(1)).over(W.partitionBy("slice", block, treatment)).alias("copies"),
    )


def friedman_test(
    scores: DataFrame, alpha: float = 0.05, block: str = "dataset", treatment: str = "method"
) -> DataFrame:
    """(slice, k, n, statistic, p, reject): do the treatments differ?

    By default methods are compared with datasets as blocks. Exchange the two columns to
    compare datasets over methods. Where a block does not hold every treatment exactly once, the
    test is not defined: statistic, p and reject are NULL.
    """
    ranks = mid_ranks(scores, block, treatment)
    sums = ranks.groupBy("slice", "treatment").agg(
        F.sum("rank").alias("rank_sum"),
        F.count(F.lit(1)).alias("n"),
        # Each of the t scores tied together adds t^2 - 1, the group t^3 - t.
        F.sum(F.col("tied") * F.col("tied") - 1).alias("ties"),
        F.min("width").alias("narrowest"),
        F.max("width").alias("widest"),
        F.max("copies").alias("copies"),
    )
    total = sums.groupBy("slice").agg(
        F.count(F.lit(1)).alias("k"),
        F.max("n").alias("n"),
        F.sum(F.col("rank_sum") * F.col("rank_sum")).alias("ssq"),
        F.sum("ties").alias("ties"),
        ((F.min("narrowest") == F.count(F.lit(1))) & (F.max("widest") == F.count(F.lit(1))) & (F.max("copies") == 1)).alias("complete"),
    )
    k, n = F.col("k"), F.col("n")
    correction = 1 - F.col("ties") / (n * k * (k * k - 1))
    raw = 12.0 / (n * k * (k + 1)) * F.col("ssq") - 3 * n * (k + 1)
    stat = total.withColumn("statistic", F.when(F.col("complete") & (correction > 0), raw / correction))
    tested = stat.withColumn("p", chi2_tail(F.col("statistic"), k - 1))
    return tested.select("slice", "k", "n", "statistic", "p", (F.col("p") <= alpha).alias("reject"))


def studentized_range_tail(pairs: DataFrame, q: str, k: str, out: str, steps: int = 160) -> DataFrame:
    """Add P(range of k standard normals > q).

    The distribution function is k times the integral of phi(z) (Phi(z) - Phi(z - q))^(k-1).
    One row per pair becomes one row per grid point, and Simpson's rule is a sum over them.
    """
    low, width = -8.0, 16.0 / steps
    points = pairs.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    z = F.lit(low) + F.col("__i") * width
    simpson = F.when(F.col("__i").isin(0, steps), 1.0).when(F.col("__i") % 2 == 1, 4.0).otherwise(2.0)
    placed = points.withColumn("__z", z).withColumn("__w", simpson)
    upper = placed.withColumn("__a", normal_cdf(F.col("__z")))
    both = upper.withColumn("__b", normal_cdf(F.col("__z") - F.col(q)))
    density = F.exp(-F.col("__z") * F.col("__z") / 2) / math.sqrt(2 * math.pi)
    value = F.col("__w") * density * F.pow(F.col("__a") - F.col("__b"), F.col(k) - 1)
    area = F.sum(value) * width / 3 * F.first(k)
    tail = F.when(F.first(q) <= 0, 1.0).otherwise(F.least(F.greatest(1 - area, F.lit(0.0)), F.lit(1.0)))
    return both.groupBy(*pairs.columns).agg(tail.alias(out))


def nemenyi_pairs(
    scores: DataFrame, alpha: float = 0.05, block: str = "dataset", treatment: str = "method"
) -> DataFrame:
    """(slice, method_a, method_b, rank_gap, q, p, differs) for every ordered pair of treatments.

    q is the studentized range statistic of the two mean ranks, p its upper tail for k
    treatments and infinitely many degrees of freedom. A treatment against itself has p = 1.
    """
    means = (
        mid_ranks(scores, block, treatment)
        .groupBy("slice", "treatment")
        .agg(F.avg("rank").alias("mean_rank"), F.count(F.lit(1)).alias("n"))
    )
    # The methods of a slice fit in one array; pairing it with itself computes the ranks once.
    listed = means.groupBy("slice").agg(F.collect_list(F.struct("treatment", "mean_rank", "n")).alias("all"))
    twice = listed.select("slice", "all", F.explode("all").alias("a")).select("slice", "all", "a", F.explode("all").alias("b"))
    k, n = F.size("all"), F.col("a.n")
    gap = F.abs(F.col("a.mean_rank") - F.col("b.mean_rank"))
    pairs = (
        twice.filter(F.col("a.treatment") <= F.col("b.treatment"))
        .select(
            "slice",
            F.col("a.treatment").alias("method_a"),
            F.col("b.treatment").alias("method_b"),
            k.alias("k"),
            gap.alias("rank_gap"),
            (gap / F.sqrt(k * (k + 1) / (6 * n)) * math.sqrt(2)).alias("q"),
        )
    )
    tested = studentized_range_tail(pairs, "q", "k", "p")
    a, b = F.col("method_a"), F.col("method_b")
    there = F.struct(a.alias("method_a"), b.alias("method_b"))
    back = F.struct(b.alias("method_a"), a.alias("method_b"))
    both = F.when(a == b, F.array(there)).otherwise(F.array(there, back))
    rows = tested.select("slice", F.inline(both), "rank_gap", "q", "p")
    return rows.withColumn("differs", F.col("p") <= alpha)


def nemenyi_matrix(pairs: DataFrame, methods: Sequence[str]) -> DataFrame:
    """Square p-value table: one row and one column per method."""
    return (
        pairs.groupBy("slice", "method_a")
        .pivot("method_b", list(methods))
        .agg(F.first("p"))
    )
