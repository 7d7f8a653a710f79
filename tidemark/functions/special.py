"""Tail probabilities as column expressions, without a Python function per row."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def erfc(x: Column, steps: int = 120) -> Column:
    """Complementary error function of x >= 0.

    Below 3 by the series of ``normal_cdf``, beyond it by the continued fraction
    exp(-x^2) / sqrt(pi) / (x + (1/2) / (x + 1 / (x + (3/2) / (x + ...)))), which keeps its
    relative precision however small the result is.
    """
    start = F.lit(0.0)
    fraction = F.aggregate(F.sequence(F.lit(steps), F.lit(1), F.lit(-1)), start, lambda acc, i: (i / 2) / (x + acc))
    far = F.exp(-x * x) / math.sqrt(math.pi) / (x + fraction)
    near = 2 * (1 - normal_cdf(x * math.sqrt(2)))
    return F.when(x < 3, near).otherwise(far)


def chi2_tail(x: Column, dof: Column) -> Column:
    """P(X > x) for a chi-square variable with a whole number of degrees of freedom.

    The upper tail is a finite sum, so no term is cut off: with z = x / 2 it is the sum of
    exp(-z) z^j / Gamma(j + 1) over j = 0, 1, ..., dof / 2 - 1 for even dof, and erfc(sqrt(z))
    plus the same sum over j = 1/2, 3/2, ..., dof / 2 - 1 for odd dof. Terms are built in
    logarithms, where nothing under- or overflows.
    """
    z = x / 2
    odd = (dof % 2 == 1).cast("double")
    first = odd / 2  # the smallest j
    terms = F.floor(dof / 2).cast("int")
    # ln Gamma(j + 1) of the smallest j: Gamma(1) = 1, Gamma(3/2) = sqrt(pi) / 2.
    log_gamma = odd * math.log(math.sqrt(math.pi) / 2)
    # Both sides of a conditional may be evaluated: the logarithm gets a harmless argument at 0.
    log_z = F.log(F.greatest(z, F.lit(1e-300)))
    begin = F.struct((first * log_z - z - log_gamma).alias("log"), F.lit(0.0).alias("total"))

    def add(acc: Column, i: Column) -> Column:
        following = acc["log"] + log_z - F.log(first + i)
        return F.struct(following.alias("log"), (acc["total"] + F.exp(acc["log"])).alias("total"))

    steps = F.when(terms > 0, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(steps, begin, add, lambda acc: acc["total"])
    tail = total + odd * erfc(F.sqrt(F.greatest(z, F.lit(0.0))))
    return F.when(x <= 0, F.lit(1.0)).when(x > 0, F.least(tail, F.lit(1.0)))


def normal_cdf(x: Column, steps: int = 120) -> Column:
    """Standard normal distribution function: 1/2 + phi(x) (x + x^3/3 + x^5/15 + ...)."""
    start = F.struct(x.alias("term"), x.alias("total"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] * x * x / (2 * i + 1)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, add, lambda acc: acc["total"])
    density = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    inside = F.lit(0.5) + density * series
    return F.when(x > 8, 1.0).when(x < -8, 0.0).otherwise(inside)
