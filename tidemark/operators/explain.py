"""Words with the highest and lowest weight in a linear model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def influential_words(weights: DataFrame, n: int = 10, digits: int = 6) -> DataFrame:
    """(fold, side, place, term, weight): the ``n`` highest and ``n`` lowest of every fold.

    ``weights`` is (term, weight), with a fold where there are several. Weights are rounded before
    they are ranked; ties go by the term. A fold holds no more terms than its vocabulary.
    """
    by = [c for c in ("fold",) if c in weights.columns]
    table = weights.select(*by, "term", F.round("weight", digits).alias("weight"))
    parts = []
    for side, order in (("positive", F.desc("weight")), ("negative", F.asc("weight"))):
        place = F.row_number().over(W.partitionBy(*by).orderBy(order, F.asc("term")))
        ranked = table.withColumn("place", place).filter(F.col("place") <= n)
        parts.append(ranked.select(*by, F.lit(side).alias("side"), "place", "term", "weight"))
    return parts[0].unionByName(parts[1])


def log_odds(model: DataFrame) -> DataFrame:
    """Term weights of a two-class naive Bayes model: ln P(term | 1) - ln P(term | 0)."""
    return model.select("fold", "term", (F.col("lp_1") - F.col("lp_0")).alias("weight"))
