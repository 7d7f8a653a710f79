"""Polarity of a document as the mean polarity of its lexicon words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.lookup import lookup
from tidemark.operators.terms import document_keys, exploded_terms


def lexicon_polarity(
    docs: DataFrame, lexicon: DataFrame, keep: Sequence[str] | None = None, bound: int | None = None
) -> DataFrame:
    """(keep, polarity): mean over all occurrences of lexicon words, 0 without any.

    By default ``keep`` is the document's domain and number. Polarities are summed as they are
    given; whole numbers (hundredths, say) sum exactly in any order.

    ``docs`` carries ``terms``; ``lexicon`` is (word, polarity) with one row per word, and
    ``bound`` its row count where that is known.
    """
    keep = keep or document_keys(docs)
    rows = exploded_terms(docs, *keep, outer=True)
    entries = lexicon.select(F.col("word").alias("term"), "polarity")
    hits = lookup(rows, entries, bound=bound)
    weight = F.when(F.col("polarity").isNotNull(), F.col("tf"))
    summed = hits.groupBy(*keep).agg(
        F.sum(F.col("tf") * F.col("polarity")).alias("total"), F.sum(weight).alias("hits")
    )
    mean = F.coalesce(F.col("total") / F.col("hits"), F.lit(0.0))
    return summed.select(*keep, mean.alias("polarity"))
