"""Term counts, vocabularies and inverse document frequencies.

A document's terms are counted inside its own row. Summing those counts then needs a single
aggregation on the term, and a document frequency is a plain row count: no token leaves its
task before it is counted and no distinct aggregation is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import long_tokens

BUCKETS = 32


def with_term_counts(df: DataFrame, tokens: Column, out: str = "terms") -> DataFrame:
    """Add array<struct<term, tf, pos>>: each distinct token, its count and first position.

    The (token, position) pairs are sorted; a term starts where the token changes, and its
    count is the distance to the next start. That is linear after the sort, also for a text
    of many thousand words. Each step is its own column, so no lambda re-evaluates it.
    """
    pairs = F.transform(tokens, lambda w, i: F.struct(w.alias("term"), i.alias("pos")))
    sorted_pairs = df.withColumn("__pairs", F.sort_array(pairs))
    starts = F.filter(
        F.transform(
            "__pairs",
            lambda p, i: F.struct(
                p["term"].alias("term"),
                p["pos"].alias("pos"),
                i.alias("at"),
                ((i == 0) | (F.get("__pairs", i - 1)["term"] != p["term"])).alias("first"),
            ),
        ),
        lambda s: s["first"],
    )
    located = sorted_pairs.withColumn("__starts", starts).withColumn("__n", F.size("__pairs"))
    counted = F.transform(
        "__starts",
        lambda s, j: F.struct(
            s["term"].alias("term"),
            (F.coalesce(F.get("__starts", j + 1)["at"], F.col("__n")) - s["at"]).alias("tf"),
            s["pos"].alias("pos"),
        ),
    )
    return located.withColumn(out, counted).drop("__pairs", "__starts", "__n")


def document_terms(docs: DataFrame, min_length: int = 2) -> DataFrame:
    """Documents with ``tokens`` -> documents with ``terms`` in place of the tokens."""
    tokens = long_tokens(F.col("tokens"), min_length) if min_length > 1 else F.col("tokens")
    return with_term_counts(docs, tokens)


def exploded_terms(docs: DataFrame, *keep: str, outer: bool = False) -> DataFrame:
    """One row per document and distinct term; ``outer`` keeps documents without terms.

    Always the outer form: the inner one makes the planner add a test for non-empty arrays
    below the projection that builds them, which would count every text a second time.
    """
    rows = docs.select(*keep, F.inline_outer("terms"))
    return rows if outer else rows.filter(F.col("term").isNotNull())


def document_keys(docs: DataFrame, *more: str) -> list[str]:
    """The columns that name a document: its domain, where there is one, and its number."""
    return [c for c in ("domain", "doc_id", *more) if c in docs.columns]


def term_totals(docs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, term, cnt, df): occurrences and number of documents of each term."""
    return (
        exploded_terms(docs, *by)
        .groupBy(*by, "term")
        .agg(F.sum("tf").cast("bigint").alias("cnt"), F.count(F.lit(1)).alias("df"))
    )


def vocabulary(totals: DataFrame, size: int = 1000, by: Sequence[str] = ()) -> DataFrame:
    """The ``size`` most frequent terms (per group), ranked from 1; ties go by the term.

    Without groups this is a top-k: every task keeps its own ``size`` best rows and only
    those meet. With groups the terms are ranked in hash buckets first: what a group ranks in the
    end is at most ``size`` rows of each bucket, however many terms it has.
    """
    order = [F.desc("cnt"), F.asc("term")]
    if not by:
        best = totals.orderBy(*order).limit(size)
        return best.withColumn("rank", F.row_number().over(W.orderBy(*order)))
    bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS))
    within = F.row_number().over(W.partitionBy(*by, "__bucket").orderBy(*order))
    totals = totals.withColumn("__bucket", bucket).withColumn("rank", within).filter(F.col("rank") <= size).drop("__bucket")
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return totals.withColumn("rank", rank).filter(F.col("rank") <= size)


def smooth_idf(df: Column, n_docs: Column) -> Column:
    """ln((1 + n) / (1 + df)) + 1."""
    return F.log((1 + n_docs) / (1 + df)) + 1


def with_idf(vocab: DataFrame, train: DataFrame) -> DataFrame:
    """Add the idf to a vocabulary built from ``train`` (one group)."""
    n_docs = train.agg(F.count(F.lit(1)).alias("n")).scalar()
    return vocab.withColumn("idf", smooth_idf(F.col("df"), n_docs))
