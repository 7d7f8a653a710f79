"""Integer word sequences: word index, encoding and padding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.text import pad_front
from tidemark.operators.terms import document_keys, document_terms, exploded_terms


def word_index(train: DataFrame, num_words: int = 10_000) -> DataFrame:
    """(term, cnt, idx): words by falling count, ties by first occurrence, indices from 1.

    Only indices below ``num_words`` are ever used, so only those are kept: a top-k, and the
    numbering then runs over its few rows.
    """
    keys = document_keys(train)
    first = F.min(F.struct("doc_id", "pos", *keys[:-1]))
    counts = (
        exploded_terms(document_terms(train, min_length=1), *keys)
        .groupBy("term")
        .agg(F.sum("tf").cast("bigint").alias("cnt"), first.alias("first"))
    )
    order = [F.desc("cnt"), F.asc("first")]
    best = counts.orderBy(*order).limit(num_words - 1)
    return best.select("term", "cnt", F.row_number().over(W.orderBy(*order)).alias("idx"))


def token_sequences(docs: DataFrame, index: DataFrame) -> DataFrame:
    """(domain, doc_id, seq): the indices of a document's known words in text order.

    The index has fewer than ``num_words`` rows and is broadcast. A document's tokens stay
    together until they are gathered again, so one row per document is shuffled.
    """
    keys = document_keys(docs)
    rows = docs.select(*keys, F.posexplode_outer("tokens").alias("pos", "term"))
    known = rows.join(F.broadcast(index.select("term", "idx")), "term", "left")
    entry = F.when(F.col("idx").isNotNull(), F.struct("pos", "idx"))
    gathered = known.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    return gathered.select(*keys, F.transform("entries", lambda e: e["idx"]).alias("seq"))


def padded_sequences(sequences: DataFrame, size: int = 100) -> DataFrame:
    """Sequences of fixed length: cut and filled at the front."""
    return sequences.select(*document_keys(sequences), pad_front(F.col("seq"), size).alias("seq"))
