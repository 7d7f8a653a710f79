"""Stop-word lists as tables, for lists too long to be part of an expression."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.lookup import lookup
from tidemark.operators.terms import document_keys
from tidemark.session import broadcast_if_small, small_table


# Words of a list that become part of the expression.
INLINE_WORDS = 1000


def stop_table(spark: SparkSession, lists: Mapping[str, Iterable[str]]) -> DataFrame:
    """(profile, word) out of word lists."""
    pairs = [(name, word) for name, words in sorted(lists.items()) for word in sorted(set(words))]
    return small_table(
        spark, {"profile": (pa.string(), [p for p, _ in pairs]), "word": (pa.string(), [w for _, w in pairs])}
    )


def without_stop_words(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(domain, doc_id, tokens) without the listed words, in text order; no document is lost.

    A list of at most ``INLINE_WORDS`` words is looked up inside the row, and a document moves as one array. A longer
    one is joined as a table: within the limit it is broadcast, beyond it is shuffled with its most frequent
    words served separately. Rows with the same key are one document, their words merged by place.
    """
    keys = document_keys(docs)
    listed = words.select("word").distinct()
    few = [r["word"] for r in listed.limit(INLINE_WORDS + 1).collect()]
    if len(few) <= INLINE_WORDS:
        stops = [w for w in few if w is not None]
        kept = F.transform("tokens", lambda w: F.when(~w.isin(stops), w))
        rows = docs.select(*keys, kept.alias("kept")).groupBy(*keys).agg(F.collect_list("kept").alias("rows"))

        def placed(tokens):
            return F.filter(F.transform(tokens, lambda w, i: F.struct(i.alias("pos"), w.alias("word"))), lambda e: e["word"].isNotNull())

        merged = F.transform(F.sort_array(F.flatten(F.transform("rows", placed))), lambda e: e["word"])
        only = F.filter(F.get("rows", F.lit(0)), lambda w: w.isNotNull())
        none = F.array().cast("array<string>")
        return rows.select(*keys, F.when(F.size("rows") > 1, merged).otherwise(F.coalesce(only, none)).alias("tokens"))
    rows = docs.select(*keys, F.posexplode_outer("tokens").alias("pos", "word"))
    marked = lookup(rows, listed.withColumn("__stop", F.lit(True)), key="word")
    entry = F.when(F.col("word").isNotNull() & F.col("__stop").isNull(), F.struct("pos", "word"))
    gathered = marked.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    return gathered.select(*keys, F.transform("entries", lambda e: e["word"]).alias("tokens"))


def keep_words(docs: DataFrame, words: DataFrame) -> DataFrame:
    """(domain, word, hits): occurrences of each domain's listed words in its documents."""
    # The lists are joined first: words on no list leave their task uncounted.
    rows = docs.select("domain", F.explode_outer("tokens").alias("word")).filter(F.col("word").isNotNull())
    lists = words.distinct()
    small = broadcast_if_small(lists)
    listed = rows.join(lists if small is None else small, ["domain", "word"])
    return listed.groupBy("domain", "word").agg(F.count(F.lit(1)).alias("hits"))
