"""Token totals by source, language and tokenizer version, maintained from signed deltas.

A batch is a set of changes (insert, delete, revise). Changes become signed deltas, which are summed
within the batch and written as one folder named by the batch id. The folder counts once Spark has
put its success marker there: an interrupted commit is written again, a repeated one does nothing.
Totals are the sum of the last snapshot and of all later batches; ``compact`` folds batches into a
new snapshot, so that reading stays cheap. Nothing is ever recounted.

Defined results: null sources and languages are groups of their own; a null count is 0; repeated
changes inside one batch all count; groups whose documents and tokens are all gone are not listed;
a null or empty text has 0 tokens. An empty batch commits and changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ship
from tidemark.llm.encoding import encoder, text_slices

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, documents long, tokens long"


def inserted(counts: DataFrame) -> DataFrame:
    """Deltas of new documents (source, lang, tokenizer, tokens)."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("documents"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"))


def deleted(counts: DataFrame) -> DataFrame:
    """Deltas of documents that go, with the counts they came with."""
    return inserted(counts).select(*KEYS, (-F.col("documents")).alias("documents"), (-F.col("tokens")).alias("tokens"))


def revised(changes: DataFrame) -> DataFrame:
    """Deltas of documents counted anew (source, lang, tokenizer, old_tokens, new_tokens)."""
    step = F.coalesce("new_tokens", F.lit(0)) - F.coalesce("old_tokens", F.lit(0))
    return changes.select(*KEYS, F.lit(0).cast("long").alias("documents"), step.cast("long").alias("tokens"))


def summed(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))


class Rollup:
    """Totals below ``path``, a folder that all executors share.

    One writer commits at a time; batch ids are names chosen by the caller (letters, digits, ``-``).
    """

    def __init__(self, spark: SparkSession, path: str):
        ship(spark)
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _committed(self, kind: str) -> list[str]:
        """Names of finished folders of a kind, in name order."""
        root = self._path(f"{self.path}/{kind}")
        if not self._fs.exists(root):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(root)]
        return sorted(n for n in names if self._fs.exists(self._path(f"{self.path}/{kind}/{n}/_SUCCESS")))

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Add a batch of signed deltas once; False if the batch was there already."""
        if batch_id in self._committed("batches") or batch_id in self._folded():
            return False
        summed(deltas).write.mode("overwrite").parquet(f"{self.path}/batches/{batch_id}")
        return True

    def _snapshot(self) -> str | None:
        names = self._committed("snapshots")
        return names[-1] if names else None

    def _folded(self) -> set[str]:
        """Ids of the batches that the last snapshot contains."""
        last = self._snapshot()
        if last is None:
            return set()
        rows = self.spark.read.parquet(f"{self.path}/snapshots/{last}/batch_ids").collect()
        return {r["batch_id"] for r in rows}

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens) after all committed batches."""
        last, folded = self._snapshot(), self._folded()
        paths = [f"{self.path}/batches/{b}" for b in self._committed("batches") if b not in folded]
        if last is not None:
            paths.append(f"{self.path}/snapshots/{last}/totals")
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        found = summed(self.spark.read.schema(SCHEMA).parquet(*paths))
        return found.filter((F.col("documents") != 0) | (F.col("tokens") != 0))

    def compact(self) -> None:
        """Fold all committed batches into a new snapshot."""
        ids = sorted(self._folded() | set(self._committed("batches")))
        number = len(self._committed("snapshots"))
        name = f"{number:08d}"
        self.totals().write.mode("overwrite").parquet(f"{self.path}/snapshots/{name}/totals")
        rows = self.spark.createDataFrame([(i,) for i in ids], "batch_id string")
        rows.write.mode("overwrite").parquet(f"{self.path}/snapshots/{name}/batch_ids")
        # The snapshot counts from here on.
        self._fs.create(self._path(f"{self.path}/snapshots/{name}/_SUCCESS"), True).close()


def pattern_counts(text: Column, patterns: dict[str, str]) -> list[Column]:
    """Tokens of a text under tokenizers that are given as patterns."""
    return [F.coalesce(F.regexp_count(text, F.lit(p)), F.lit(0)).cast("long").alias(name) for name, p in patterns.items()]


def tokenizer_count(path: str) -> Column:
    """Tokens of column ``text`` under a tokenizer file that every executor has at ``path``."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        import pyarrow as pa

        parts = [np.diff(encoder(path).encode(part)[1]) for _, part in text_slices(pa.array(texts, pa.string()))]
        return pd.Series(np.concatenate(parts) if parts else [], dtype="int64")

    return count(F.coalesce("text", F.lit("")))


def by_tokenizer(counted: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per document and tokenizer from one count column per tokenizer."""
    each = F.array(*[F.struct(F.lit(n).alias("tokenizer"), F.col(n).alias("tokens")) for n in names])
    return counted.select("source", "lang", F.explode(each).alias("t")).select("source", "lang", "t.*")


def distinct_only(counted: DataFrame, content: str, names: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Deltas that remove all but the first copy of each content: everything out, first copies in.

    Sums and one minimum per content, so copies are never gathered or joined.
    """
    first = counted.groupBy(content).agg(F.min(F.struct("doc_id", "source", "lang", *names)).alias("kept")).select("kept.*")
    return deleted(by_tokenizer(counted, names)), inserted(by_tokenizer(first, names))
