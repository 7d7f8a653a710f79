"""The corpus table (domain, doc_id, raw_text, label), read from ``documents`` and ``labels``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import spread

DOMAINS = ("d0", "d1", "d2", "d3", "d4")
CLASSES = (0, 1)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def domain_of(source):
    """Five domains out of the source names src0, src1, ..."""
    return F.concat(F.lit("d"), (F.substring(source, 4, 10).cast("int") % 5).cast("string"))


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents. The join runs on the key, each document has at most one label."""
    documents = read_table(spark, folder, "documents").select("doc_id", "text", "source")
    labels = read_table(spark, folder, "labels").select("doc_id", "quality")
    rows = documents.join(labels, "doc_id").select(
        domain_of(F.col("source")).alias("domain"),
        "doc_id",
        F.coalesce("text", F.lit("")).alias("raw_text"),
        F.col("quality").cast("int").alias("label"),
    )
    return spread(rows, documents, "doc_id")


def all_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every document, labelled or not."""
    documents = read_table(spark, folder, "documents").select("doc_id", "text", "source")
    rows = documents.select(
        domain_of(F.col("source")).alias("domain"),
        "doc_id",
        F.coalesce("text", F.lit("")).alias("raw_text"),
    )
    return spread(rows, documents, "doc_id")


def write_corpus(df: DataFrame, path: str) -> None:
    """Store the corpus with one folder per domain, so that fold filters prune whole folders.

    Rows are not gathered by domain first: one domain may hold a third of them.
    """
    df.write.partitionBy("domain").parquet(path)
