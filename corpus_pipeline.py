"""Documents to token records: reject toxic texts, keep one of near duplicates, drop benchmark leaks,
mix sources to their weights, write token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each as Parquet and
gives the next one what it reads back. All stages but the last return the columns of their input,
whatever they are called: helper columns live beside the input row, which is carried as one struct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard, mixing, queries, records, toxicity
from tidemark.llm.common import Scratch, table


def _carried(docs: DataFrame, *more) -> DataFrame:
    """The input rows as a struct, next to the columns an operator reads."""
    return docs.select("doc_id", "source", *more, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("carried"))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what scores below 0.5. Null and empty texts stay; each row is judged by its own text."""
    model = queries.toxicity_model(spark, sf_dir, docs.select("doc_id", "text"))
    name = "toxicity"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    scored = toxicity.score_documents(docs, model, name)
    return scored.filter(F.col(f"{name}.score") < 0.5).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document that names each group, its smallest.

    Rows with the same id and text count as one document, of which one stays; different texts of one
    id each stand for their group. Documents without id stay unless their group has one with an id.
    """
    groups = jaccard.jaccard_groups(docs.select("doc_id", "text"))
    heads = groups.filter("doc_id <=> component_id").select(F.col("doc_id").alias("head")).distinct()
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest")
    kept = _carried(docs, digest).join(heads, F.expr("doc_id <=> head"), "left_semi")
    same = Window.partitionBy("doc_id", "digest").orderBy("source")
    return kept.withColumn("copy", F.row_number().over(same)).filter("copy = 1").select("carried.*")


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of ``benchmark``. Null and empty texts stay."""
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in training order, as often as the mix takes them; a visit of less than half is left out.

    Documents without words weigh nothing in the mix and are in none.
    """
    sized = _carried(docs, mixing.word_count(F.col("text")).alias("size"))
    placed = mixing.assign_positions(sized, mixing.cycle_weight, mixing.default_schedule)
    order = mixing.training_order(placed, ["doc_id", "size", "carried"])
    return order.filter(2 * F.col("visit.words") >= F.col("size")).select("carried.*")


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the token ids of every row and return what the files hold, one row per record."""
    return records.encoded_records(spark, docs)


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("mixing", mixed),
    ("token_records", token_records),
]

# Toxicity and near duplicates have no SQL form; tests compare with a brute-force pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result replaces the one before it."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    before = None
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            scratch.drop([before])
        before = docs
    return docs
