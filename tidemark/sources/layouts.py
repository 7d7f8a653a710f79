"""CSV readers for the five review layouts, each giving (domain, doc_id, raw_text, label).

Schemas are explicit: inferring them would cost a further pass over the file. Fields follow
the quoting of RFC 4180 (a quote inside a field is doubled, line breaks may occur in it).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.labels import code_of, map_values
from tidemark.operators.ordering import encode_values
from tidemark.session import written


def read_headered(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header line; the header must name the schema's columns in order."""
    return (
        spark.read.schema(schema)
        .options(header=True, multiLine=True, quote='"', escape='"', enforceSchema=False)
        .csv(path)
    )


def read_positional(
    spark: SparkSession, path: str, schema: T.StructType | str, needed: int | None = None
) -> DataFrame:
    """CSV without a header; columns are taken by position and named by the schema."""
    reader = spark.read.options(header=False, multiLine=True, quote='"', escape='"')
    if needed is not None:
        # Without a schema the columns are those of the file's first record.
        found = len(reader.csv(path).columns)
        if found < needed:
            raise ValueError(f"{path}: {found} columns, at least {needed} are needed")
    return spark.read.schema(schema).options(header=False, multiLine=True, quote='"', escape='"').csv(path)


@dataclass(frozen=True)
class Layout:
    """How one domain's file becomes corpus rows."""

    schema: str
    text: str
    header: bool
    label: str
    keep: tuple[str, ...] = ()
    classes: tuple[str, ...] = ()
    mapping: Mapping[int, int] = field(default_factory=dict)
    encode: bool = False
    needed: int | None = None

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        if self.header:
            return read_headered(spark, path, self.schema)
        return read_positional(spark, path, self.schema, self.needed)

    def corpus(self, raw: DataFrame, domain: str, key: Callable[[], Column] | None = None) -> DataFrame:
        """Filter, label and key the rows of one domain.

        Files carry no key, so by default every row gets a number of its own; equal rows stay
        two documents. The numbers hold only once the result is written (``load_corpus`` does
        that), because a second read may number the rows in another way. Pass ``key`` where the
        data has one.
        """
        df = raw.filter(F.col(self.label).isin(*self.keep)) if self.keep else raw
        if self.classes:
            df = df.withColumn("__label", code_of(F.col(self.label), self.classes))
        elif self.encode:
            df = encode_values(df, self.label, "__label").withColumn("__label", F.col("__label").cast("int"))
        elif self.mapping:
            df = df.withColumn("__label", map_values(F.col(self.label), self.mapping))
        else:
            df = df.withColumn("__label", F.col(self.label).cast("int"))
        doc_id = key() if key else F.monotonically_increasing_id()
        return df.select(
            F.lit(domain).alias("domain"),
            doc_id.cast("bigint").alias("doc_id"),
            F.coalesce(F.col(self.text), F.lit("")).alias("raw_text"),
            F.col("__label").alias("label"),
        )


# The five input layouts.
LAYOUTS: dict[str, Layout] = {
    "imdb": Layout("review string, sentiment string", "review", True, "sentiment", encode=True),
    "spotify": Layout("Review string, label string", "Review", True, "label", encode=True),
    "rotten_tomatoes": Layout("text string, label int", "text", True, "label"),
    "twitter": Layout(
        "_c0 string, _c1 string, _c2 string, _c3 string",
        "_c3",
        False,
        "_c2",
        keep=("Positive", "Negative"),
        classes=("Positive", "Negative"),
        needed=4,
    ),
    "amazon": Layout("_c0 int, _c1 string, _c2 string", "_c2", False, "_c0", mapping={1: 0, 2: 1}, needed=3),
}


def load_corpus(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """One corpus table out of the files of several domains (domain name -> path).

    It is written once, with the row numbers its documents keep from here on.
    """
    out = None
    for domain, path in paths.items():
        layout = LAYOUTS[domain]
        part = layout.corpus(layout.read(spark, path), domain)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no domain given")
    return written(out, "corpus")
