"""Writers and readers for predictions, metrics and score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_by_fold(df: DataFrame, path: str, form: str = "csv") -> None:
    """One folder per fold. CSV carries a header, as the downstream readers expect."""
    writer = df.write.partitionBy("fold")
    if form == "csv":
        writer.options(header=True, quote='"', escape='"').csv(path)
    elif form == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown form {form!r}")


def write_sample(df: DataFrame, path: str) -> None:
    """A sample is a handful of rows: one file."""
    df.coalesce(1).write.options(header=True, quote='"', escape='"').csv(path)


def read_scores(
    spark: SparkSession,
    path: str,
    methods: Sequence[str],
    key: str = "dataset",
    drop: Sequence[str] = (),
    field: int | None = None,
) -> DataFrame:
    """Score matrix (rows are datasets, columns are methods) in long form.

    ``drop`` names trailing columns to leave out. ``field`` picks one entry, counted from 0,
    of cells that hold several values separated by semicolons.
    """
    columns = [key, *methods, *drop]
    schema = ", ".join(f"`{c}` string" for c in columns)
    wide = spark.read.schema(schema).options(header=True, quote='"', escape='"').csv(path)
    long = wide.select(key, *methods).unpivot([key], list(methods), "method", "cell")
    cell = F.col("cell") if field is None else F.element_at(F.split("cell", ";"), field + 1)
    return long.select(F.col(key).alias("dataset"), "method", F.trim(cell).cast("double").alias("score"))
