"""What the operators share: reading tables, written tables with clean-up, word patterns."""

from __future__ import annotations

import ctypes
import gc
import shutil
import tempfile
from collections.abc import Iterable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch_path

# Words between ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"

# While a table is written, its shuffle files go when it is done, and batches of Python functions
# stay small whatever the rows hold.
WHILE_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent.parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name)
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def release() -> None:
    """Give memory that a task no longer uses back to the system; its worker lives on."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


class Scratch:
    """Tables an operator writes to the shared folder and drops once a later one replaces them.

    A written table cuts the lineage: a lost executor costs a re-read. The shuffle files behind
    a finished table are of no further use, so they are removed with the job that used them.
    """

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark = spark

    def write(self, df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
        path = scratch_path(self.spark, name)
        before = {key: self.spark.conf.get(key) for key in WHILE_WRITING}
        for key, value in WHILE_WRITING.items():
            self.spark.conf.set(key, value)
        try:
            df.write.options(compression="zstd", **(options or {})).parquet(path)
        finally:
            for key, value in before.items():
                self.spark.conf.set(key, value)
        back = self.spark.read.schema(df.schema).parquet(path)
        back.scratch_path = path
        return back

    def drop(self, tables: Iterable[DataFrame]) -> None:
        """Delete tables written here that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        for one in tables:
            path = jvm.org.apache.hadoop.fs.Path(one.scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
