"""Session helpers: local sessions, the shared scratch folder, written tables, size checks."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from multiprocessing.pool import ThreadPool
from typing import TypeVar

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

R = TypeVar("R")

# A side of a join is broadcast only up to this many rows (checked or known beforehand).
BROADCAST_ROWS = 200_000

_LOCAL_SCRATCH: dict[str, str] = {}


def local_session(cpus: int | str = "*", app: str = "tidemark", memory: str = "8g") -> SparkSession:
    """Session for tests and benchmarks; on a cluster the caller passes its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """Folder shared by all executors, as named in ``spark.checkpoint.dir``.

    A local session may lack the setting; it then gets a fresh temporary folder. A cluster
    session without it is refused, because a machine-local folder is not shared.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="tidemark-")
    return _LOCAL_SCRATCH[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call returns."""
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Shuffle files of a query go when it has run, batches of Python functions stay small whatever the rows hold, and parts
# of a union stay apart, also where each is one partition.
WHILE_RUNNING = {
    "spark.sql.unionOutputPartitioning": "false",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}
_RUNNING: dict[int, tuple[int, dict[str, str | None]]] = {}
_LOCK = threading.Lock()


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries that are built and run inside leave no shuffle files behind. Threads may be inside side by side."""
    key = id(spark._jsparkSession)
    with _LOCK:
        depth, before = _RUNNING.get(key, (0, {}))
        if not depth:
            before = {k: spark.conf.get(k, None) for k in WHILE_RUNNING}
            for k, v in WHILE_RUNNING.items():
                spark.conf.set(k, v)
        _RUNNING[key] = depth + 1, before
    try:
        yield
    finally:
        with _LOCK:
            depth, before = _RUNNING.pop(key)
            if depth > 1:
                _RUNNING[key] = depth - 1, before
            else:
                for k, v in before.items():
                    if v is None:
                        spark.conf.unset(k)
                    else:
                        spark.conf.set(k, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Cuts the lineage with a table on shared storage, so a lost executor costs a re-read and
    not a recomputation, later readers can prune columns, and the planner knows the size.
    """
    return written_parts([df], name)


def written_parts(parts: Sequence[DataFrame], name: str, by: Sequence[str] = (), path: str | None = None) -> DataFrame:
    """One table of the rows of all ``parts``, written one after the other: only one has shuffle files at a time.

    Rows lie in folders ``by`` values; ``path`` is the one of a table that they are added to.
    """
    spark = parts[0].sparkSession
    path = path or scratch_path(spark, name)
    with tidy(spark):
        for part in parts:
            part.write.option("compression", "zstd").mode("append").partitionBy(*by).parquet(path)
    out = spark.read.schema(parts[0].schema).parquet(path)
    out.scratch_paths = [path]
    return out


def collected(rows: DataFrame) -> list:
    """Rows of a query that is run once; what it shuffled is gone afterwards."""
    with tidy(rows.sparkSession):
        return rows.select("*").collect()


def drop(*tables: DataFrame) -> None:
    """Delete written tables that no later step reads."""
    for one in tables:
        spark = one.sparkSession
        for name in getattr(one, "scratch_paths", []):
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_table(spark: SparkSession, columns: dict[str, tuple[pa.DataType, list]]) -> DataFrame:
    """Parameter table (folds, word lists) as a local relation whose size the planner knows."""
    schema = pa.schema([(name, kind) for name, (kind, _) in columns.items()])
    table = pa.table({name: values for name, (_, values) in columns.items()}, schema=schema)
    return spark.createDataFrame(table)


def broadcast_if_small(
    df: DataFrame, bound: int | None = None, limit: int = BROADCAST_ROWS
) -> DataFrame | None:
    """``df`` marked for broadcast when it has at most ``limit`` rows, else ``None``.

    ``bound`` is a row count known from how ``df`` was built (a top-k, a fold list); without
    one, at most ``limit + 1`` rows are counted.
    """
    if bound is None:
        bound = df.limit(limit + 1).count()
    return F.broadcast(df) if bound <= limit else None


def spread(df: DataFrame, source: DataFrame, *keys: str | Column) -> DataFrame:
    """Repartition by key when ``source`` has fewer splits than there are cores.

    Small inputs come as one split and would be cleaned by one core. Large ones have more
    splits than cores and are left as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if source.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def fit_partitions(df: DataFrame, rows: int, per_task: int = 20_000) -> DataFrame:
    """Merge partitions that are too small to be worth a task in every optimizer step.

    Iterative fits run one job per step, so on small inputs the task overhead is all there
    is. Partitions that already hold ``per_task`` rows or more are never merged.
    """
    wanted = max(1, -(-rows // per_task))
    return df.coalesce(wanted) if df.rdd.getNumPartitions() > wanted else df


def in_parallel(spark: SparkSession, jobs: Sequence[Callable[[], R]], threads: int = 4) -> list[R]:
    """Run independent fits side by side; Spark shares the executors among their jobs."""
    if len(jobs) <= 1:
        return [job() for job in jobs]
    with ThreadPool(min(threads, len(jobs))) as pool:
        return pool.map(lambda job: inheritable_thread_target(spark)(job)(), jobs)
