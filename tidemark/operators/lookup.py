"""Joining term rows with a table keyed by term."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import BROADCAST_ROWS, broadcast_if_small


def lookup(
    rows: DataFrame,
    table: DataFrame,
    key: str = "term",
    how: str = "left",
    bound: int | None = None,
    limit: int = BROADCAST_ROWS,
    frequent: int = 10_000,
) -> DataFrame:
    """Join ``rows`` with ``table`` (one row per key) without a hot key in any task.

    A table within the limit is broadcast. Beyond it, the ``frequent`` most common keys of
    ``rows`` are served by a broadcast of just those entries, and only the remaining keys are
    shuffled: each of them holds at most 1/frequent of the rows, so no task gets a large
    share. Rows without a key (documents without terms) stay out of that shuffle too.
    """
    small = broadcast_if_small(table, bound, limit)
    if small is not None:
        return rows.join(small, key, how)
    common = (
        rows.filter(F.col(key).isNotNull())
        .groupBy(key)
        .count()
        .orderBy(F.desc("count"), key)
        .limit(frequent)
        .select(key, F.lit(True).alias("__common"))
    )
    common_entries = table.join(F.broadcast(common.select(key)), key, "left_semi")
    marked = rows.join(F.broadcast(common), key, "left")
    here = F.col("__common").isNotNull() | F.col(key).isNull()
    served = marked.filter(here).drop("__common").join(F.broadcast(common_entries), key, how)
    shuffled = marked.filter(~here).drop("__common").join(table, key, how)
    return served.unionByName(shuffled)
