"""Compare a query with its SQL on the same parquet files, ignoring row order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

DATA = Path("/root/testdata")


def connect(folder: Path) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in sorted(folder.glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b)) or abs(a - b) < 2e-6
    return a == b and type(a) is type(b)


def difference(df, con, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    found = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    wanted = rows_of([d[0] for d in result.description], result.fetchall())
    if found[0] != wanted[0]:
        return f"columns {found[0]} != {wanted[0]}"
    if len(found[1]) != len(wanted[1]):
        return f"{len(found[1])} rows, expected {len(wanted[1])}; first {found[1][:2]} / {wanted[1][:2]}"
    bad = [(a, b) for a, b in zip(found[1], wanted[1]) if not all(map(same, a, b))]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None
