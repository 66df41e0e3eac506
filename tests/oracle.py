"""Compare Spark query results with DuckDB on the same parquet tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(folder, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, bool):
        return (1, str(int(v)))
    if hasattr(v, "isoformat"):
        return (1, v.isoformat())
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return (1, f"{float(v):.6g}" if abs(float(v)) < 1e15 else repr(float(v)))
    if isinstance(v, int):
        return (1, f"{float(v):.6g}" if abs(v) < 1e5 else str(v))
    return (1, str(v))


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql) -> str:
    """Empty string when equal, else what differs."""
    res = con.execute(sql)
    onames = [d[0] for d in res.description]
    orows = res.fetchall()
    srows = [tuple(r) for r in df.collect()]
    if sorted(df.columns) != sorted(onames):
        return f"columns {sorted(df.columns)} vs {sorted(onames)}"
    if len(srows) != len(orows):
        return f"rows {len(srows)} vs {len(orows)}"
    a, b = rows_of(df.columns, srows), rows_of(onames, orows)
    for x, y in zip(a, b):
        if x != y:
            return f"value {x} vs {y}"
    return "" if srows else "EMPTY"
