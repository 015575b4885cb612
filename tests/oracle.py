"""Compare a query with its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    return x


def difference(df, con, sql: str) -> str:
    """Empty if both give the same columns and rows."""
    rel = con.sql(sql)
    names = sorted(df.columns)
    if names != sorted(rel.columns):
        return f"columns {names} and {sorted(rel.columns)}"
    a = sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
    at = [rel.columns.index(c) for c in names]
    b = sorted(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())
    if a != b:
        only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
        return f"{len(a)} and {len(b)} rows; only Spark {only_a}; only SQL {only_b}"
    return ""
