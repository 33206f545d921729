"""Run one registered query on Spark and its SQL on DuckDB and compare the rows."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, float):
        return (2, "nan") if math.isnan(v) else (2, f"{v:.9g}")
    if isinstance(v, int):
        return (3, str(v))
    if isinstance(v, (list, tuple)):
        return (4, str([_norm(x) for x in v]))
    return (5, f"{type(v).__name__}:{v}")


def mismatch(df, con, sql: str) -> str | None:
    """None if equal, else a short description of the first difference."""
    rel = con.sql(sql)
    if sorted(rel.columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(rel.columns)}"
    cols = sorted(df.columns)
    mine = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    idx = [rel.columns.index(c) for c in cols]
    theirs = sorted(tuple(_norm(r[i]) for i in idx) for r in rel.fetchall())
    if len(mine) != len(theirs):
        return f"rows {len(mine)} vs {len(theirs)}; only spark {list(set(mine)-set(theirs))[:2]} only duck {list(set(theirs)-set(mine))[:2]}"
    if mine != theirs:
        bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
        return f"{len(bad)} of {len(mine)} rows differ, cols {cols}: {bad[0]}"
    if not mine:
        return "both empty"
    return None
