"""Comparison of a Spark result with DuckDB's on the same tables."""

from __future__ import annotations

import datetime
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return 0.0 if v == 0 else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str) -> str:
    """Empty if both have the same columns and the same rows, any order."""
    got = rows_of(df.columns, df.collect())
    con.execute(sql)
    names = [d[0] for d in con.description]
    want = rows_of(names, con.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)}, expected {sorted(names)}"
    if got != want:
        return f"{sum(got.values())} rows, expected {sum(want.values())}; only here {list((got - want).elements())[:2]}; only expected {list((want - got).elements())[:2]}"
    return ""
