"""Spark results against DuckDB's: rows as a multiset, columns by name."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

from lexspark.session import TABLES


def plain(value):
    """A value that compares alike from both engines."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, int):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """A connection with the input tables as views."""
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def differences(spark_df, con, sql: str) -> str:
    """What differs; empty if nothing."""
    names = sorted(spark_df.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in spark_df.collect())
    result = con.execute(sql)
    theirs = [d[0] for d in result.description]
    if sorted(theirs) != names:
        return f"columns {names} against {sorted(theirs)}"
    order = [theirs.index(c) for c in names]
    want = Counter(tuple(plain(row[i]) for i in order) for row in result.fetchall())
    if got == want:
        return ""
    return f"{sum(got.values())} rows against {sum(want.values())}; only ours {list((got - want).items())[:3]}; only theirs {list((want - got).items())[:3]}"
