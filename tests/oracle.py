"""Compare a query with its SQL on the same tables."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return c


def value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5) + 0.0
    return x


def compare(df, sql: str, c: duckdb.DuckDBPyConnection) -> str | None:
    """None if equal, else what differs."""
    names = sorted(df.columns)
    mine = Counter(tuple(value(r[n]) for n in names) for r in df.collect())
    got = c.execute(sql)
    theirs_names = [d[0] for d in got.description]
    if sorted(theirs_names) != names:
        return f"columns {names} and {sorted(theirs_names)}"
    at = [theirs_names.index(n) for n in names]
    theirs = Counter(tuple(value(r[k]) for k in at) for r in got.fetchall())
    if mine != theirs:
        return f"{sum(mine.values())} and {sum(theirs.values())} rows; only mine {list((mine - theirs).items())[:2]}; only SQL {list((theirs - mine).items())[:2]}"
    return None
