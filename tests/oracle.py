"""Comparing a query with its SQL, as multisets of rows."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def connect(d: str = DATA):
    c = duckdb.connect()
    for f in sorted(os.listdir(d)):
        if f.endswith(".parquet"):
            path = os.path.join(d, f)
            path = path + "/*.parquet" if os.path.isdir(path) else path
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{path}'")
    return c


def plain(x):
    if isinstance(x, (bytearray, bytes)):
        return bytes(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(plain(i) for i in x)
    return x


def rows_of(df) -> Counter:
    cols = sorted(df.columns)
    return Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())


def compare(spark, fn, sql: str, d: str = DATA, con=None) -> tuple[int, int, int]:
    """(rows, missing, surplus)."""
    df = fn(spark, d)
    got = rows_of(df)
    r = (con or connect(d)).sql(sql)
    order = sorted(range(len(r.columns)), key=lambda i: r.columns[i])
    assert sorted(r.columns) == sorted(df.columns), (r.columns, df.columns)
    want = Counter(tuple(plain(row[i]) for i in order) for row in r.fetchall())
    return sum(got.values()), sum((want - got).values()), sum((got - want).values())
