"""Compares a Spark result with SQL run by DuckDB on the same tables."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else round(v, 9) + 0.0
    return v


def rows(columns, data) -> Counter:
    return Counter(str(tuple(_plain(x) for x in r)) for r in data)


def check(df, sql: str, folder: str) -> None:
    names = sorted(df.columns)
    got = rows(names, ([r[c] for c in names] for r in df.select(*names).collect()))
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = connection.sql(sql)
    assert sorted(found.columns) == names
    at = [found.columns.index(c) for c in names]
    want = rows(names, ([r[i] for i in at] for r in found.fetchall()))
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
