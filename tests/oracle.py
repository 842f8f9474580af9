"""Run a query and its SQL side by side and compare them as multisets of rows."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, list):
        return tuple(map(_cell, value))
    return value


def multiset(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def agree(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    got, expected = multiset(df.columns, df.collect()), multiset(names, want.fetchall())
    assert got == expected, f"only here: {list((got - expected).items())[:3]}; only expected: {list((expected - got).items())[:3]}"
