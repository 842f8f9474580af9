"""Scans, index accesses and projections.

There is no index object: ranges and equalities become filters that reach the Parquet reader,
where row-group statistics skip data. Sort or cluster a table by the key to make that effective.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .predicates import between, compare, conjunction


def filter_rows(df: DataFrame, predicate: Column) -> DataFrame:
    return df.where(predicate)


def project(df: DataFrame, columns: Sequence[str | tuple[str, str]]) -> DataFrame:
    """Select, reorder, repeat and rename: `["a", ("a", "a_again")]`."""
    return df.select(*[F.col(c) if isinstance(c, str) else F.col(c[0]).alias(c[1]) for c in columns])


def table_scan(df: DataFrame, columns: Sequence[str | tuple[str, str]], predicates: Sequence[Column] = ()) -> DataFrame:
    """Rows that satisfy all predicates (which may use columns that aren't produced), projected."""
    return project(df.where(conjunction(predicates)) if predicates else df, columns)


def index_range(
    df: DataFrame, key: str, low: object = None, high: object = None, low_included: bool = True, high_included: bool = True
) -> DataFrame:
    """Rows with the key in a range; each bound is open, closed or absent."""
    return df.where(between(key, low, high, low_included, high_included) & F.col(key).isNotNull())


def index_lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    """Rows with this key."""
    return df.where(compare(key, "=", value))


def index_scan(df: DataFrame, key: str, low: object = None, high: object = None, low_included: bool = True, high_included: bool = True, ordered: bool = False) -> DataFrame:
    """The key values of a range, one per row, so duplicates stay; in key order if asked for."""
    keys = index_range(df, key, low, high, low_included, high_included).select(key)
    return keys.orderBy(key) if ordered else keys
