"""Grouping with 0..n keys, HAVING on output aliases, and the tuple count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import Agg


def group_aggregate(df: DataFrame, keys: Sequence[str], aggs: Sequence[Agg], having: Column | None = None) -> DataFrame:
    """Without keys the result is one row, even over no input; with keys, one row per group.

    NULL keys form one group. `having` filters on the output columns and needs keys.
    """
    if having is not None and not keys:
        raise ValueError("HAVING needs GROUP BY")
    columns = [a.to_column(df, empty_zero=not keys) for a in aggs]
    if keys and not columns:
        out = df.select(*keys).distinct()
    else:
        out = df.groupBy(*keys).agg(*columns) if keys else df.agg(*columns)
    return out if having is None else out.where(having)


def count_tuples(df: DataFrame, alias: str = "n") -> DataFrame:
    """Row count: partial counts per partition, then one sum."""
    return df.agg(F.count(F.lit(1)).alias(alias))
