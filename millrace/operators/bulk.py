"""Bulk-job operators: split control and pass-through. Stages are lazy, nothing is materialised between them."""

from __future__ import annotations

from pyspark.sql import DataFrame


def splits(df: DataFrame, n: int) -> DataFrame:
    """The same rows in n partitions."""
    return df.repartition(n)


def identity(df: DataFrame) -> DataFrame:
    return df.select("*")


def forward_left(left: DataFrame, right: DataFrame) -> DataFrame:
    """Only the rows of the first input."""
    return left.select("*")
