"""Inner joins. A NULL key never matches, whatever strategy runs the join."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .predicates import conjunction

#: A side is broadcast on request only if the planner's size estimate is within this.
BROADCAST_LIMIT_BYTES = 64 << 20


def planned_bytes(df: DataFrame) -> int:
    """The optimizer's upper estimate of a frame's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _equal(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]]) -> Column:
    return conjunction([left[a] == right[b] for a, b in keys])


def inner_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], extra: Column | None = None) -> DataFrame:
    """Equi-join on one or more keys, with an optional further condition; strategy left to Spark."""
    condition = _equal(left, right, keys)
    return left.join(right, condition if extra is None else condition & extra, "inner")


def merge_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]]) -> DataFrame:
    """Equi-join that is run as a sort-merge join; duplicates on both sides multiply."""
    return left.join(right.hint("merge"), _equal(left, right, keys), "inner")


def index_join(outer: DataFrame, inner: DataFrame, outer_key: str, inner_key: str, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Look each outer row up in `inner`: by a broadcast hash table if `inner` is known to be small,
    else by a shuffled join."""
    small = planned_bytes(inner) <= limit
    return inner_join(outer, F.broadcast(inner) if small else inner, [(outer_key, inner_key)])


def theta_join(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """Join on any condition; without an equality in it this compares all pairs."""
    return left.join(right, condition, "inner")


def cross_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """The Cartesian product, as asked for; meant for small inputs."""
    return left.crossJoin(right)


def correlated_filter(inner: DataFrame, outer: DataFrame, condition: Column) -> DataFrame:
    """Rows of `inner` for each row of `outer` for which the condition over both holds."""
    return outer.join(inner, condition, "inner")


def multiway_join(first: DataFrame, *rest: tuple[DataFrame, Column]) -> DataFrame:
    """A left-deep chain; the optimizer may reorder it."""
    return reduce(lambda done, step: done.join(step[0], step[1], "inner"), rest, first)
