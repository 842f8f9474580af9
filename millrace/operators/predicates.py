"""Predicates as Column expressions. A NULL operand never satisfies a predicate."""

from __future__ import annotations

import operator
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARISONS = {
    "=": operator.eq, "<>": operator.ne, "<": operator.lt,
    "<=": operator.le, ">": operator.gt, ">=": operator.ge,
}
INVERSE = {"=": "<>", "<>": "=", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}
SWITCHED = {"=": "=", "<>": "<>", "<": ">", ">": "<", "<=": ">=", ">=": "<="}


def compare(column: str | Column, op: str, literal: object) -> Column:
    """column op literal."""
    return COMPARISONS[op](F.col(column) if isinstance(column, str) else column, F.lit(literal))


def join_compare(left: str | Column, op: str, right: str | Column) -> Column:
    """column op column, of two inputs or of one."""
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return COMPARISONS[op](as_col(left), as_col(right))


def between(column: str | Column, low: object, high: object, low_included: bool = True, high_included: bool = True) -> Column:
    """A two-sided range; a bound of None leaves that side open."""
    parts = []
    if low is not None:
        parts.append(compare(column, ">=" if low_included else ">", low))
    if high is not None:
        parts.append(compare(column, "<=" if high_included else "<", high))
    return conjunction(parts)


def conjunction(factors: Sequence[Column]) -> Column:
    return reduce(operator.and_, factors, F.lit(True)) if not factors else reduce(operator.and_, factors)


def disjunction(factors: Sequence[Column]) -> Column:
    return F.lit(False) if not factors else reduce(operator.or_, factors)


def invert(op: str) -> str:
    """The comparison that holds exactly when `op` doesn't (on non-NULL values)."""
    return INVERSE[op]


def switch_sides(op: str) -> str:
    """The comparison that holds for (b, a) exactly when `op` holds for (a, b)."""
    return SWITCHED[op]
