"""COUNT, SUM, AVG, MIN, MAX with the engine's documented result types.

* SUM over no rows is 0 in a global aggregate (`empty_zero`), as grouped input never is empty.
* AVG of an integral column is integral and truncates towards zero.
* COUNT and SUM widen to BIGINT instead of wrapping. NULLs are ignored, as in SQL.
* Sums of fractional columns run on DECIMAL(38,2) if `exact_scale` is given, so that the result
  doesn't depend on the order in which partitions are added.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FUNCTIONS = ("count", "sum", "avg", "min", "max")


@dataclass(frozen=True)
class Agg:
    """One aggregate: `Agg("sum", "o_totalprice", "total", exact_scale=2)`."""

    function: str
    column: str
    alias: str
    exact_scale: int | None = None

    def __post_init__(self) -> None:
        if self.function not in FUNCTIONS:
            raise ValueError(f"unknown aggregate {self.function!r}; there are {FUNCTIONS}")

    def to_column(self, df: DataFrame, empty_zero: bool) -> Column:
        if self.function == "count":
            return F.count(F.lit(1) if self.column == "*" else F.col(self.column)).alias(self.alias)
        value, integral = F.col(self.column), isinstance(df.schema[self.column].dataType, T.IntegralType)
        if self.exact_scale is not None:
            value = value.cast(f"decimal(18,{self.exact_scale})")
        if self.function == "sum":
            out = F.sum(value)
            out = out.cast("double") if self.exact_scale is not None else out
            return (F.coalesce(out, F.lit(0).cast("bigint" if integral else "double")) if empty_zero else out).alias(self.alias)
        if self.function == "avg":
            total, n = F.sum(value), F.count(value)
            if integral:
                return F.call_function("div", total, F.nullif(n, F.lit(0))).alias(self.alias)
            return (total.cast("double") / F.nullif(n, F.lit(0))).alias(self.alias)
        return (F.min if self.function == "min" else F.max)(F.col(self.column)).alias(self.alias)
