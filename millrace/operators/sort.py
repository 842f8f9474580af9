"""Multi-key sort; NULL is the lowest value, first in ascending and last in descending order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sort(df: DataFrame, keys: Sequence[tuple[str, bool]]) -> DataFrame:
    """`keys` are (column, ascending). Runs as a range-partitioned external sort."""
    return df.orderBy(*[F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in keys])
