"""Catalogue of Parquet tables: registration, schemas and computed statistics."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
#: The derived table.
BRIDGE = "partsupplier"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partsupplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part/supplier bridge, derived from lineitem because the data has no such table."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(
        F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")
    ).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("ps_availqty"))


def register(spark: SparkSession, sf_dir: str, names: Iterable[str] = (*TABLES, BRIDGE)) -> None:
    """Make the tables, and the derived bridge, visible to `spark.sql` as temporary views."""
    for name in names:
        if name != BRIDGE:
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    if BRIDGE in names:
        partsupplier(spark, sf_dir).createOrReplaceTempView(BRIDGE)


def describe(df: DataFrame, unique: tuple[str, ...] = ()) -> dict[str, dict]:
    """Column name -> type, nullability and declared uniqueness; lookups are case-insensitive."""
    return {
        f.name.lower(): {"type": f.dataType.simpleString(), "nullable": f.nullable, "unique": f.name in unique}
        for f in df.schema.fields
    }


def statistics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows, exact distinct values, low and high key per column, in a single aggregation."""
    columns = columns or df.columns
    one = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_distinct(c).alias(f"d_{i}") for i, c in enumerate(columns)],
        *[F.min(c).cast("string").alias(f"lo_{i}") for i, c in enumerate(columns)],
        *[F.max(c).cast("string").alias(f"hi_{i}") for i, c in enumerate(columns)],
    )
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("column_name"), F.col("n").alias("cardinality"), F.col(f"d_{i}").alias("distinct_values"),
            F.col(f"lo_{i}").alias("low_key"), F.col(f"hi_{i}").alias("high_key"),
        )
        for i, c in enumerate(columns)
    ])
    return one.select(F.explode(rows).alias("r")).select("r.*")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that break a declared uniqueness; empty if the constraint holds."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
