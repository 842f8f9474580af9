"""INSERT, UPDATE, DELETE as frames of the table's next version.

Parquet files are immutable, so each returns the rows after the change; `commit_version` writes
them as a new version directory, and readers follow the highest committed version.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.catalog import duplicate_keys


def insert_select(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Append by position, cast to the target's types."""
    if len(rows.columns) != len(target.columns):
        raise ValueError(f"{len(rows.columns)} values for {len(target.columns)} columns")
    named = rows.toDF(*target.columns)
    return target.unionByName(named.select(*[F.col(f.name).cast(f.dataType) for f in target.schema.fields]))


def insert_rows(spark: SparkSession, target: DataFrame, rows: Sequence[Sequence[object]]) -> DataFrame:
    """INSERT ... VALUES."""
    return insert_select(target, spark.createDataFrame([tuple(r) for r in rows], target.schema))


def delete_where(target: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is false or NULL stay."""
    return target.where(~F.coalesce(predicate, F.lit(False)))


def update_where(target: DataFrame, values: Mapping[str, Column], predicate: Column) -> DataFrame:
    """New values where the predicate is true; all are computed from the old row."""
    types = {f.name: f.dataType for f in target.schema.fields}
    hit = F.coalesce(predicate, F.lit(False))
    return target.select(*[
        F.when(hit, values[c].cast(types[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in target.columns
    ])


def commit_version(df: DataFrame, path: str, version: int) -> str:
    """Write one version; the commit protocol makes it visible as a whole or not at all."""
    out = f"{path}/version={version:08d}"
    df.write.mode("errorifexists").parquet(out)
    return out


def _committed(spark: SparkSession, path: str) -> list[int]:
    """Versions whose writer has finished, ascending: directories with a success marker, empty tables' too."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        return []
    names = [(s.getPath(), s.getPath().getName()) for s in system.listStatus(root) if s.isDirectory()]
    found = [int(name[8:]) for at, name in names if name.startswith("version=") and system.exists(hadoop.Path(at, "_SUCCESS"))]
    return sorted(found)


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The given version, or the newest committed one; a version without rows is an empty table."""
    found = _committed(spark, path)
    chosen = found[-1] if version is None and found else version
    if chosen not in found:
        raise ValueError(f"no committed version{'' if version is None else f' {version}'} in {path}")
    return spark.read.parquet(f"{path}/version={chosen:08d}")


def insert_unique(target: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """`insert_select` into a table with a unique key; raises if a key would then occur twice."""
    out = insert_select(target, rows)
    if twice := duplicate_keys(out, *keys).take(1):
        raise ValueError(f"duplicate key {tuple(twice[0])[:-1]}")
    return out


def truncate(target: DataFrame) -> DataFrame:
    """The table without rows."""
    return target.limit(0)


def drop_table(spark: SparkSession, path: str) -> bool:
    """Delete all versions; False if there was no table."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)
