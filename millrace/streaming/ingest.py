"""Append-only ingest: the same scan operators over a Parquet directory that keeps growing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.scan import table_scan


def stream_table(spark: SparkSession, path: str, schema: T.StructType, files: str = "*.parquet") -> DataFrame:
    """The directory's present and future files whose names match `files`."""
    return spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(path)


def ingest(stream: DataFrame, columns: Sequence[str], predicates: Sequence[Column], out: str, checkpoint: str) -> StreamingQuery:
    """Filter, project and append all data that is there now, exactly once across restarts."""
    rows = table_scan(stream, columns, predicates)
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
