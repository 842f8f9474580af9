"""Delimited text source and sink whose fields go through the typed text codecs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs


def read_text_table(spark: SparkSession, path: str, columns: dict[str, str], sep: str = "|") -> DataFrame:
    """Read with declared types (`int`, `char(10)`, `time`, ...); no inference, a bad field raises."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    raw = spark.read.schema(schema).csv(path, sep=sep, nullValue="NULL", emptyValue="")
    return raw.select(*[codecs.parse(F.col(f"`{c}`"), kind).alias(c) for c, kind in columns.items()])


def write_text_table(df: DataFrame, path: str, columns: dict[str, str], sep: str = "|") -> None:
    out = df.select(*[codecs.render(F.col(f"`{c}`"), kind).alias(c) for c, kind in columns.items()])
    out.write.mode("overwrite").csv(path, sep=sep, nullValue="NULL", emptyValue="")
