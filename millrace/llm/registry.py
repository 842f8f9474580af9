"""The registered queries of the subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, language_id, lm_score, mixing, near_dedup, secret_scan, sharding, token_ids, topk, warc

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(_table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.write_and_index(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write_and_read(_table(spark, sf_dir, "pages"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(_table(spark, sf_dir, "documents"), near_dedup.QUERY_WORDS)


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_sharding, op2_decontaminate, op3_language_id, op4_warc, op5_lm_score, op6_mixing, op7_secret_scan, op8_near_dedup, op9_token_ids, op10_topk)}
ORACLE: dict[str, str] = {
    "op1_sharding": sharding.ORACLE_SQL,
    "op2_decontaminate": decontaminate.ORACLE_SQL,
    "op4_warc": warc.ORACLE_SQL,
    "op6_mixing": mixing.ORACLE_SQL,
    "op8_near_dedup": near_dedup.ORACLE_SQL,
    "op10_topk": topk.ORACLE_SQL,
}
