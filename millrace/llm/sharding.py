"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a prime-sized table: slot
(offset + j * skip) mod size for j = 0, 1, ..., with offset and skip from a hash of its name. The
shards take turns, each claiming the first slot of its order that is still free, until the table is
full. So shards differ by at most one slot, and adding or removing a shard moves few keys besides
its own. A key's slot is a hash of the key, so placement is one lookup in the broadcast table, whose
size is a parameter and doesn't depend on the data.

Defined cases: a null id is placed by its text, and with a null text too, as the empty key. Repeated
rows go to the same shard. Empty input gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, id_hash

SHARDS = 16
#: Slots for each shard, at least; shares of slots then differ by less than one per cent.
SLOTS_PER_SHARD = 128


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def next_prime(n: int) -> int:
    while n < 2 or any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def table_size(n_shards: int) -> int:
    return next_prime(SLOTS_PER_SHARD * n_shards)


def preference(name: str, size: int) -> tuple[int, int]:
    """Offset and skip of a shard's order; as the size is prime, any skip visits every slot."""
    return _hash(name) % size, _hash(f"{name}:skip") % (size - 1) + 1


def lookup_table(names: Sequence[str], size: int) -> list[int]:
    """Slot -> index of the shard that claimed it."""
    if not 0 < len(names) <= size or next_prime(size) != size:
        raise ValueError("the table's size must be a prime, no less than the number of shards")
    owner, free = [-1] * size, size
    walks = [preference(name, size) for name in names]
    while free:
        for shard, (slot, skip) in enumerate(walks):
            if not free:
                break
            while owner[slot] >= 0:
                slot = (slot + skip) % size
            owner[slot] = shard
            walks[shard] = ((slot + skip) % size, skip)
            free -= 1
    return owner


def shard_names(n_shards: int) -> list[str]:
    return [f"shard-{i}" for i in range(n_shards)]


def _table(spark: SparkSession, n_shards: int) -> tuple[DataFrame, int]:
    size = table_size(n_shards)
    owner = lookup_table(shard_names(n_shards), size)
    return spark.createDataFrame(list(enumerate(owner)), "__slot int, __shard int"), size


def assign(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """doc_id, slot, shard for every row."""
    table, size = _table(docs.sparkSession, n_shards)
    slots = docs.select("doc_id", (id_hash() % size).cast("int").alias("slot"))
    return slots.join(F.broadcast(table), F.col("slot") == F.col("__slot")).select("doc_id", "slot", F.col("__shard").alias("shard"))


def with_shard(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """All columns and rows, with `shard` added (a column of that name is replaced)."""
    table, size = _table(docs.sparkSession, n_shards)
    keyed = docs.withColumn("__at", (id_hash() % size).cast("int"))
    placed = keyed.join(F.broadcast(table), F.col("__at") == F.col("__slot"))
    return placed.select(*columns(docs, without="shard"), F.col("__shard").alias("shard"))


def _oracle(n_shards: int) -> str:
    size = table_size(n_shards)
    number = lambda text: f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"
    return f"""
WITH RECURSIVE prefs AS (
  SELECT list({number("'shard-' || s")} % {size} ORDER BY s) AS offs,
         list({number("'shard-' || s || ':skip'")} % {size - 1} + 1 ORDER BY s) AS skips
  FROM range({n_shards}) t(s)),
walk AS (SELECT list(o ORDER BY s) AS orders FROM (
  SELECT s, list_transform(range({size}), lambda j: (offs[s + 1] + j * skips[s + 1]) % {size}) AS o FROM prefs, range({n_shards}) t(s)) w),
fill AS (
  SELECT 0 AS n, list_transform(range({size}), lambda j: -1) AS owner
  UNION ALL
  SELECT n + 1, list_concat(list_concat(owner[1:slot], [n % {n_shards}]), owner[slot + 2:])
  FROM (SELECT n, owner, list_filter(orders[n % {n_shards} + 1], lambda p: owner[p + 1] < 0)[1] AS slot FROM fill, walk WHERE n < {size}) f),
full_table AS (SELECT owner FROM fill WHERE n = {size}),
placed AS (SELECT doc_id, {number("coalesce(CAST(doc_id AS VARCHAR), text, '')")} % {size} AS slot FROM documents)
SELECT doc_id, CAST(slot AS INTEGER) AS slot, CAST(owner[slot + 1] AS INTEGER) AS shard FROM placed, full_table"""


ORACLE_SQL = _oracle(SHARDS)
