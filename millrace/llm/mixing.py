"""Mixing sources to target weights, exactly, by a splitting tree of block quotas.

1. A source's target is its weight's share of all words, at most `MAX_REPEATS` times its size; what is
   above goes to the others by weight until none is above.
2. A source's documents, in the order of a hash, lie end to end on a line that repeats; the mix
   takes the line from 0 to the target. Copies that end within it are taken. The rest, which the
   copy that straddles the target leaves open, is filled in the same order with further copies of
   documents that fit in it, again and again until no document fits, and then one more copy of the
   document that best fills what is left is taken if that is nearer to the target.
3. The line is cut into blocks of equal length; a copy belongs to the block it starts in. The exact
   numbers of blocks per source are divided among the output shards by a tree: each node deals its
   blocks to its two halves by one multivariate hypergeometric draw.
4. A source's blocks are permuted, and each shard draws the next of them, as many as its leaf has:
   the draws are disjoint and use every block. Inside a shard, copies are ordered by a hash.

The prefix sums are taken within (source, hash bucket) groups and then over bucket totals, so a
source that holds most rows isn't gathered anywhere. Only totals per source reach the driver:
sources are a pipeline's configuration, and one is a few hundred bytes there. Above `BROADCAST_SOURCES` of
them, tables of sources are joined by a shuffle.

Defined cases: null or empty text has size 0 and is never taken; a null source is a source; null ids
are ordered by their text; repeated rows are separate documents; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, arrow_map, columns, id_hash, row_key, text_bytes, written

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
#: Sources whose tables are broadcast, at most: a few hundred bytes each.
BROADCAST_SOURCES = 50_000
BLOCK_WORDS = 1 << 14
OUTPUT_SHARDS = 16
SEED = 20240501
#: Groups that a source's hash order is cut into for the prefix sums; 2**48 hashes in each.
BUCKET_SHIFT = 48


def targets(sizes: list[int], weights: list[int]) -> list[float]:
    """Each source's target: weighted shares of the total with a ceiling of MAX_REPEATS times the size."""
    total = sum(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (MAX_REPEATS * sizes[i] / weights[i], i))
    free_words, free_weight, out = total, sum(weights), [0.0] * len(sizes)
    capped = set()
    for i in order:
        cap = MAX_REPEATS * sizes[i]
        if cap * free_weight >= free_words * weights[i]:
            break
        capped.add(i)
        free_words, free_weight = free_words - cap, free_weight - weights[i]
        out[i] = float(cap)
    for i in order:
        if i not in capped:
            out[i] = float(free_words) * weights[i] / free_weight
    return out


def split_quotas(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """[shard, source] block counts: rows have equal totals (within one), columns add up to the quotas."""
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(quotas)), dtype=np.int64)

    def divide(first: int, n: int, blocks: np.ndarray) -> None:
        if n == 1:
            out[first] = blocks
            return
        left, total = n // 2, int(blocks.sum())
        take = total * left // n
        drawn = rng.multivariate_hypergeometric(blocks, take, method="marginals") if total else blocks
        divide(first, left, drawn)
        divide(first + left, n - left, blocks - drawn)

    if len(quotas):
        divide(0, shards, np.asarray(quotas, dtype=np.int64))
    return out


def permutation(n: int, rng: np.random.Generator) -> tuple[int, int]:
    """(a, b) of the bijection i -> (a * i + b) mod n."""
    if n < 2:
        return 1, 0
    a = int(rng.integers(1, n))
    while gcd(a, n) != 1:
        a = a % (n - 1) + 1
    return a, int(rng.integers(0, n))


def same(x: DataFrame, y: DataFrame, *keys: str) -> list:
    return [x[k].eqNullSafe(y[k]) for k in keys]


def bucket_starts(buckets: DataFrame) -> DataFrame:
    """(source, bucket, bucket_start): the words of a source's buckets before each bucket."""
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return buckets.select("source", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("bucket_start"))


def inner_start() -> Column:
    """The words of a row's (source, bucket) before the row."""
    within = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", "__key", "rid").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("size").over(within), F.lit(0))


def filled(line: DataFrame, rests: DataFrame, many: bool) -> DataFrame:
    """(rid, more): for each document that fills a source's rest, the places of its further copies on the line.

    Every round takes the open documents that fit in the rest, in hash order, up to the first that no
    longer fits; at least one per source is taken, until none fits.
    """
    spark = line.sparkSession
    found = None
    state = line.where(F.col("size") > 0).select("source", "bucket", "h", "doc_id", "size", "__key", "rid", "target", F.col("whole").alias("used"))
    while True:
        open_rows = state.join(rests if many else F.broadcast(rests), same(state, rests, "source")).drop(rests["source"])
        open_rows = open_rows.where((F.col("used") < MAX_REPEATS) & (F.col("size") <= F.col("rest")))
        open_rows = written(open_rows, "mix-open")
        starts = bucket_starts(open_rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
        placed = open_rows.withColumn("inner_start", inner_start())
        placed = placed.join(starts, same(placed, starts, "source", "bucket")).drop(starts["source"]).drop(starts["bucket"])
        start = F.col("bucket_start") + F.col("inner_start")
        at = F.when(start + F.col("size") <= F.col("rest"), F.floor(F.col("target") - F.col("rest") + start))
        placed = written(placed.withColumn("at", at), "mix-fill")
        took = placed.groupBy("source").agg(
            F.first("rest").alias("rest"), F.sum(F.when(F.col("at").isNotNull(), F.col("size")).otherwise(0)).alias("words")
        ).collect()
        if not took:
            break
        copies = placed.where(F.col("at").isNotNull()).select("rid", "at")
        found = copies if found is None else found.union(copies)
        rests = spark.createDataFrame([(r["source"], r["rest"] - r["words"]) for r in took], "source string, rest double")
        state = placed.withColumn("used", F.col("used") + F.col("at").isNotNull().cast("int")).drop("rest", "inner_start", "bucket_start", "at")
    if found is None:
        found = spark.createDataFrame([], "rid bigint, at bigint")
    return written(found.groupBy("rid").agg(F.sort_array(F.collect_list("at")).alias("more")), "mix-more")


def plan(docs: DataFrame, shards: int = OUTPUT_SHARDS, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, __key (hash of the whole row)
    and copies, an array of (shard, position within the shard)."""
    spark = docs.sparkSession
    rows = written(
        docs.select(
            "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
            id_hash().alias("h"), row_key(docs).alias("__key"), F.monotonically_increasing_id().alias("rid"),
        ).withColumn("bucket", F.shiftright("h", BUCKET_SHIFT).cast("int")),
        "mix-rows",
    )
    buckets = written(rows.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "mix-buckets")
    found = buckets.groupBy("source").agg(F.sum("words").alias("size")).collect()
    found.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [int(r["size"]) for r in found]
    wanted = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(sizes))])
    quotas = [ceil(t / block_words) for t in wanted]
    leaves, rng = split_quotas(quotas, shards, seed), np.random.default_rng(seed + 1)
    ends = leaves.cumsum(axis=0)
    sources = spark.createDataFrame(
        [(r["source"], s, t, q, *permutation(q, rng), [int(x) for x in ends[:, i]]) for i, (r, s, t, q) in enumerate(zip(found, sizes, wanted, quotas))],
        "source string, source_size bigint, target double, quota bigint, a bigint, b bigint, ends array<bigint>",
    )
    many = len(found) > BROADCAST_SOURCES
    starts = bucket_starts(buckets)
    starts = starts.join(sources if many else F.broadcast(sources), same(starts, sources, "source")).drop(sources["source"])
    line = rows.withColumn("inner_start", inner_start())
    line = line.join(starts, same(line, starts, "source", "bucket")).drop(starts["source"]).drop(starts["bucket"])
    start = F.col("bucket_start") + F.col("inner_start")
    fits = lambda p: (F.col("source_size") * p + start + F.col("size") <= F.col("target")).cast("int")
    whole = sum((fits(p) for p in range(1, MAX_REPEATS)), fits(0))
    line = written(line.withColumn("start", start).withColumn("whole", F.when(F.col("size") > 0, whole).otherwise(0)), "mix-line")
    rest_of = lambda rows, words: rows.groupBy("source").agg((F.first("target") - F.sum(words)).alias("rest"))
    none = F.array().cast("array<bigint>")
    more = filled(line, written(rest_of(line, F.col("whole") * F.col("size")), "mix-rest"), many)
    line = line.join(more.withColumnRenamed("rid", "more_rid"), F.col("rid") == F.col("more_rid"), "left").drop("more_rid")
    line = line.withColumn("more", F.coalesce("more", none))
    used = F.col("whole") + F.size("more")
    rest = rest_of(line, used * F.col("size"))
    gap = F.abs(F.col("rest") - F.col("size"))
    open_rows = line.where((F.col("size") > 0) & (used < MAX_REPEATS))
    best = (
        open_rows.join(rest, same(open_rows, rest, "source")).drop(rest["source"]).where(gap < F.col("rest"))
        .groupBy("source").agg(F.min(F.struct(gap.alias("gap"), "h", "doc_id", "size", "__key", "rid", F.floor(F.col("target") - F.col("rest")).alias("at"))).alias("best"))
        .select(F.col("source").alias("best_source"), F.col("best.rid").alias("best_rid"), F.col("best.at").alias("best_at"))
    )
    line = line.join(best if many else F.broadcast(best), line["source"].eqNullSafe(F.col("best_source")), "left")
    last = F.when(F.col("best_rid") == F.col("rid"), F.array("best_at")).otherwise(none)
    numbers = F.when(F.col("whole") > 0, F.sequence(F.lit(0), F.col("whole") - 1)).otherwise(F.array().cast("array<int>"))
    places = F.concat(F.transform(numbers, lambda p: F.col("source_size") * p + F.col("start")), "more", last)
    line = line.withColumn("places", places)
    position = lambda at: F.least(at.cast("bigint"), (F.col("quota") * block_words - 1).cast("bigint"))
    block = lambda at: F.floor(position(at) / block_words)
    ranked = lambda at: ((F.col("a").cast("decimal(19,0)") * block(at).cast("decimal(18,0)") + F.col("b")) % F.col("quota")).cast("bigint")
    shard = lambda at: F.size(F.filter("ends", lambda e: e <= ranked(at)))
    copy = lambda at, p: F.struct(shard(at).alias("shard"), F.xxhash64(F.col("__key"), p, F.lit(seed)).alias("position"))
    return line.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.size("places")).alias("taken"), "__key",
        F.transform("places", copy).alias("copies"),
    )


def numbered(docs: DataFrame, shards: int = OUTPUT_SHARDS, seed: int = SEED) -> DataFrame:
    """The plan as a written table, with the turn of each row among equal rows."""
    same_row = Window.partitionBy("__key").orderBy("__key")
    return written(plan(docs, shards, seed=seed).withColumn("__nth", F.row_number().over(same_row)), "mix-plan")


def drawn(docs: DataFrame, planned: DataFrame, *wanted: str | Column) -> DataFrame:
    """Each copy that the shards draw, as a row with the `wanted` columns of `docs` and of the draw, in shards, shuffled locally.

    The draw has __row and __turn (which row of the plan) and __copy (shard and position).
    """
    same_row = Window.partitionBy("__key").orderBy("__key")
    left = docs.withColumn("__key", row_key(docs)).withColumn("__nth", F.row_number().over(same_row))
    # The second condition is no equality of columns, so the join keeps the windows' partitioning by key and
    # texts are dealt out once.
    right = planned.where(F.size("copies") > 0).select(F.col("__key").alias("__row"), F.col("__nth").alias("__turn"), F.col("copies").alias("__copies"))
    pairs = left.join(right, (F.col("__key") == F.col("__row")) & (F.col("__nth") - F.col("__turn") == 0))
    taken = pairs.withColumn("__copy", F.explode("__copies"))
    # Slices keep the partitions of a shard small; rows of a slice are in shuffled order.
    taken = taken.withColumn("__slice", F.shiftright(F.col("__copy.position"), 56))
    return taken.repartition(F.col("__copy.shard"), F.col("__slice")).sortWithinPartitions("__copy.shard", "__copy.position").select(*wanted)


def mixed(docs: DataFrame, shards: int = OUTPUT_SHARDS, seed: int = SEED) -> DataFrame:
    """The mix itself: each taken copy as a row with the columns of `docs`, in shards, shuffled locally."""
    return drawn(docs, numbered(docs, shards, seed), *columns(docs))


def report(docs: DataFrame, shards: int = OUTPUT_SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row: `taken` is counted in the texts of the drawn mix."""
    planned = numbered(docs, shards, seed)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [len(text.as_buffer().to_pybytes().split()) for text in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["__row"], batch["__turn"], pa.array(words, pa.int64())], names=["__row", "__turn", "words"])

    # Python sees whole texts in the mix's order, so no part of the draw is pruned.
    texts = drawn(docs, planned, "__row", "__turn", text_bytes().alias("text"))
    sums = arrow_map(texts, count, "__row bigint, __turn int, words bigint").groupBy("__row", "__turn").agg(F.sum("words").alias("words"))
    out = planned.drop("taken").join(sums, (F.col("__key") == F.col("__row")) & (F.col("__nth") == F.col("__turn")), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("bigint").alias("taken"))


ORACLE_SQL = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
named AS (
  SELECT source, CAST(SUM(size) AS BIGINT) AS source_size, (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM sized GROUP BY source),
filling AS (
  SELECT *, {MAX_REPEATS} * source_size AS cap, SUM(source_size) OVER () AS total,
         coalesce(SUM({MAX_REPEATS} * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped_before,
         SUM(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
  FROM named WINDOW o AS (ORDER BY CAST({MAX_REPEATS} * source_size AS DOUBLE) / w, source NULLS LAST)),
marked AS (SELECT *, cap * open_weight < (total - capped_before) * w AS capped FROM filling),
aimed AS (
  SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE
    CAST(total - SUM(CASE WHEN capped THEN cap ELSE 0 END) OVER () AS DOUBLE) * w / SUM(CASE WHEN capped THEN 0 ELSE w END) OVER () END AS target
  FROM marked),
line AS (
  SELECT s.doc_id, s.source, s.size, s.h, a.source_size, a.target,
         coalesce(SUM(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source),
counted AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE CAST(start + size <= target AS INT) + CAST(source_size + start + size <= target AS INT) + CAST(2 * source_size + start + size <= target AS INT) END AS whole
  FROM line),
rested AS (
  SELECT *, target - SUM(whole * size) OVER (PARTITION BY source) AS rest, ROW_NUMBER() OVER (ORDER BY h, doc_id, size) AS nth_row FROM counted),
rounds AS (
  SELECT 0 AS round, doc_id, source, size, h, source_size, target, whole AS used, rest, nth_row FROM rested
  UNION ALL
  SELECT round + 1, doc_id, source, size, h, source_size, target, used + CAST(takes AS INT),
         rest - SUM(CASE WHEN takes THEN size ELSE 0 END) OVER (PARTITION BY source), nth_row
  FROM (
    SELECT *, is_open AND before + size <= rest AS takes FROM (
      SELECT *, bool_or(is_open) OVER () AS goes_on,
             coalesce(SUM(CASE WHEN is_open THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY nth_row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM (SELECT *, size > 0 AND used < {MAX_REPEATS} AND size <= rest AS is_open FROM rounds) o) b) t
  WHERE goes_on),
chosen AS (
  SELECT *, size > 0 AND used < {MAX_REPEATS} AND abs(rest - size) < rest AS better,
         ROW_NUMBER() OVER (PARTITION BY source ORDER BY CASE WHEN size > 0 AND used < {MAX_REPEATS} AND abs(rest - size) < rest THEN 0 ELSE 1 END, abs(rest - size), h, doc_id, size) AS nth
  FROM rounds WHERE round = (SELECT MAX(round) FROM rounds))
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (used + CASE WHEN nth = 1 AND better THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM chosen"""
