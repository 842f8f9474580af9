"""Exact top-k inner products over norm-sorted vectors with Cauchy-Schwarz pruning.

Vectors are quantised to integers, and sorted by length, longest first, into range partitions. Each
query's first threshold, its k-th best score so far, comes from the longest vectors of all, in parallel
over the queries. Queries are then sorted by the length that a candidate needs to reach their thresholds,
and written in blocks of bounded size, a file each. The search is a grid of norm ranges and query blocks:
a task takes its vectors in ranges of bounded size, and for each range reads, one at a time, the blocks
that need no greater length than the range has. In a cell it walks the vectors by descending length:

* a query is done once its length times the block's greatest length is below its threshold;
* an orthogonal rotation, from the SVD of a bounded sample, puts most of the length first, so that the
  partial product of the leading coordinates plus the product of the lengths of the rest bounds the score;
* only pairs whose bound reaches the threshold are multiplied out, exactly, on integers.

Each cell returns at most k rows per query, which are merged by query. The plan doesn't grow with the blocks;
the driver handles a name and a length for each.

Defined cases: vectors that are null, or have a null or non-finite component, and rows without an id
take no part; shorter vectors count as filled up with zeros; rows with the query's own id aren't its
candidates; a repeated query row is answered once; repeated candidates count each. Scores beyond a
bigint are cut to its range.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, open_file, shared_path, written

K = 5
QUERY_EVERY = 50
SCALE = 256
#: Queries in a block, and bytes of vectors in a range: what a task holds at once.
QUERY_BLOCK = 4096
RANGE_BYTES = 64 << 20
#: Vectors for the rotation, and the longest ones for the first thresholds.
SAMPLE = 4096
CANDIDATE_BLOCK = 1024
#: One in so many pairs of a block must survive for a matrix product to be cheaper than single products.
DENSE = 64
PAIRS = 1 << 16
#: Share of the squared length that the leading coordinates should hold, and their share of all at most.
LEADING, LEADING_SHARE = 0.8, 0.5
#: Relative rounding error that bounds allow for.
SLACK = 1e-9
EXACT = float(1 << 53)


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, norm, dim, v (integers as little-endian doubles) of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, norms, dims, raw = [], [], [], []
            for i, v in zip(batch["vec_id"], batch["embedding"]):
                if not i.is_valid or not v.is_valid or v.values.null_count:
                    continue
                x = np.floor(SCALE * v.values.to_numpy(zero_copy_only=False).astype(np.float64))
                if np.isfinite(x).all():
                    ids.append(i.as_py())
                    norms.append(float(np.sqrt((x * x).sum())))
                    dims.append(len(x))
                    raw.append(x.astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(norms, pa.float64()), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], names=["vec_id", "norm", "dim", "v"])

    return arrow_map(vectors.select(F.col("vec_id").cast("bigint"), "embedding"), run, "vec_id bigint, norm double, dim int, v binary")


def matrix(raw: list[bytes], dim: int) -> np.ndarray:
    if raw and all(len(r) == 8 * dim for r in raw):
        return np.frombuffer(b"".join(raw), dtype="<f8").reshape(-1, dim)
    out = np.zeros((len(raw), dim))
    for k, r in enumerate(raw):
        out[k, : len(r) // 8] = np.frombuffer(r, dtype="<f8")
    return out


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products of integer vectors. Doubles are exact below 2**53; else Python's integers."""
    bound = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
    if not len(a) or bound.max() < EXACT / 2:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    low, high = -(1 << 63), (1 << 63) - 1
    return np.array([min(max(sum(int(x) * int(y) for x, y in zip(r, s)), low), high) for r, s in zip(a, b)], dtype=np.int64)


def pair_products(q: np.ndarray, x: np.ndarray, qs: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """Exact products of the pairs (q[qs], x[xs]): by one matrix product over the rows that occur if the
    pairs fill enough of it, else pair by pair. Sums of integers below 2**53 are exact in any order."""
    rows, row = np.unique(xs, return_inverse=True)
    columns, column = np.unique(qs, return_inverse=True)
    if len(rows) and len(qs) * DENSE >= len(rows) * len(columns):
        a, b = x[rows], q[columns]
        if np.sqrt((a * a).sum(axis=1).max() * (b * b).sum(axis=1).max()) < EXACT / 2:
            return (a @ b.T)[row, column].astype(np.int64)
    parts = [exact_products(q[qs[i : i + PAIRS]], x[xs[i : i + PAIRS]]) for i in range(0, len(qs), PAIRS)]
    return np.concatenate([np.zeros(0, dtype=np.int64), *parts])


def rotation(sample: np.ndarray) -> tuple[np.ndarray, int]:
    """(orthogonal matrix, number of leading coordinates)."""
    dim = sample.shape[1]
    if not len(sample) or not dim:
        return np.eye(dim), dim
    _, s, vt = np.linalg.svd(sample / max(1.0, np.abs(sample).max()), full_matrices=True)
    energy = np.cumsum(np.pad(s**2, (0, dim - len(s))))
    leading = int(np.searchsorted(energy, LEADING * energy[-1])) + 1 if energy[-1] > 0 else 1
    return vt.T, max(1, min(leading, ceil(LEADING_SHARE * dim)))


class Search:
    """A block of queries and what is best for each so far."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, turn: np.ndarray, leading: int, k: int):
        self.ids, self.q, self.turn, self.leading, self.k = ids, q, turn, leading, k
        self.norms = np.sqrt((q * q).sum(axis=1))
        rotated = q @ turn
        self.lead = rotated[:, :leading]
        self.rest = np.sqrt((rotated[:, leading:] ** 2).sum(axis=1))
        self.threshold = np.full(len(q), -np.inf)
        self.best = np.zeros((0, 3), dtype=np.int64)  # query, score, vec_id

    def block(self, ids: np.ndarray, x: np.ndarray, norms: np.ndarray) -> bool:
        """Take in candidates, longest first; False if no query can gain from these or shorter ones."""
        open_queries = np.flatnonzero(self.norms * norms[0] * (1 + SLACK) >= self.threshold)
        if not len(open_queries):
            return False
        rotated = x @ self.turn
        rest = np.sqrt((rotated[:, self.leading :] ** 2).sum(axis=1))
        bound = self.lead[open_queries] @ rotated[:, : self.leading].T + np.outer(self.rest[open_queries], rest)
        bound += SLACK * np.outer(self.norms[open_queries], norms)
        qs, xs = np.nonzero(bound >= self.threshold[open_queries][:, None])
        qs = open_queries[qs]
        other = self.ids[qs] != ids[xs]
        qs, xs = qs[other], xs[other]
        scores = pair_products(self.q, x, qs, xs)
        good = scores >= self.threshold[qs]
        rows = np.column_stack([qs[good], scores[good], ids[xs[good]]])
        self.best = self._top(np.concatenate([self.best, rows]))
        full = np.flatnonzero(np.bincount(self.best[:, 0], minlength=len(self.q)) >= self.k)
        last = np.searchsorted(self.best[:, 0], full, "right") - 1
        self.threshold[full] = np.maximum(self.threshold[full], self.best[last, 1])
        return True

    def _top(self, rows: np.ndarray) -> np.ndarray:
        rows = rows[np.lexsort((rows[:, 2], ~rows[:, 1], rows[:, 0]))]
        first = np.searchsorted(rows[:, 0], rows[:, 0])
        return rows[np.arange(len(rows)) - first < self.k]


def _longest(ordered: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = ordered.orderBy(F.col("norm").desc()).limit(SAMPLE).collect()
    return np.array([r["vec_id"] for r in rows], dtype=np.int64), matrix([bytes(r["v"]) for r in rows], dim), np.array([r["norm"] for r in rows])


def _walk(task: Search, ids: np.ndarray, x: np.ndarray, norms: np.ndarray) -> None:
    for at in range(0, len(ids), CANDIDATE_BLOCK):
        some = slice(at, at + CANDIDATE_BLOCK)
        if not task.block(ids[some], x[some], norms[some]):
            break


def query_blocks(ordered: DataFrame, dim: int, turn: np.ndarray, leading: int, k: int, query_every: int, query_block: int) -> DataFrame:
    """q (number of the query), query_id, v, threshold, need (the least length of a candidate that can gain),
    written in files of at most `query_block` rows, in the order of `need`."""
    spark = ordered.sparkSession
    shared = spark.sparkContext.broadcast((*_longest(ordered, dim), turn, leading))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x, norms, turn, leading = shared.value
        for batch in batches:
            for at in range(0, len(batch), query_block):
                part = batch.slice(at, query_block)
                q = matrix(part["v"].to_pylist(), dim)
                task = Search(part["vec_id"].to_numpy(), q, turn, leading, k)
                _walk(task, ids, x, norms)
                need = np.where(task.norms > 0, task.threshold / np.maximum(task.norms, 1) * (1 - SLACK), np.where(task.threshold > 0, np.inf, -np.inf))
                yield pa.RecordBatch.from_arrays([part["vec_id"], part["v"], pa.array(task.threshold), pa.array(np.maximum(need, 0.0))], names=["query_id", "v", "threshold", "need"])

    queries = ordered.where(F.col("vec_id") % query_every == 0).select("vec_id", "v").distinct()
    found = arrow_map(queries, first, "query_id bigint, v binary, threshold double, need double")
    found = written(found.withColumn("q", F.monotonically_increasing_id()), "topk-queries")
    path = shared_path(spark, "topk-blocks")
    by_need = found.repartitionByRange("need", F.xxhash64("q")).sortWithinPartitions("need")
    by_need.write.option("maxRecordsPerFile", query_block).parquet(path)
    return spark.read.schema(found.schema).parquet(path)


def search(vectors: DataFrame, k: int = K, query_every: int = QUERY_EVERY, query_block: int = QUERY_BLOCK, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every query."""
    rows = written(quantised(vectors), "topk-vectors")
    # Ties in length are split by a hash of the id, so that equal vectors don't share a partition.
    tie = F.xxhash64("vec_id")
    ordered = written(rows.repartitionByRange(F.col("norm").desc(), tie).sortWithinPartitions(F.col("norm").desc()), "topk-ordered")
    dim = ordered.agg(F.max("dim")).first()[0] or 0
    sample = ordered.orderBy(tie).limit(SAMPLE).select("v").collect()
    turn, leading = rotation(matrix([bytes(r["v"]) for r in sample], dim))
    queries = query_blocks(ordered, dim, turn, leading, k, query_every, query_block)
    # One row for each block.
    blocks = queries.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min("need").alias("need")).collect()
    blocks = sorted((r["need"], r["path"]) for r in blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def cells() -> Iterator[pa.RecordBatch]:
            # A file's rows are in order; a task that reads several files sorts them anew.
            part = pa.concat_batches(held)
            norms = part["norm"].to_numpy()
            order = np.argsort(-norms, kind="stable")
            x = None
            for need, path in blocks:
                if need > norms[order[0]] * (1 + SLACK):
                    break
                if x is None:  # ranges that no block needs aren't decoded
                    x, ids, lengths = matrix(part["v"].take(pa.array(order)).to_pylist(), dim), part["vec_id"].to_numpy()[order], norms[order]
                with open_file(path) as file:
                    block = pq.read_table(file).combine_chunks()
                cell = Search(block["query_id"].to_numpy(), matrix(block["v"].to_pylist(), dim), turn, leading, k)
                cell.threshold = block["threshold"].to_numpy().copy()
                _walk(cell, ids, x, lengths)
                best, numbers = cell.best, block["q"].to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(numbers[best[:, 0]]), pa.array(cell.ids[best[:, 0]]), pa.array(best[:, 1]), pa.array(best[:, 2])], names=["q", "query_id", "score", "vec_id"])

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= range_bytes:
                yield from cells()
                held, size = [], 0
        if any(len(b) for b in held):
            yield from cells()

    found = arrow_map(ordered.select("vec_id", "norm", "v"), run, "q bigint, query_id bigint, score bigint, vec_id bigint")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id AS query_id, e FROM v WHERE vec_id % {QUERY_EVERY} = 0),
s AS (
  SELECT query_id, q.e AS qe, v.vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
  FROM q JOIN v ON v.vec_id <> q.query_id),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id, qe ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {K}"""
