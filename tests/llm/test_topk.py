import numpy as np
import pytest

import fixtures
from millrace.llm import topk


def brute(rows, every=50, k=5):
    good = [(r["vec_id"], np.floor(256 * np.array(r["embedding"], dtype=np.float32).astype(np.float64)).astype(object)) for r in rows if r["embedding"] is not None and all(x is not None and np.isfinite(x) for x in r["embedding"])]
    out = set()
    for q, x in good:
        if q % every == 0:
            scored = sorted((-int((x * y).sum()) if len(x) else 0, i) for i, y in good if i != q)[:k]
            out |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored)}
    return out


@pytest.mark.parametrize("query_block,range_bytes", [(4096, topk.RANGE_BYTES), (2, 500)])
def test_matches_brute_force(spark, tmp_path, monkeypatch, query_block, range_bytes):
    monkeypatch.setattr(topk, "SAMPLE", 20)
    folder = fixtures.write(tmp_path, {"embeddings": fixtures.embeddings()}, clashes=True)
    rows = topk.search(spark.read.parquet(f"{folder}/embeddings.parquet"), query_block=query_block, range_bytes=range_bytes).collect()
    assert {tuple(r) for r in rows} == brute(fixtures.embeddings()) and len(rows) == len(set(map(tuple, rows)))


def test_large_components_are_exact():
    a = np.array([[2.0**40 + 1, 3.0], [1.0, 2.0]])
    b = np.array([[2.0**20 + 1, 5.0], [4.0, 5.0]])
    assert topk.exact_products(a, b).tolist() == [(2**40 + 1) * (2**20 + 1) + 15, 14]


def test_fewer_candidates_than_k(spark):
    rows = [(0, [1.0]), (1, [2.0]), (2, [0.5, 3.0])]
    out = topk.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()
    assert sorted(map(tuple, out)) == [(0, 1, 1, 256 * 512), (0, 2, 2, 256 * 128)]


def test_plan_does_not_grow_with_the_blocks(spark, tmp_path):
    folder = fixtures.write(tmp_path, {"embeddings": fixtures.embeddings()})
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    plan = lambda n: topk.search(rows, query_every=1, query_block=n)._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert plan(2) == plan(4096)


def test_null_ids_and_no_queries(spark):
    rows = [(None, [1.0]), (None, [2.0]), (7, [3.0]), (9, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    assert topk.search(frame).count() == 0
    assert sorted(map(tuple, topk.search(frame, query_every=7).collect())) == [(7, 1, 9, 768 * 256)]
