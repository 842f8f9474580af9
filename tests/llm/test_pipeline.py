"""The pipeline against plain versions of its stages, each judged on its own input."""

from collections import Counter

import corpus_pipeline
import fixtures
from millrace.llm import decontaminate, language_id, mixing, near_dedup, sharding
from test_near_dedup import brute as near_brute


def test_stages(spark, tmp_path):
    folder = fixtures.awkward(tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = {"": docs.collect()}
    frame = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame, folder)
        if name != "shard":
            assert out.columns == docs.columns
        out.write.parquet(path := f"{tmp_path}/stage{k}")
        frame = spark.read.parquet(path)
        steps[name] = frame.collect()
    ids = lambda name: Counter(r["doc_id"] for r in steps[name])

    model = language_id.fit(docs)
    assert ids("language_id") == Counter(r["doc_id"] for r in steps[""] if language_id.predict(model, r["text"])[2])
    assert {100, 101, 102, 103}.isdisjoint(ids("language_id"))
    kept = {i for i, _, _, first in near_brute({(r["doc_id"], r["text"]) for r in steps["language_id"]}, near_dedup.WORDS) if first}
    assert ids("near_dedup") == Counter(kept)
    automaton, ids_of = decontaminate.build([(b["item_id"], (b["text"] or "").encode()) for b in fixtures.BENCHMARK])
    clean = Counter()
    for r in steps["near_dedup"]:
        n, hits, _ = decontaminate.scan(r["text"].encode(), automaton, ids_of)
        clean[r["doc_id"]] += not (hits and 20 * len(hits) >= n)
    assert ids("decontaminate") == +clean and 200 not in ids("decontaminate")

    words = lambda r: len(r["text"].encode().split())
    sources = sorted({r["source"] for r in steps["decontaminate"]}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(words(r) for r in steps["decontaminate"] if r["source"] == s) for s in sources]
    wanted = mixing.targets(sizes, [1 + i % 3 for i in range(len(sources))])
    for source, target in zip(sources, wanted):
        taken = sum(words(r) for r in steps["mix"] if r["source"] == source)
        assert abs(taken - target) <= max(words(r) for r in steps["decontaminate"] if r["source"] == source)
    assert max(ids("mix").values()) <= 3 and set(ids("mix")) <= set(ids("decontaminate"))

    size = sharding.table_size(sharding.SHARDS)
    owner = sharding.lookup_table(sharding.shard_names(sharding.SHARDS), size)
    assert ids("shard") == ids("mix")
    assert all(r["shard"] == owner[sharding._hash(str(r["doc_id"])) % size] for r in steps["shard"])


def test_run_gives_the_same_again(spark):
    sf = "/root/testdata/sf0.001"
    rows = lambda: Counter((r["doc_id"], r["shard"]) for r in corpus_pipeline.run(spark, sf).collect())
    first = rows()
    assert first and first == rows()
