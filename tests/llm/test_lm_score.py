import math
import zlib
from collections import Counter

import numpy as np

import fixtures
from millrace.llm import lm_score as L
from millrace.llm.common import LOWER

SF = "/root/testdata/sf0.01"


def brute(docs):
    words = lambda t: (t or "").encode().translate(LOWER).split() + [b""]
    train = [d for d in docs if zlib.crc32(("" if d["doc_id"] is None else str(d["doc_id"])).encode()) % 7 != 2]
    c = Counter(w for d in train for w in words(d["text"]))
    n, v = sum(c.values()), len(c)
    return [(d["doc_id"], len(words(d["text"])), sum(c[w] > 0 for w in words(d["text"])), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(d["text"])), 6)) for d in docs]


def check(spark, folder, docs):
    rows = L.score(spark.read.parquet(f"{folder}/documents.parquet")).collect()
    got = [(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows]
    assert sorted(got, key=repr) == sorted(brute(docs), key=repr)
    return rows


def test_base_matches_brute_force(spark, tmp_path, monkeypatch):
    docs = fixtures.documents() + fixtures.CONTAMINATED
    folder = fixtures.write(tmp_path, {"documents": docs}, clashes=True)
    check(spark, folder, docs)
    monkeypatch.setattr(L, "DICTIONARY", 5)  # now nearly all counts come from the join
    check(spark, folder, docs)


def test_probabilities_are_normalised():
    rng = np.random.default_rng(0)
    model = L.Model(rng.random(L.CLASSES) * 100)
    for h2, h1 in ((L.END, L.END), (3, 900)):
        total = sum(math.exp(model.log_probabilities(np.array([h2, h1, w]))[0]) for w in range(L.CLASSES))
        assert abs(total - 1) < 1e-3


def test_model_beats_the_base_on_held_out_texts(spark):
    rows = [r for r in L.score(spark.read.parquet(f"{SF}/documents.parquet")).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
    assert sum(r["score"] > r["base_score"] for r in rows) > 0.8 * len(rows)


def test_every_position_is_learned(spark, monkeypatch):
    seen = []
    text = lambda n: " ".join(f"w{k}" for k in range(n))
    docs = spark.createDataFrame([(k, text(n)) for k, n in enumerate((0, 1, 2, 3, 9, 40))], "doc_id bigint, text string")
    texts = docs.select(L.text_bytes().alias("text"), L.F.xxhash64("doc_id", "text").alias("place")).coalesce(1)

    def in_driver(df, function, schema):
        out = list(function(iter(df.toArrow().to_batches())))
        if "weight" in schema:
            seen.extend(b["weight"][0].as_py() for b in out if b.num_rows)
        return spark.createDataFrame(L.pa.Table.from_batches(out), schema)

    monkeypatch.setattr(L, "arrow_map", in_driver)
    vocabulary = L.Vocabulary([], 0, 0, {})
    lines = L.class_lines(texts, spark.sparkContext.broadcast(vocabulary))
    L._train_round(lines, L.Model(vocabulary.mass), 1, 0)
    assert seen[0] == sum(n + 1 for n in (0, 1, 2, 3, 9, 40))


def test_scores_do_not_depend_on_files_or_partitions(spark, monkeypatch):
    monkeypatch.setattr(L, "PART_TOKENS", 2000)  # several parts
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = {r["doc_id"]: r["score"] for r in L.score(docs.coalesce(1)).collect()}
    many = {r["doc_id"]: r["score"] for r in L.score(docs.repartition(7, "text")).collect()}
    assert one.keys() == many.keys() and all(math.isclose(one[i], many[i], rel_tol=1e-5) for i in one)


def test_score_matches_brute_force(spark, tmp_path):
    """Every token's log-probability, from the fitted tables by loops over all classes."""
    docs = fixtures.documents()[:40] + [{"doc_id": 900, "text": "never seen words \u00e9\u00e8"}]
    folder = fixtures.write(tmp_path, {"documents": docs})
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    _, vocabulary, model = L.fit(frame)
    first, second, target = (t.astype(float) for t in model.tables)
    words = lambda t: (t or "").encode().translate(LOWER).split()
    train = Counter(w for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 7 != 2 for w in words(d["text"]))
    own = {w: k for k, (w, _) in enumerate(sorted(train.items(), key=lambda x: (-x[1], x[0]))[: L.FREQUENT])}
    shared = {}
    for w, c in train.items():
        if w not in own:
            total = shared.setdefault(L.FREQUENT + zlib.crc32(w[: L.PREFIX]) % L.BUCKETS, [0, 0])
            total[0], total[1] = total[0] + c, total[1] + 1
    class_of = lambda w: own.get(w, L.FREQUENT + zlib.crc32(w[: L.PREFIX]) % L.BUCKETS)

    def brute_score(text):
        line, out = [L.END, L.END] + [class_of(w) for w in words(text)] + [L.END], 0.0
        tokens = words(text) + [None]
        for k, w in enumerate(tokens):
            h2, h1, c = line[k : k + 3]
            scores = [sum((first[h1][j] + second[h2][j]) * target[x][j] for j in range(L.SIZE)) + float(model.bias[x]) for x in range(L.CLASSES)]
            top = max(scores)
            out += (scores[c] - top - math.log(sum(math.exp(x - top) for x in scores))) / math.log(10)
            if L.FREQUENT <= c < L.END:
                mass, kinds = shared.get(c, (0, 0))
                out += math.log10((train[w] + 1) / (mass + kinds + 1))
        return out

    short = [d for d in docs if len(words(d["text"])) <= 5][:12] + docs[-1:]
    got = {r["doc_id"]: r["score"] for r in L.score(frame).collect()}
    for d in short:
        assert math.isclose(got[d["doc_id"]], brute_score(d["text"]), rel_tol=1e-3, abs_tol=1e-3), d


def test_rows_are_added_up():
    rng = np.random.default_rng(1)
    rows, values = rng.integers(0, 9, 200), rng.normal(size=(200, 3))
    want, got = np.zeros((9, 3)), np.zeros((9, 3))
    np.add.at(want, rows, values)
    at, sums = L.summed_rows(rows, values)
    got[at] = sums
    assert np.allclose(want, got)
