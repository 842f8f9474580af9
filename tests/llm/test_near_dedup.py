import random

import numpy as np
import pytest

from millrace.llm import near_dedup as n
from millrace.llm.components import components


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(110)] + [(i, i + 1) for i in range(300, 360)] + [(400, k) for k in range(401, 440)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    loops = {a for a, b in edges if a == b}
    assert {x: c for x, c in got.items()} == {x: root(x) for x in parent if x in got} and set(parent) - set(got) <= loops


@pytest.mark.parametrize("size", [60, 400, 5000])
def test_sketches_estimate_similarity(size):
    rng = np.random.default_rng(1)
    for share in (0.8, 0.9, 0.97):
        off = []
        for _ in range(60):
            same = int(np.ceil(share * 2 * size / (1 + share)))
            items = rng.integers(0, 1 << 63, 2 * size, dtype=np.uint64)
            a, b = np.sort(items[:size]), np.sort(np.concatenate([items[:same], items[size : 2 * size - same]]))
            (m, x), (k, y) = n.odd_sketch(a), n.odd_sketch(b)
            bits = int(np.unpackbits((x ^ y).view(np.uint8)).sum())
            assert bits <= n.most_bits(m + k)
            assert int(np.unpackbits((n.whole_sketch(a) ^ n.whole_sketch(b)).view(np.uint8)).sum()) <= n.most_bits_whole(2 * size)
            off.append(n.estimate(bits, m + k) - share)
        assert abs(np.mean(off)) < 0.06


def test_sketches_tell_half_similar_sets_apart():
    rng = np.random.default_rng(2)
    for _ in range(60):
        items = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
        (m, x), (k, y) = n.odd_sketch(np.sort(items[:400])), n.odd_sketch(np.sort(items[200:]))
        assert int(np.unpackbits((x ^ y).view(np.uint8)).sum()) > n.most_bits(m + k)


def brute(docs, words=2):
    sets = {}
    for i, text in docs:
        w = (text or "").lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {(i, len(sets[i]), root(i), root(i) == i) for i in ids}


@pytest.mark.parametrize("seed,size", [(1, 2), (2, 5)])
def test_chains_of_near_copies(spark, seed, size):
    """Neighbours in a chain are similar, its ends aren't; buckets hold members that don't match their centre."""
    rng = random.Random(seed)
    docs, at = [], 0
    for _ in range(6):
        words = [f"w{rng.randrange(3000)}" for _ in range(120)]
        for _ in range(25):
            docs.append((rng.randrange(10**6) * 1000 + at, " ".join(words)))
            at += 1
            for _ in range(rng.choice([1, 4, 6])):
                words[rng.randrange(120)] = f"n{rng.randrange(3000)}"
    rows = n.groups(spark.createDataFrame(docs, "doc_id bigint, text string"), size).collect()
    assert {tuple(r) for r in rows} == brute(docs, size)


def test_one_of_each_group_stays(spark):
    base = " ".join(f"w{k}" for k in range(50))
    rows = [(1, base, "x"), (2, base, "y"), (2, base, "y"), (3, base + " more", "z"), (4, "else", "z"), (4, "else", "z"), (None, base, "n"), (5, None, None)]
    kept = n.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string, kept string"))
    assert sorted(map(str, (r["doc_id"] for r in kept.collect()))) == ["1", "4", "5", "None"] and kept.columns == ["doc_id", "text", "kept"]


def test_an_id_with_two_texts_links_both(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(100)) for c in "ab")
    near = b.replace("b50 ", "x ")
    docs = spark.createDataFrame([(7, a), (7, b), (9, near), (3, "some other words"), (7, None)], "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in n.groups(docs, 2).collect())
    assert got == [(3, 2, 3, True), (7, 0, 7, True), (7, 99, 7, True), (7, 99, 7, True), (9, 99, 7, False)]
    left = sorted((r["doc_id"], r["text"] or "") for r in n.deduplicated(docs, 2).collect())
    assert left == sorted([(7, a), (7, b), (3, "some other words"), (7, "")])


def template(docs, changed=9, seed=4):
    rng = random.Random(seed)
    base = [f"t{k}" for k in range(100)]
    rows = []
    for i in range(docs):
        words = list(base)
        for k in rng.sample(range(100), changed):
            words[k] = f"v{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    return rows


def test_unlike_documents_of_one_template_are_not_all_paired(spark, monkeypatch):
    rows = template(1500)
    close = [(10_000 + i, text.replace("t99", "end").replace(" v", " v", 1)) for i, text in rows[:40]]
    rows += [(i, t) for i, t in close]
    paired = []
    real = n.Sets.close

    def counted(self, pairs):
        paired.append(pairs.count())
        return real(self, pairs)

    monkeypatch.setattr(n.Sets, "close", counted)
    got = {tuple(r) for r in n.groups(spark.createDataFrame(rows, "doc_id bigint, text string"), 2).collect()}
    assert got == brute(rows, 2)
    assert sum(paired) < 60 * len(rows) < len(rows) ** 2 // 20


@pytest.mark.parametrize("by_band", [False, True])
def test_documents_of_common_passages_alone(spark, monkeypatch, by_band):
    """Bands and items are both crowded, and nodes meet by either; a few pairs are similar."""
    rng = random.Random(7)
    passages = [" ".join(f"p{p}w{k}" for k in range(8)) for p in range(52)]
    rows = []
    for i in range(500):
        rows.append((i, " ".join(passages[:12] + [passages[p] for p in rng.sample(range(12, 52), 4)])))
    asked = []
    # The first total is that of the items, the second that of the bands.
    monkeypatch.setattr(n, "_total_work", lambda keys: asked.append(keys.count()) or float(by_band == (len(asked) == 1)))
    got = {tuple(r) for r in n.groups(spark.createDataFrame(rows, "doc_id bigint, text string"), 2).collect()}
    assert got == brute(rows, 2)
    assert len(asked) == 2 and asked[0] and 1 < sum(r[3] for r in got) < len(rows)


def test_prefixes_of_similar_sets_meet():
    rng = random.Random(6)
    for _ in range(300):
        size = rng.randrange(1, 60)
        items = rng.sample(range(1000), 2 * size)
        a = set(items[:size])
        b = set(a)
        for k in range(rng.randrange(1 + size // 4)):
            b.discard(items[k])
            if rng.random() < 0.5:
                b.add(items[size + k])
        large, small = (a, b) if len(a) >= len(b) else (b, a)
        if not small or 100 * len(a & b) < 80 * len(a | b):
            continue
        assert set(sorted(large)[: n.prefix_lengths(len(large))[0]]) & set(sorted(small)[: n.prefix_lengths(len(small))[1]])
