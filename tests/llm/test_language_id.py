import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

import fixtures
from millrace.llm import language_id as L

SF = "/root/testdata/sf0.01"


def slow_model(lines, alphabet):
    """Interpolated Kneser-Ney by its definition, on tuples; returns p(symbol | three before)."""
    grams = defaultdict(Counter)
    for line in lines:
        padded = [0] * (L.ORDER - 1) + line
        for i in range(L.ORDER, len(padded)):
            grams[L.ORDER][tuple(padded[i - L.ORDER + 1 : i + 1])] += 1
    for n in range(L.ORDER - 1, 0, -1):
        for g in grams[n + 1]:
            grams[n][g[1:]] += 1
    discount, mass, kinds = {}, {}, {}
    for n, counts in grams.items():
        ones, twos = (sum(c == k for c in counts.values()) for k in (1, 2))
        discount[n] = ones / (ones + 2 * twos) if ones and twos else 0.5
        mass[n], kinds[n] = Counter(), Counter()
        for g, c in counts.items():
            mass[n][g[:-1]] += c
            kinds[n][g[:-1]] += 1

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / alphabet
        h = gram[:-1]
        if not mass[n][h]:
            return p(gram[1:])
        return (max(grams[n][gram] - discount[n], 0) if gram in grams[n] else 0) / mass[n][h] + discount[n] * kinds[n][h] / mass[n][h] * p(gram[1:])

    return p


def test_scores_match_the_definition():
    rng = random.Random(4)
    texts = {lang: [fixtures.prose(rng, lang, 30) for _ in range(6)] for lang in ("de", "en")}
    model = L.train(texts)
    alphabet = len(set().union(*(t.grams[1].tolist() for t in model.tables))) + 1
    for k, lang in enumerate(model.languages):
        p = slow_model([L.symbols(t).tolist() for t in texts[lang]], alphabet)
        for text in ("the und für", "xyz", "Être ÊTRE", texts["de"][0]):
            line = [0] * (L.ORDER - 1) + L.symbols(text).tolist()
            want = -sum(math.log(p(tuple(line[i - L.ORDER + 1 : i + 1]))) for i in range(L.ORDER, len(line)))
            n, ce = model.cross_entropies(text)
            assert n == len(line) - L.ORDER and abs(ce[k] * n - want) < 1e-3 * max(1, want)


def test_long_texts_are_scored_whole(monkeypatch):
    rng = random.Random(5)
    model = L.train({"en": [fixtures.prose(rng, "en", 300)], "fr": [fixtures.prose(rng, "fr", 300)]})
    text = fixtures.prose(rng, "en", 2000)
    n, whole = model.cross_entropies(text)
    monkeypatch.setattr(L, "CHUNK", 100)
    m, parts = model.cross_entropies(text)
    assert n == m and np.allclose(whole, parts)


def test_rejection():
    rng = random.Random(6)
    texts = {lang: [fixtures.prose(rng, lang, 60) for _ in range(30)] for lang in fixtures.WORDS}
    model = L.calibrate(L.train(texts), texts)
    assert L.predict(model, "12 | 34")[0] == L.predict(model, None)[0] == L.predict(model, "")[0] == "und"
    assert not L.predict(model, "12 | 34")[2]
    for lang in texts:
        got, score, accepted = L.predict(model, fixtures.prose(rng, lang, 40))
        assert got == lang and accepted and 0 <= score <= 1
    assert not L.predict(model, "".join(chr(0x4E00 + 7 * i) for i in range(300)))[2]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = L.identify(docs).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert sum(r["accepted"] for r in rows) >= 0.99 * len(rows)


def test_labels_of_the_held_out_fold_do_not_matter(spark, tmp_path):
    docs = fixtures.documents(n=120)
    one = fixtures.write(tmp_path, {"documents": docs})
    (tmp_path / "b").mkdir()
    for d in docs:
        if zlib.crc32(str(d["doc_id"]).encode()) % 3 == 1:
            d["lang"] = "xx"
    other = fixtures.write(tmp_path / "b", {"documents": docs})
    rows = lambda f: sorted(map(tuple, L.identify(spark.read.parquet(f"{f}/documents.parquet")).collect()), key=repr)
    assert rows(one) == rows(other)


def test_many_languages(spark):
    """More languages than the sample has room for long windows of; one has a single short document."""
    rng = random.Random(8)
    letters = [chr(0x4E00 + k) for k in range(4000)]
    docs = []
    for k in range(1200):
        own = letters[3 * k : 3 * k + 3] if k < 1199 else ["q", "x", "z"]
        for j in range(3 if k else 1):
            docs.append((10 * k + j, " ".join("".join(rng.choice(own) for _ in range(4)) for _ in range(30)), f"l{k}"))
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    model = L.fit(frame)
    labelled = {lang for i, _, lang in docs if zlib.crc32(str(i).encode()) % 3 != 1}
    assert set(model.languages) == labelled and L.sample_size(1200)[0] * 1200 <= L.TOTAL_CHARS
    assert sum(L.predict(model, t)[0] == lang for _, t, lang in docs[:60] if lang in labelled) >= 55


def test_query_matches_the_definition(spark, tmp_path):
    """lang_pred, score and accepted of every row, from plain models of the same sample."""
    docs = [d for d in fixtures.documents() if len(d["text"] or "") < 900]
    folder = fixtures.write(tmp_path, {"documents": docs})
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    model = L.fit(frame)
    train = [d for d in docs if d["lang"] and zlib.crc32(str(d["doc_id"]).encode()) % 3 != 1 and any(c.isalpha() for c in d["text"] or "")]
    hashes = {(r["doc_id"], r["text"]): r["h"] for r in frame.select("doc_id", "text", L.F.xxhash64("doc_id", "text", L.F.lit(1)).alias("h")).collect()}
    languages = sorted({d["lang"] for d in train})
    alphabet = len(set().union(*(t.grams[1].tolist() for t in model.tables))) + 1
    plain, spread = {}, {}

    def entropy(p, text):
        line = [0] * (L.ORDER - 1) + L.symbols(text).tolist()
        return len(line) - L.ORDER, -sum(math.log(p(tuple(line[i - L.ORDER + 1 : i + 1]))) for i in range(L.ORDER, len(line))) / (len(line) - L.ORDER)

    for lang in languages:
        own = [d for d in train if d["lang"] == lang]
        checks = [d["text"] for d in own if hashes[d["doc_id"], d["text"]] % L.CALIBRATION == 0]
        learned = [d["text"] for d in own if hashes[d["doc_id"], d["text"]] % L.CALIBRATION] or checks
        plain[lang] = slow_model([L.symbols(t).tolist() for t in learned], alphabet)
        seen = [entropy(plain[lang], t) for t in checks]
        n = sum(k for k, _ in seen)
        mean = sum(k * ce for k, ce in seen) / n if n else math.log(alphabet)
        spread[lang] = mean, max(0.25, math.sqrt(sum(k * (ce - mean) ** 2 for k, ce in seen) / len(seen))) if seen else 1.0
    for r in L.identify(frame.select("doc_id", "text", "lang")).join(frame.select("doc_id", "text"), "doc_id").collect():
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"], r["accepted"]) == ("und", 0.0, False)
            continue
        ce = {lang: entropy(plain[lang], r["text"]) for lang in languages}
        n = ce[languages[0]][0]
        best = min(languages, key=lambda x: ce[x][1])
        score = 1 / sum(math.exp((ce[best][1] - c) * min(n, 50)) for _, c in ce.values())
        assert r["lang_pred"] == best and abs(r["score"] - score) < 1e-3
        above = ce[best][1] - spread[best][0] - L.MARGIN - L.Z * spread[best][1] / math.sqrt(n)
        assert r["accepted"] == (above <= 0) or abs(above) < 1e-3
