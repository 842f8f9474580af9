import pyarrow as pa  # noqa: F401
from hypothesis import given
from hypothesis import strategies as st

import fixtures
from millrace.llm import decontaminate as d

VOCABULARY = ["a", "b", "é", "Z9", "."]


def brute(text, items, window):
    words = d.words_of(text)
    hits, ids = set(), set()
    for item_id, item in items:
        w = d.words_of(item)
        n = min(window, len(w))
        for i in range(max(1, len(w) - window + 1)) if w else ():
            for j in range(len(words) - n + 1):
                if words[j : j + n] == w[i : i + n]:
                    hits.update(range(j, j + n))
                    ids.add(item_id)
    return len(words), hits, ids


TEXT = st.lists(st.sampled_from(VOCABULARY), max_size=20).map(lambda w: " ".join(w).encode())


@given(TEXT, st.lists(TEXT, max_size=4), st.integers(1, 4))
def test_scan_matches_brute_force(text, items, window):
    items = list(enumerate(items))
    automaton, ids_of = d.build(items, window)
    assert d.scan(text, automaton, ids_of) == brute(text, items, window)


def test_offsets_are_characters_of_the_original():
    text = "éé, Short--QUESTION! ok short question"
    automaton, ids_of = d.build([(1, b"short question")])
    _, hits, _ = d.scan(text.encode(), automaton, ids_of)
    assert [text[s:e] for s, e in d.spans_of(text.encode(), hits)] == ["Short--QUESTION", "short question"]


def test_several_automata_give_the_same(spark, tmp_path):
    folder = fixtures.awkward(tmp_path)
    docs, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = lambda limit: sorted(map(tuple, d.report(docs, bench, limit=limit).collect()))
    assert rows(20) == rows(1 << 20)
    passes = d.annotate(docs, bench, pass_bytes=50).select("doc_id", "__n_words", "__hits", "__items", "__spans").collect()
    assert sorted(map(repr, passes)) == sorted(map(repr, d.annotate(docs, bench).select("doc_id", "__n_words", "__hits", "__items", "__spans").collect()))
    left = {r["doc_id"] for r in d.clean(docs, bench).collect()}
    assert 200 not in left and {201, 202} <= left and d.clean(docs, bench).columns == docs.columns
    spans = {(r["doc_id"], r["match"]) for r in d.hit_spans(docs, bench).collect()}
    assert (201, "short -- question") in spans
