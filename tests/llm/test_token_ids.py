import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import fixtures
from millrace.llm import token_ids as t


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(t.default_tokenizer())


@pytest.fixture(scope="module")
def encoder():
    return t.Encoder(open(t.default_tokenizer(), encoding="utf-8").read())


@settings(deadline=None)
@given(texts=st.lists(st.one_of(st.text(max_size=40), st.sampled_from(["a<|endoftext|>b c", "it's x\x1cy z", "É ́e 's İI", "ΣΑΣ ς"])), max_size=6))
def test_word_by_word_equals_whole_texts(tokenizer, encoder, texts):
    texts = [x.encode("utf-8", "replace").decode() for x in texts]
    ids, lengths = encoder.encode([x.encode() for x in texts])
    want = [tokenizer.encode(x, add_special_tokens=False).ids + [t.END_ID] for x in texts]
    assert ids.tolist() == [i for w in want for i in w] and lengths.tolist() == list(map(len, want))


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 70000) | st.just(7), max_size=900), st.integers(0, 900), st.integers(0, 900))
def test_file_round_trip(ids, a, b):
    lengths = np.array([min(a, len(ids)), len(ids) - min(a, len(ids))])
    data = t.pack_file(3, [None, -5], lengths, np.array(ids, dtype=np.uint32))
    file = t.TokenFile(data + b"\nEND\n")
    assert file.doc_ids == [None, -5] and file.number == 3 and file.n_ids == len(ids)
    assert [i for k in range(2) for i in file.ids(k)] == ids
    first, end = sorted((min(a, len(ids)), min(b, len(ids))))
    assert file.range(first, end).tolist() == ids[first:end]
    with pytest.raises(ValueError):
        t.TokenFile(data[:-1])


def test_blocks_are_small():
    ids = np.random.default_rng(0).integers(0, 500, 100_000).astype(np.uint32)
    ids[::97] = 40_000
    assert sum(map(len, t.pack_blocks(ids))) < 1.35 * len(ids)


@pytest.mark.parametrize("n_tasks,file_ids,in_memory", [(None, t.FILE_IDS, False), (4, 200, False), (None, t.FILE_IDS, True), (90, 1, True)])
def test_query_matches_whole_text_encoding(spark, tmp_path, tokenizer, n_tasks, file_ids, in_memory):
    docs = fixtures.documents() + [{"doc_id": 77, "text": f"same id {k}"} for k in range(40)] + [{"doc_id": None, "text": f"no id {k % 5}"} for k in range(30)]
    folder = fixtures.write(tmp_path, {"documents": docs}, clashes=True)
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    if in_memory:
        frame = spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id bigint, text string")
    rows = t.write_and_index(frame, path := f"file://{tmp_path}/ids", n_tasks=n_tasks, file_ids=file_ids).collect()
    assert t.read_files(spark, path).select("file_number").distinct().count() == (n_tasks or 1)
    rows.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((d["doc_id"] for d in docs), key=lambda i: (i is not None, i))
    assert [r["start"] for r in rows] == np.cumsum([0, *(r["n_tokens"] for r in rows)])[:-1].tolist()
    want = []
    for d in docs:
        ids = tokenizer.encode(d["text"] or "", add_special_tokens=False).ids + [t.END_ID]
        want.append((d["doc_id"], len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows), key=repr) == sorted(want, key=repr)


@given(st.lists(st.lists(st.integers(0, 12), max_size=8), max_size=6), st.integers(1, 30))
def test_runs_hold_all_rows_in_order(sizes, limit):
    batches = [pa.RecordBatch.from_arrays([pa.array([b"x" * n for n in some], pa.binary())], names=["text"]) for some in sizes]
    runs = list(t._runs(iter(batches), limit))
    assert [len(x) for r in runs for x in r["text"].to_pylist()] == [n for some in sizes for n in some]
    assert all(len(r) and (sum(map(len, r["text"].to_pylist())) <= limit or sum(1 for x in r["text"].to_pylist() if x) == 1) for r in runs)
