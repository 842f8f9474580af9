import numpy as np
import pytest

import fixtures
from millrace.llm import warc


@pytest.mark.parametrize("split_bytes", [64, 1000, warc.SPLIT_BYTES])
def test_magic_in_payloads_is_not_a_record(spark, tmp_path, split_bytes):
    folder = fixtures.awkward(tmp_path)
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    path = f"file://{tmp_path}/archives"
    warc.write_archives(pages.coalesce(1), path)
    rows = warc.read_archives(spark, path, split_bytes, payloads=True).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(p["page_id"] for p in fixtures.pages())
    html = {p["page_id"]: p["html"] or "" for p in fixtures.pages()}
    for r in rows:
        want = html[r["page_id"]].encode()
        assert bytes(r["payload"]) == (want if r["record_type"] == "response" else b"") and r["payload_bytes"] == len(want)
    assert {(r["page_id"], r["refers_to"]) for r in rows if r["record_type"] == "revisit"} == {(0, 0), (1, 0), (2, 0), (9, 7)}


def test_decisions_joined_by_shuffle(spark, tmp_path, monkeypatch):
    folder = fixtures.awkward(tmp_path)
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    want = sorted(map(tuple, warc.write_and_read(pages).collect()), key=repr)
    monkeypatch.setattr(warc, "BROADCAST_ROWS", -1)
    assert sorted(map(tuple, warc.write_and_read(pages).collect()), key=repr) == want


def test_null_ids(spark):
    body = "x" * 200
    pages = spark.createDataFrame([(None, "u", body), (None, "u", body), (5, "u", body), (None, "v", "y" * 100)], "page_id bigint, url string, html string")
    rows = warc.write_and_read(pages).collect()
    assert sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"])) for r in rows) == [("5", "response", "None"), ("None", "response", "None"), ("None", "revisit", "5"), ("None", "revisit", "5")]


def test_broken_archive_raises(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "part-0").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabcd\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n")
    with pytest.raises(Exception, match="no record at offset"):
        warc.read_archives(spark, f"file://{tmp_path}/a").collect()


@pytest.mark.parametrize("split_bytes", [5000, warc.SPLIT_BYTES])
def test_headers_of_any_length(spark, tmp_path, split_bytes):
    url = "http://a/" + "p" * 150_000
    pages = spark.createDataFrame([(k, url if k % 3 else "u", f"{k}" * 3000) for k in range(9)], "page_id bigint, url string, html string")
    warc.write_archives(pages.coalesce(1), path := f"file://{tmp_path}/archives")
    rows = warc.read_archives(spark, path, split_bytes, payloads=True)
    assert split_bytes > 5000 or rows.rdd.getNumPartitions() > 4
    assert {(r["page_id"], r["url"]) for r in rows.collect()} == {(k, url if k % 3 else "u") for k in range(9)}


def test_pointer_jumping_reaches_the_chain_only():
    offsets, successors = np.array([0, 7, 10, 14, 30, 41, 50]), np.array([10, 30, 30, 999, 41, 60, 60])
    assert warc.reachable(offsets, successors, 0).tolist() == [0, 2, 4, 5] and warc.reachable(offsets, successors, 8).tolist() == []
    assert warc.exits(offsets, successors, 60).tolist() == [60, 60, 60, 999, 60, 60, 60]
