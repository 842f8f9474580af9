"""Every query that SQL can express, against DuckDB on whole tables."""

import pytest

import fixtures
from millrace.llm import registry
from oracle import agree, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", registry.ORACLE)
def test_query_matches_sql(spark, name):
    agree(registry.QUERIES[name](spark, SF), connect(SF), registry.ORACLE[name])


@pytest.mark.parametrize("name", registry.ORACLE)
def test_awkward_tables_match_sql(spark, tmp_path, name):
    folder = fixtures.awkward(tmp_path)
    agree(registry.QUERIES[name](spark, folder), connect(folder), registry.ORACLE[name])


@pytest.mark.parametrize("name", registry.QUERIES)
def test_empty_tables(spark, tmp_path, name):
    folder = fixtures.write(tmp_path, {})
    assert registry.QUERIES[name](spark, folder).count() == 0


@pytest.mark.parametrize("name", [q for q in registry.QUERIES if q not in ("op4_warc", "op10_topk")])
def test_null_ids_and_only_nulls(spark, tmp_path, name):
    rows = [{"doc_id": None, "text": t, "lang": None, "source": None} for t in (None, "", "a word and more", "a word and more", "other words")]
    folder = fixtures.write(tmp_path, {"documents": rows + [{"doc_id": 3}], "benchmark": [{"item_id": None, "text": "word and"}]})
    assert registry.QUERIES[name](spark, folder).count() == 6
