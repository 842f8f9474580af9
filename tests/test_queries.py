import pytest

from millrace.plans import corpus
from oracle import agree, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", corpus.QUERIES)
def test_query_matches_sql(spark, con, name):
    agree(corpus.QUERIES[name](spark, SF), con, corpus.ORACLE[name])


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name,keys", [("sort_multi_key", [("s_nationkey", -1), ("s_name", 1)]), ("sort_external", [("o_custkey", 1), ("o_totalprice", 1), ("o_orderkey", 1)]), ("r7", [("p_partkey", 1)]), ("r10", [("n_nationkey", 1)])])
def test_order(spark, name, keys):
    rows = corpus.QUERIES[name](spark, SF).collect()
    want = list(rows)
    for column, sign in reversed(keys):
        want.sort(key=lambda r: r[column], reverse=sign < 0)
    assert [[r[c] for c, _ in keys] for r in rows] == [[r[c] for c, _ in keys] for r in want]
