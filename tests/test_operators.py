import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from millrace import operators as ops
from millrace.functions import codecs
from millrace.functions.aggregates import Agg
from millrace.operators import dml
from millrace.plans import sql
from millrace.sources import catalog, text_table
from millrace.streaming import ingest

SF = "/root/testdata/sf0.001"
SLOW = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
VALUES = st.lists(st.tuples(st.one_of(st.none(), st.integers(-5, 5)), st.one_of(st.none(), st.sampled_from(["", "a", "ab", "é", "z"]))), max_size=25)
PY = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def frame(spark, rows):
    return spark.createDataFrame(rows, "k int, s string")


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


@SLOW
@given(rows=VALUES, op=st.sampled_from(list(PY)), x=st.integers(-5, 5), y=st.sampled_from(["a", "b", "zz"]))
def test_comparisons(spark, rows, op, x, y):
    want = sorted((r for r in rows if r[0] is not None and PY[op](r[0], x)), key=repr)
    assert got(ops.filter_rows(frame(spark, rows), ops.compare("k", op, x))) == want
    want = sorted((r for r in rows if r[1] is not None and PY[op](r[1].encode(), y.encode())), key=repr)
    assert got(ops.filter_rows(frame(spark, rows), ops.compare("s", op, y))) == want


@SLOW
@given(rows=VALUES, low=st.one_of(st.none(), st.integers(-4, 4)), high=st.one_of(st.none(), st.integers(-4, 4)), li=st.booleans(), hi=st.booleans())
def test_ranges(spark, rows, low, high, li, hi):
    inside = lambda k: k is not None and (low is None or k > low or li and k == low) and (high is None or k < high or hi and k == high)
    assert got(ops.index_scan(frame(spark, rows), "k", low, high, li, hi)) == sorted(((r[0],) for r in rows if inside(r[0])), key=repr)


@SLOW
@given(a=VALUES, b=VALUES)
def test_joins_agree_whatever_the_strategy(spark, a, b):
    left, right = frame(spark, a).toDF("k", "s"), frame(spark, b).toDF("j", "t")
    want = sorted(((*x, *y) for x in a for y in b if x[0] is not None and x[0] == y[0]), key=repr)
    for joined in (ops.merge_join(left, right, [("k", "j")]), ops.inner_join(left, right, [("k", "j")]), ops.index_join(left, right, "k", "j"), ops.index_join(left, right, "k", "j", limit=-1)):
        assert got(joined) == want
    want = sorted(((*x, *y) for x in a for y in b if None not in (x[0], y[0]) and x[0] < y[0]), key=repr)
    assert got(ops.theta_join(left, right, ops.join_compare("k", "<", "j"))) == want


@SLOW
@given(rows=VALUES)
def test_grouping(spark, rows):
    out = ops.group_aggregate(frame(spark, rows), ["s"], [Agg("count", "k", "n"), Agg("sum", "k", "total"), Agg("avg", "k", "mean"), Agg("min", "k", "low"), Agg("max", "k", "high")])
    want = []
    for key in {r[1] for r in rows}:
        ks = [r[0] for r in rows if r[1] == key and r[0] is not None]
        want.append((key, len(ks), sum(ks) if ks else None, int(sum(ks) / len(ks)) if ks else None, min(ks, default=None), max(ks, default=None)))
    assert got(out) == sorted(want, key=repr)


def test_empty_input(spark):
    none = frame(spark, [])
    aggs = [Agg("count", "k", "n"), Agg("sum", "k", "total"), Agg("avg", "k", "mean"), Agg("max", "s", "high")]
    assert got(ops.group_aggregate(none, [], aggs)) == [(0, 0, None, None)]
    assert got(ops.group_aggregate(none, ["s"], aggs[:1])) == []
    with pytest.raises(ValueError):
        ops.group_aggregate(none, [], aggs, having=F.col("n") > 1)


def test_sort_places_nulls_lowest(spark):
    rows = [(2, "a"), (None, "b"), (1, None), (2, None)]
    assert [tuple(r) for r in ops.sort(frame(spark, rows), [("k", False), ("s", True)]).collect()] == [(2, None), (2, "a"), (1, None), (None, "b")]


def test_dml(spark, tmp_path):
    from millrace.operators import dml

    base = frame(spark, [(1, "a"), (2, None), (None, "c")])
    assert got(ops.delete_where(base, F.col("k") > 1)) == got(frame(spark, [(1, "a"), (None, "c")]))
    assert got(ops.update_where(base, {"k": F.col("k") * 10}, F.col("s").isNull())) == got(frame(spark, [(1, "a"), (20, None), (None, "c")]))
    assert ops.insert_rows(spark, base, [(9, "z")]).count() == 4
    with pytest.raises(ValueError):
        ops.insert_select(base, base.select("k"))
    dml.commit_version(base, str(tmp_path / "t"), 1)
    dml.commit_version(ops.insert_rows(spark, base, [(9, "z")]), str(tmp_path / "t"), 2)
    assert dml.read_version(spark, str(tmp_path / "t")).count() == 4
    assert dml.read_version(spark, str(tmp_path / "t"), 1).count() == 3


def test_codecs(spark):
    one = lambda text, kind: spark.createDataFrame([(text,)], "t string").select(codecs.parse(F.col("t"), kind).alias("v"))
    value = lambda text, kind: one(text, kind).first()[0]
    assert value("ab", "char(5)") == "ab   " and value(" ab ", "varchar(5)") == "ab"
    assert value("2024-1-5", "date") == datetime.date(2024, 1, 5)
    assert value("2024-1-5 3:04:05.006", "timestamp") == datetime.datetime(2024, 1, 5, 3, 4, 5, 6000)
    assert value("NULL", "int") is None and value("NaN", "double") is None and value(" 7 ", "smallint") == 7
    assert tuple(value("10:00:01 (UTC -01:30:00)", "time")) == (36001000, -5400000)
    for text, kind in (("abcdef", "char(5)"), ("x", "int"), ("25", "time")):
        with pytest.raises(PySparkException):
            value(text, kind)
    times = spark.createDataFrame([("10:00:00 (UTC +02:00:00)",), ("09:00:00",)], "t string").select(codecs.parse(F.col("t"), "time").alias("v"))
    assert [r[0] for r in times.orderBy(codecs.time_sort_key(F.col("v"))).select(codecs.render(F.col("v"), "time")).collect()] == ["10:00:00 (UTC +02:00:00)", "09:00:00 (UTC +00:00:00)"]


def test_text_table_round_trip(spark, tmp_path):
    kinds = {"a": "int", "b": "varchar(9)", "c": "time"}
    df = spark.createDataFrame([("1", "x", "1:02:03"), ("NULL", "NULL", "NULL")], "a string, b string, c string")
    typed = df.select(*[codecs.parse(F.col(c), k).alias(c) for c, k in kinds.items()])
    text_table.write_text_table(typed, str(tmp_path / "t"), kinds)
    assert got(text_table.read_text_table(spark, str(tmp_path / "t"), kinds)) == got(typed)


def test_plans(spark):
    lines, orders = catalog.table(spark, SF, "lineitem"), catalog.table(spark, SF, "orders")
    text = sql.explain(ops.table_scan(lines, ["l_orderkey"], [ops.compare("l_quantity", ">", 40)]))
    assert "GreaterThan(l_quantity,40" in text and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text
    assert "SortMergeJoin" in sql.explain(ops.merge_join(lines, orders, [("l_orderkey", "o_orderkey")]))
    assert "BroadcastHashJoin" in sql.explain(ops.index_join(lines, orders.where("o_custkey = 3"), "l_orderkey", "o_orderkey"))


def test_console_text(spark):
    assert sql.result_text(spark.createDataFrame([(1, None)], "a int, b string")).endswith("1 rows returned.")


def test_catalog(spark):
    nation = catalog.table(spark, SF, "nation")
    assert catalog.describe(nation)["n_name"]["type"] == "string"
    assert catalog.duplicate_keys(nation, "n_nationkey").count() == 0 < catalog.duplicate_keys(nation, "n_regionkey").count()


def test_stream_ingest(spark, tmp_path):
    events = catalog.table(spark, SF, "events")
    stream = ingest.stream_table(spark, SF, events.schema, "events.parquet")
    ingest.ingest(stream, ["event_id", "value"], [ops.compare("value", ">", 10)], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.where("value > 10").count()


def test_newest_version_may_be_empty(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    dml.commit_version(rows, path, 1)
    dml.commit_version(dml.truncate(rows), path, 2)
    assert dml.read_version(spark, path).count() == 0 and dml.read_version(spark, path, 1).count() == 2
    (tmp_path / "t" / "version=00000003").mkdir()  # a write that hasn't finished
    assert dml.read_version(spark, path).count() == 0
    with pytest.raises(ValueError):
        dml.read_version(spark, path, 3)
    assert dml.drop_table(spark, path)
    with pytest.raises(ValueError):
        dml.read_version(spark, path)


def test_unique_insert_raises(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert dml.insert_unique(rows, spark.createDataFrame([(3, "c")], rows.schema), "k").count() == 3
    with pytest.raises(ValueError, match="duplicate key"):
        dml.insert_unique(rows, spark.createDataFrame([(2, "c")], rows.schema), "k")


def test_sql_refuses_changes_and_names_faults(spark, tmp_path):
    from millrace.plans import sql

    spark.createDataFrame([(1, "a"), (2, "b")], "r_regionkey int, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    for text in ("INSERT INTO region VALUES (9, 'z')", "DELETE FROM region", "UPDATE region SET r_name = 'x'", "DROP TABLE region", "CREATE TABLE t AS SELECT 1"):
        with pytest.raises(sql.ParseError, match="no query"):
            sql.query(spark, str(tmp_path), text)
    with pytest.raises(sql.ParseError) as fault:
        sql.query(spark, str(tmp_path), "SELECT r_name\nFROM region WHERE )")
    assert fault.value.line == 2 and fault.value.column > 1 and fault.value.code
    rows = sql.query(spark, str(tmp_path), "SELECT r_name FROM region WHERE r_regionkey > 0 AND r_name <> 'q'")
    assert rows.count() == 2
    assert sql.same_result(rows, sql.query(spark, str(tmp_path), "SELECT r_name FROM region WHERE r_name <> 'q' AND r_regionkey > 0"))
    assert not sql.same_result(rows, sql.query(spark, str(tmp_path), "SELECT r_name FROM region"))


def test_console_shows_every_row(spark):
    from millrace.plans import sql

    assert sql.result_text(spark.range(5000)).endswith("\n4999\n5000 rows returned.")


def test_contradictions_become_empty_relations(spark):
    plan = spark.range(9).where("id > 5 AND id > 2 AND false")._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation <empty>" in plan


@pytest.mark.parametrize("text,millis,offset", [("7:05:09", 25509000, 0), ("23:59:59 (UTC +02)", 86399000, 7200000), ("00:00:00 (UTC -1:30)", 0, -5400000), ("1:00:00 (UTC +01:00:05)", 3600000, 3605000)])
def test_times(spark, text, millis, offset):
    got = spark.createDataFrame([(text,)], "t string").select(codecs.parse(F.col("t"), "time").alias("x")).first()["x"]
    assert (got["millis"], got["offset"]) == (millis, offset)


@pytest.mark.parametrize("text", ["24:00:00", "99:99:99", "1:60:00", "1:00:60", "1:2:3", "1:00:00 (UTC -13)", "1:00:00 (UTC 2)", "1:00:00(UTC +2)"])
def test_times_out_of_range(spark, text):
    with pytest.raises(Exception, match="not a TIME"):
        spark.createDataFrame([(text,)], "t string").select(codecs.parse(F.col("t"), "time")).collect()
