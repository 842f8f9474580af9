"""The registered relational queries: one per operator, and the acceptance queries r1 to r20.

Each entry has the Spark side, SQL or operators, and the SQL that states the expected result.
Sums of fractional columns are taken on decimals so that both engines agree to the last bit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.aggregates import Agg
from ..operators import aggregate, bulk, dml, joins, predicates, scan
from ..operators.sort import sort
from ..sources import catalog
from . import sql as sql_entry

Query = Callable[[SparkSession, str], DataFrame]
PARTSUPPLIER = (
    "(SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, "
    "CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS ps_availqty FROM lineitem GROUP BY l_partkey, l_suppkey)"
)
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def operator_query(oracle: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Register a function of (table getter) under its own name, with its SQL."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: catalog.table(spark, sf_dir, name))
        ORACLE[f.__name__] = oracle
        return f

    return add


def sql_query(name: str, text: str) -> None:
    """Register SQL that both engines run; `partsupplier` stands for the derived bridge."""
    QUERIES[name] = lambda spark, sf_dir: sql_entry.query(spark, sf_dir, text)
    ORACLE[name] = text.replace("partsupplier ps", f"{PARTSUPPLIER} ps")


def money(column: str) -> str:
    return f"CAST(SUM(CAST({column} AS DECIMAL(18,2))) AS DOUBLE)"


@operator_query("SELECT l_suppkey, l_partkey, l_quantity, l_partkey AS l_partkey_again FROM lineitem")
def scan_project(t):
    return scan.table_scan(t("lineitem"), ["l_suppkey", "l_partkey", "l_quantity", ("l_partkey", "l_partkey_again")])


@operator_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 10 AND l_discount < 0.05 AND l_returnflag = 'R'")
def scan_predicate(t):
    tests = [predicates.compare("l_quantity", ">=", 10), predicates.compare("l_discount", "<", 0.05), predicates.compare("l_returnflag", "=", "R")]
    return scan.table_scan(t("lineitem"), ["l_orderkey", "l_linenumber"], tests)


@operator_query("SELECT n_nationkey, n_name FROM nation WHERE n_name <> 'NATION_3'")
def predicate_neq(t):
    return scan.table_scan(t("nation"), ["n_nationkey", "n_name"], [predicates.compare("n_name", "<>", "NATION_3")])


@operator_query("SELECT l_partkey, l_suppkey, l_quantity FROM lineitem WHERE l_suppkey > 10 AND l_suppkey <= 60")
def range_between(t):
    return scan.table_scan(t("lineitem"), ["l_partkey", "l_suppkey", "l_quantity"], [predicates.between("l_suppkey", 10, 60, False, True)])


@operator_query("SELECT o_custkey FROM orders WHERE o_custkey >= 100 AND o_custkey < 200")
def index_scan_keys(t):
    return scan.index_scan(t("orders"), "o_custkey", 100, 200, True, False)


@operator_query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 77")
def index_lookup_eq(t):
    return scan.project(scan.index_lookup(t("orders"), "o_custkey", 77), ["o_orderkey", "o_totalprice"])


@operator_query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey <= 50")
def index_lookup_range(t):
    return scan.project(scan.index_range(t("orders"), "o_custkey", high=50), ["o_orderkey", "o_custkey"])


@operator_query("SELECT p_partkey, p_size FROM part WHERE p_size < 5 OR p_size > 45")
def filter_or(t):
    either = predicates.disjunction([predicates.compare("p_size", "<", 5), predicates.compare("p_size", ">", 45)])
    return scan.project(scan.filter_rows(t("part"), either), ["p_partkey", "p_size"])


@operator_query("SELECT o_orderkey, c_name FROM orders, customer WHERE o_custkey = c_custkey")
def join_equi(t):
    return joins.merge_join(t("orders"), t("customer"), [("o_custkey", "c_custkey")]).select("o_orderkey", "c_name")


@operator_query("SELECT a.n_nationkey AS low, b.n_nationkey AS high FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_theta(t):
    a, b = t("nation").alias("a"), t("nation").alias("b")
    on = predicates.conjunction([predicates.join_compare("a.n_regionkey", "=", "b.n_regionkey"), predicates.join_compare("a.n_nationkey", "<", "b.n_nationkey")])
    return joins.theta_join(a, b, on).select(F.col("a.n_nationkey").alias("low"), F.col("b.n_nationkey").alias("high"))


@operator_query("SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key FROM nation a, nation b WHERE a.n_nationkey = b.n_regionkey OR a.n_regionkey > b.n_nationkey")
def join_or(t):
    a, b = t("nation").alias("a"), t("nation").alias("b")
    on = predicates.disjunction([predicates.join_compare("a.n_nationkey", "=", "b.n_regionkey"), predicates.join_compare("a.n_regionkey", ">", "b.n_nationkey")])
    return joins.theta_join(a, b, on).select(F.col("a.n_nationkey").alias("a_key"), F.col("b.n_nationkey").alias("b_key"))


@operator_query("SELECT r_name, n_name FROM region, nation")
def join_cross(t):
    return joins.cross_join(t("region").select("r_name"), t("nation").select("n_name"))


@operator_query(f"SELECT l_orderkey, l_linenumber, ps_availqty FROM lineitem, {PARTSUPPLIER} ps WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey")
def join_composite(t):
    lines = t("lineitem")
    bridge = lines.groupBy(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).agg(
        F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("ps_availqty")
    )
    return joins.inner_join(lines, bridge, [("l_partkey", "ps_partkey"), ("l_suppkey", "ps_suppkey")]).select("l_orderkey", "l_linenumber", "ps_availqty")


@operator_query("SELECT l_orderkey, l_linenumber, s_name FROM lineitem, supplier WHERE l_suppkey = s_suppkey AND s_nationkey = 7")
def join_index_nl(t):
    few = scan.index_lookup(t("supplier"), "s_nationkey", 7)
    return joins.index_join(t("lineitem"), few, "l_suppkey", "s_suppkey").select("l_orderkey", "l_linenumber", "s_name")


@operator_query("SELECT l_orderkey, l_linenumber, r_name, p_brand FROM lineitem, part, supplier, nation, region WHERE l_partkey = p_partkey AND l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey")
def join_multiway(t):
    eq = lambda a, b: predicates.join_compare(a, "=", b)
    chain = joins.multiway_join(
        t("lineitem"), (t("part"), eq("l_partkey", "p_partkey")), (t("supplier"), eq("l_suppkey", "s_suppkey")),
        (t("nation"), eq("s_nationkey", "n_nationkey")), (t("region"), eq("n_regionkey", "r_regionkey")),
    )
    return chain.select("l_orderkey", "l_linenumber", "r_name", "p_brand")


@operator_query("SELECT o_orderkey, l_linenumber FROM orders, lineitem WHERE l_orderkey = o_orderkey AND l_extendedprice > o_totalprice / 4")
def correlated_filter(t):
    on = (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_extendedprice") > F.col("o_totalprice") / 4)
    return joins.correlated_filter(t("lineitem"), t("orders"), on).select("o_orderkey", "l_linenumber")


FIVE = [Agg("count", "c_custkey", "n"), Agg("sum", "c_acctbal", "total", 2), Agg("avg", "c_acctbal", "mean", 2), Agg("min", "c_acctbal", "low"), Agg("max", "c_acctbal", "high")]
FIVE_SQL = f"COUNT(c_custkey) AS n, {money('c_acctbal')} AS total, {money('c_acctbal')} / COUNT(c_acctbal) AS mean, MIN(c_acctbal) AS low, MAX(c_acctbal) AS high"


@operator_query(f"SELECT c_nationkey, {FIVE_SQL} FROM customer GROUP BY c_nationkey")
def group_multi_agg(t):
    return aggregate.group_aggregate(t("customer"), ["c_nationkey"], FIVE)


@operator_query(f"SELECT {FIVE_SQL} FROM customer")
def agg_global(t):
    return aggregate.group_aggregate(t("customer"), [], FIVE)


@operator_query("SELECT c_nationkey, COUNT(c_custkey) AS n FROM customer WHERE c_custkey < 0 GROUP BY c_nationkey")
def agg_empty_grouped(t):
    return aggregate.group_aggregate(t("customer").where("c_custkey < 0"), ["c_nationkey"], [Agg("count", "c_custkey", "n")])


@operator_query("SELECT COUNT(c_custkey) AS n, COALESCE(CAST(SUM(c_custkey) AS BIGINT), 0) AS total, MIN(c_name) AS low FROM customer WHERE c_custkey < 0")
def agg_empty_global(t):
    return aggregate.group_aggregate(t("customer").where("c_custkey < 0"), [], [Agg("count", "c_custkey", "n"), Agg("sum", "c_custkey", "total"), Agg("min", "c_name", "low")])


@operator_query("SELECT p_brand, CAST(SUM(p_size) // COUNT(p_size) AS BIGINT) AS mean_size FROM part GROUP BY p_brand")
def avg_int_trunc(t):
    return aggregate.group_aggregate(t("part"), ["p_brand"], [Agg("avg", "p_size", "mean_size")])


@operator_query(f"SELECT o_custkey, {money('o_totalprice')} AS total FROM orders GROUP BY o_custkey HAVING {money('o_totalprice')} > 1000000")
def having_alias(t):
    return aggregate.group_aggregate(t("orders"), ["o_custkey"], [Agg("sum", "o_totalprice", "total", 2)], predicates.compare("total", ">", 1000000))


@operator_query("SELECT s_suppkey, s_nationkey, s_name FROM supplier ORDER BY s_nationkey DESC NULLS LAST, s_name ASC NULLS FIRST")
def sort_multi_key(t):
    return sort(t("supplier").select("s_suppkey", "s_nationkey", "s_name"), [("s_nationkey", False), ("s_name", True)])


@operator_query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_custkey NULLS FIRST, o_totalprice NULLS FIRST, o_orderkey NULLS FIRST")
def sort_external(t):
    return sort(t("orders").select("o_orderkey", "o_custkey", "o_totalprice"), [("o_custkey", True), ("o_totalprice", True), ("o_orderkey", True)])


@operator_query("SELECT r_name FROM region ORDER BY r_name")
def sort_list(t):
    return sort(t("region").select("r_name"), [("r_name", True)])


@operator_query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_linenumber * 2 + 1 AS odd, l_quantity / 2 AS half FROM lineitem")
def expr_arith(t):
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        (F.col("l_linenumber") * 2 + 1).alias("odd"), (F.col("l_quantity") / 2).alias("half"),
    )


@operator_query("SELECT n_nationkey, n_nationkey + (7 // 2) * 4 - 1 AS shifted FROM nation WHERE n_nationkey < 2 * 3 + 4")
def const_fold(t):
    folded = F.col("n_nationkey") + (F.call_function("div", F.lit(7), F.lit(2)) * 4 - 1).cast("int")
    return t("nation").where(F.col("n_nationkey") < F.lit(2) * 3 + 4).select("n_nationkey", folded.alias("shifted"))


@operator_query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT r_regionkey + 100, r_name, r_regionkey FROM region")
def insert_select(t):
    return dml.insert_select(t("nation"), t("region").select(F.col("r_regionkey") + 100, "r_name", "r_regionkey"))


@operator_query("SELECT r_regionkey, r_name FROM region UNION ALL VALUES (90, 'NORTH'), (91, NULL)")
def insert_values(t):
    region = t("region")
    return dml.insert_rows(region.sparkSession, region, [(90, "NORTH"), (91, None)])


@operator_query("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_nationkey = 3 THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_nationkey = 3 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_where(t):
    return dml.update_where(t("customer"), {"c_acctbal": F.col("c_acctbal") + 100, "c_mktsegment": F.lit("MOVED")}, predicates.compare("c_nationkey", "=", 3))


@operator_query("SELECT * FROM supplier WHERE NOT (s_acctbal < 0)")
def delete_where(t):
    return dml.delete_where(t("supplier"), predicates.compare("s_acctbal", "<", 0))


@operator_query("SELECT r_regionkey, r_name FROM region WHERE FALSE")
def delete_all(t):
    return dml.delete_where(t("region"), F.lit(True))


@operator_query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT r_regionkey + 100, r_name, r_regionkey FROM region")
def insert_unique(t):
    return dml.insert_unique(t("nation"), t("region").select(F.col("r_regionkey") + 100, "r_name", "r_regionkey"), "n_nationkey")


@operator_query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey > 20")
def predicate_inverted(t):
    return scan.table_scan(t("nation"), ["n_nationkey", "n_name"], [predicates.compare("n_nationkey", predicates.invert("<="), 20)])


@operator_query("SELECT COUNT(*) AS n FROM lineitem")
def count_tuples(t):
    return aggregate.count_tuples(t("lineitem"))


@operator_query("SELECT p_partkey, p_name FROM part")
def bulk_identity(t):
    return bulk.identity(bulk.splits(t("part").select("p_partkey", "p_name"), 4))


@operator_query("SELECT s_suppkey FROM supplier")
def bulk_forward_left(t):
    return bulk.forward_left(t("supplier").select("s_suppkey"), t("customer").select("c_custkey"))


@operator_query(f"SELECT l_returnflag, COUNT(*) AS n, {money('l_quantity')} AS qty FROM lineitem WHERE l_tax > 0.02 GROUP BY l_returnflag")
def bulk_group(t):
    few = scan.table_scan(t("lineitem"), ["l_returnflag", "l_quantity"], [predicates.compare("l_tax", ">", 0.02)])
    return aggregate.group_aggregate(few, ["l_returnflag"], [Agg("count", "*", "n"), Agg("sum", "l_quantity", "qty", 2)])


@operator_query("SELECT column_name, cardinality, distinct_values, low_key, high_key FROM (SELECT 's_suppkey' AS column_name, COUNT(*) AS cardinality, COUNT(DISTINCT s_suppkey) AS distinct_values, CAST(MIN(s_suppkey) AS VARCHAR) AS low_key, CAST(MAX(s_suppkey) AS VARCHAR) AS high_key FROM supplier UNION ALL SELECT 's_nationkey', COUNT(*), COUNT(DISTINCT s_nationkey), CAST(MIN(s_nationkey) AS VARCHAR), CAST(MAX(s_nationkey) AS VARCHAR) FROM supplier) s")
def table_statistics(t):
    return catalog.statistics(t("supplier"), ["s_suppkey", "s_nationkey"])


sql_query("r1", "SELECT li.l_partkey AS l_partkey, li.l_suppkey AS l_suppkey, li.l_quantity AS l_quantity FROM lineitem li WHERE li.l_partkey = 100")
sql_query("r2", "SELECT li.l_partkey AS l_partkey, li.l_suppkey AS l_suppkey, li.l_quantity AS l_quantity FROM lineitem li WHERE li.l_suppkey > 10 AND li.l_suppkey < 50")
sql_query("r3", f"SELECT ps.ps_partkey AS ps_partkey, {money('ps.ps_availqty')} AS ps_availqty FROM partsupplier ps GROUP BY ps.ps_partkey")
sql_query("r4", "SELECT p.p_name AS partname, s.s_name AS suppname, ps.ps_availqty AS availqty FROM partsupplier ps, part p, supplier s WHERE ps.ps_partkey = p.p_partkey AND ps.ps_suppkey = s.s_suppkey AND p.p_partkey >= 1 AND p.p_partkey <= 100")
for _name, _top in (("r5", 5), ("r6", 25)):
    sql_query(_name, f"SELECT ps.ps_availqty AS ps_availqty, l.l_quantity AS l_quantity, o.o_orderdate AS o_orderdate FROM partsupplier ps, lineitem l, orders o WHERE ps.ps_partkey = l.l_partkey AND ps.ps_suppkey = l.l_suppkey AND o.o_orderkey = l.l_orderkey AND o.o_custkey >= 1 AND o.o_custkey <= {_top}")
sql_query("r7", "SELECT p.p_partkey AS p_partkey, p.p_name AS p_name, ps.ps_availqty AS ps_availqty, l.l_quantity AS l_quantity, l.l_tax AS l_tax FROM partsupplier ps, part p, lineitem l WHERE p.p_partkey = ps.ps_partkey AND ps.ps_partkey = l.l_partkey AND ps.ps_suppkey >= 1 AND ps.ps_suppkey <= 20 AND p.p_size > 42 ORDER BY p_partkey ASC")
sql_query("r8", "SELECT l.l_extendedprice AS l_extendedprice, o.o_totalprice AS o_totalprice, c.c_name AS c_name, p.p_name AS p_name FROM lineitem l, orders o, customer c, part p WHERE p.p_partkey = l.l_partkey AND o.o_custkey = c.c_custkey AND l.l_orderkey = o.o_orderkey AND l.l_extendedprice < o.o_totalprice AND c.c_custkey < 100")
sql_query("r9", f"SELECT r.r_regionkey AS regionkey, {money('o.o_totalprice')} AS sum_totalprice FROM orders o, customer c, nation n, region r WHERE n.n_regionkey = r.r_regionkey AND c.c_nationkey = n.n_nationkey AND o.o_custkey = c.c_custkey GROUP BY r.r_regionkey HAVING sum_totalprice > 1000")
EUROPE = (
    f"SELECT n.n_nationkey AS n_nationkey, n.n_name AS n_name, {money('l.l_extendedprice')} AS sum_extendedprice "
    "FROM lineitem l, orders o, customer c, nation n, region r "
    "WHERE n.n_regionkey = r.r_regionkey AND c.c_nationkey = n.n_nationkey AND o.o_custkey = c.c_custkey AND l.l_orderkey = o.o_orderkey AND r.r_name = 'EUROPE' "
    "GROUP BY n.n_nationkey, n.n_name HAVING sum_extendedprice > 1000 ORDER BY n_nationkey ASC, n_name DESC"
)
sql_query("r10", EUROPE)
sql_query("r11", EUROPE + ", sum_extendedprice ASC")
BRIDGED = "r.r_regionkey = n.n_regionkey AND n.n_nationkey = s.s_nationkey AND s.s_suppkey = ps.ps_suppkey AND ps.ps_partkey = p.p_partkey"
sql_query("r12", f"SELECT r.r_name AS r_name, p.p_brand AS p_brand, s.s_name AS s_name, p.p_retailprice AS p_retailprice FROM supplier s, nation n, region r, partsupplier ps, part p, (SELECT MIN(p.p_retailprice) AS min_retail, r.r_name AS r_name, p.p_brand AS p_brand FROM supplier s, nation n, region r, partsupplier ps, part p WHERE {BRIDGED} GROUP BY r.r_name, p.p_brand) best WHERE {BRIDGED} AND best.min_retail = p.p_retailprice AND best.p_brand = p.p_brand AND best.r_name = r.r_name")
sql_query("r13_scan_join", "SELECT c.c_name AS c_name, o.o_orderkey AS o_orderkey FROM customer c, orders o WHERE c.c_custkey = o.o_custkey AND c.c_acctbal > 9000")
sql_query("r14_index_join", "SELECT o.o_orderkey AS o_orderkey, c.c_mktsegment AS c_mktsegment FROM orders o, customer c WHERE o.o_custkey = c.c_custkey AND c.c_custkey >= 5 AND c.c_custkey <= 9")
sql_query("r15_index_join_filter", "SELECT o.o_orderkey AS o_orderkey, l.l_linenumber AS l_linenumber FROM orders o, lineitem l WHERE o.o_orderkey = l.l_orderkey AND o.o_orderpriority = '1-URGENT' AND l.l_returnflag = 'A'")
sql_query("r16_correlated_tree", f"SELECT s.s_name AS s_name, n.n_name AS n_name, p.p_brand AS p_brand, ps.ps_availqty AS ps_availqty FROM region r, nation n, supplier s, partsupplier ps, part p WHERE {BRIDGED} AND p.p_size = 11 AND r.r_regionkey < 2")
sql_query("r17_merge_chain", f"SELECT c.c_nationkey AS c_nationkey, {money('l.l_quantity')} AS qty FROM customer c, orders o, lineitem l WHERE c.c_custkey = o.o_custkey AND o.o_orderkey = l.l_orderkey GROUP BY c.c_nationkey")
sql_query("r18_grouped_customers", f"SELECT c.c_nationkey AS c_nationkey, COUNT(c.c_custkey) AS n, {money('c.c_acctbal')} AS total, MIN(c.c_acctbal) AS low, MAX(c.c_acctbal) AS high FROM customer c GROUP BY c.c_nationkey")
sql_query("r19_empty_grouped", "SELECT c.c_nationkey AS c_nationkey, MAX(c.c_acctbal) AS high FROM customer c WHERE c.c_custkey < 0 GROUP BY c.c_nationkey")
sql_query("r20_empty_global", "SELECT COUNT(c.c_custkey) AS n, MAX(c.c_acctbal) AS high FROM customer c WHERE c.c_custkey < 0")
sql_query("from_subquery", f"SELECT big.o_custkey AS o_custkey, c.c_name AS c_name, big.total AS total FROM customer c, (SELECT o.o_custkey AS o_custkey, {money('o.o_totalprice')} AS total FROM orders o GROUP BY o.o_custkey) big WHERE big.o_custkey = c.c_custkey AND big.total > 500000")

FLAGSHIP = "r10"
