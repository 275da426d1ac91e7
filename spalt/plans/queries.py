"""The library's queries over the given tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spalt.errors import ConstraintError
from spalt.functions import composites as C
from spalt.functions import scalars as S
from spalt.functions import values as V
from spalt.operators import aggregates as A
from spalt.operators import joins as J
from spalt.operators import relational as R
from spalt.operators import subqueries as Q
from spalt.sources import tables
from spalt.sources.declared import Rule, add_column, alter_domain, declared, drop_column, rename_column, set_default, set_nullable, set_type, with_domains
from spalt.sources.stored import Stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    return R.scan(spark, d, name, columns or None)


# Scans, filters, projections


@query("SELECT n_nationkey, n_name FROM nation")
def scan_project(spark, d):
    return t(spark, d, "nation", "n_nationkey", "n_name")


@query("SELECT o_orderkey, o_custkey // 7 AS q, o_totalprice * 2 AS d, -o_custkey AS neg FROM orders")
def compute_arith(spark, d):
    o = t(spark, d, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    return R.compute(o, {"o_orderkey": "o_orderkey", "q": V.divide_int(F.col("o_custkey"), F.lit(7)), "d": F.col("o_totalprice") * 2, "neg": -F.col("o_custkey")})


@query("SELECT CAST(1 + 2 AS BIGINT) AS a, CAST(7 // 2 AS BIGINT) AS b, CAST(-3 AS BIGINT) AS c, (SELECT count(*) FROM region) AS n")
def unit_row(spark, d):
    n = t(spark, d, "region", "r_regionkey").agg(A.count_all().alias("n")).scalar()
    return R.unit(spark, {"a": F.lit(1).cast("long") + 2, "b": V.divide_int(F.lit(7), F.lit(2)), "c": V.divide_int(F.lit(-7), F.lit(2)), "n": n})


@query("SELECT c_custkey, c_acctbal FROM customer WHERE (c_acctbal > 5000 OR c_mktsegment = 'BUILDING') AND c_nationkey IN (1, 3, 5, 7) AND c_name IS NOT NULL")
def filter_3vl(spark, d):
    c = t(spark, d, "customer")
    keep = ((F.col("c_acctbal") > 5000) | (F.col("c_mktsegment") == "BUILDING")) & F.col("c_nationkey").isin(1, 3, 5, 7) & F.col("c_name").isNotNull()
    return c.where(keep).select("c_custkey", "c_acctbal")


@query("SELECT * FROM orders WHERE o_orderkey = 7")
def lookup(spark, d):
    return R.lookup(t(spark, d, "orders"), "o_orderkey", 7)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200")
def range_half_open(spark, d):
    return R.in_range(t(spark, d, "orders", "o_orderkey", "o_totalprice"), "o_orderkey", 100, 200, include_high=False)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey > 500")
def range_open(spark, d):
    return R.in_range(t(spark, d, "orders", "o_orderkey"), "o_orderkey", low=500, include_low=False)


@query("SELECT p_partkey, length(p_name) AS n, length(p_type) AS m FROM part")
def fn_length(spark, d):
    return t(spark, d, "part").select("p_partkey", V.length(F.col("p_name")).cast("long").alias("n"), V.length(F.col("p_type")).cast("long").alias("m"))


@query("SELECT c_custkey, NOT (c_acctbal > 0) AS debt FROM customer")
def fn_not(spark, d):
    return t(spark, d, "customer").select("c_custkey", V.negate(F.col("c_acctbal") > 0).alias("debt"))


@query("SELECT l_orderkey, l_linenumber, round_even(l_extendedprice * (1 - l_discount), 1) AS net FROM lineitem")
def fn_decimal(spark, d):
    li = t(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    return li.select("l_orderkey", "l_linenumber", V.decimal(F.col("l_extendedprice") * (1 - F.col("l_discount")), 12, 1).alias("net"))


# Joins


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_inner(spark, d):
    return J.inner(t(spark, d, "nation"), t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 100000")
def join_left(spark, d):
    c, o = t(spark, d, "customer", "c_custkey"), t(spark, d, "orders", "o_custkey", "o_orderkey", "o_totalprice")
    return J.left(c, o, (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_totalprice") > 100000)).select("c_custkey", "o_orderkey")


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_theta(spark, d):
    a, b = t(spark, d, "nation").alias("a"), t(spark, d, "nation").alias("b")
    on = (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    return J.inner(a, b, on).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@query("SELECT r_name, count(*) AS n, sum(o_totalprice) AS total FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY r_name")
def join_chain(spark, d):
    # summed for each customer before it meets nation and region
    per = A.aggregate(t(spark, d, "orders", "o_custkey", "o_totalprice"), ["o_custkey"], {"k": A.count_all(), "s": F.sum("o_totalprice")})
    j = J.inner(per, t(spark, d, "customer", "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    j = A.aggregate(j, ["c_nationkey"], {"k": F.sum("k"), "s": F.sum("s")})
    j = J.inner(J.inner(j, t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")), t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return A.aggregate(j, ["r_name"], {"n": F.sum("k"), "total": F.sum("s")})


@query("SELECT a.o_orderkey AS a, b.o_orderkey AS b FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey WHERE a.o_orderkey < b.o_orderkey AND a.o_orderpriority = b.o_orderpriority AND a.o_totalprice > 3 * b.o_totalprice")
def join_self(spark, d):
    o = t(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice")
    a, b = o.alias("a"), o.alias("b")
    j = J.inner(a, b, (F.col("a.o_custkey") == F.col("b.o_custkey")) & (F.col("a.o_orderpriority") == F.col("b.o_orderpriority")))
    return j.where((F.col("a.o_orderkey") < F.col("b.o_orderkey")) & (F.col("a.o_totalprice") > 3 * F.col("b.o_totalprice"))).select(F.col("a.o_orderkey").alias("a"), F.col("b.o_orderkey").alias("b"))


@query("SELECT c_custkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) x ON c_custkey = o_custkey WHERE o_orderkey IS NULL")
def left_anti_null(spark, d):
    dear = t(spark, d, "orders", "o_custkey", "o_orderkey", "o_totalprice").where("o_totalprice > 200000")
    j = J.left(t(spark, d, "customer", "c_custkey"), dear, F.col("c_custkey") == F.col("o_custkey"))
    return j.where(F.col("o_orderkey").isNull()).select("c_custkey")


@query("SELECT s_suppkey, c_custkey FROM supplier LEFT JOIN customer ON s_nationkey = c_nationkey AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 40 * abs(s_acctbal))")
def join_on_subquery(spark, d):
    s, c, o = t(spark, d, "supplier", "s_suppkey", "s_nationkey", "s_acctbal"), t(spark, d, "customer", "c_custkey", "c_nationkey"), t(spark, d, "orders", "o_custkey", "o_totalprice")
    # one row for each customer that has an order: the subquery is part of the pairing join
    most = c.join(o.groupBy("o_custkey").agg(F.max("o_totalprice").alias("most")), F.col("o_custkey") == F.col("c_custkey"))
    most = most.select("c_custkey", "c_nationkey", "most")
    return J.above(s, most, "s_nationkey", "c_nationkey", "most", 40 * F.abs("s_acctbal")).select("s_suppkey", "c_custkey")


@query("SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 45 AND EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = l_suppkey AND s_acctbal > 0) AND o_totalprice > 150000")
def join_left_matching(spark, d):
    o, li = t(spark, d, "orders", "o_orderkey", "o_totalprice"), t(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    rich = t(spark, d, "supplier", "s_suppkey", "s_acctbal").where("s_acctbal > 0")
    keep = lambda pairs: J.exists(pairs.where("l_quantity > 45 AND o_totalprice > 150000"), rich, F.col("s_suppkey") == F.col("l_suppkey"))
    return J.left_matching(o, li, F.col("l_orderkey") == F.col("o_orderkey"), keep).select("o_orderkey", "l_linenumber")


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_acctbal BETWEEN s_acctbal - 2 AND s_acctbal + 2")
def join_range(spark, d):
    """A join without an equality."""
    s = t(spark, d, "supplier", "s_suppkey", "s_acctbal").select("s_suppkey", (F.col("s_acctbal") - 2).alias("low"), (F.col("s_acctbal") + 2).alias("high"))
    return J.within(t(spark, d, "customer", "c_custkey", "c_acctbal"), s, "c_acctbal", "low", "high", 4).select("c_custkey", "s_suppkey")


@query("SELECT c_nationkey, count(*) AS n, max(o_totalprice) AS hi FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_nationkey")
def join_salted(spark, d):
    c, o = t(spark, d, "customer", "c_custkey", "c_nationkey"), t(spark, d, "orders", "o_custkey", "o_totalprice")
    per = A.aggregate(o, ["o_custkey"], {"k": A.count_all(), "most": F.max("o_totalprice")})
    j = J.salted(c, per, "c_custkey", "o_custkey", 4, how="left")
    return A.aggregate(j, ["c_nationkey"], {"n": F.sum(F.coalesce("k", F.lit(1))), "hi": F.max("most")})


# Aggregates


@query("SELECT count(*) AS n, count(o_orderstatus) AS m, sum(o_totalprice) AS s, avg(o_totalprice) AS a, min(o_orderpriority) AS lo, max(o_orderpriority) AS hi FROM orders")
def agg_global(spark, d):
    return A.aggregate(t(spark, d, "orders"), [], {"n": A.count_all(), "m": F.count("o_orderstatus"), "s": F.sum("o_totalprice"), "a": F.avg("o_totalprice"), "lo": F.min("o_orderpriority"), "hi": F.max("o_orderpriority")})


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, avg(l_discount) AS avg_disc, count(*) AS n FROM lineitem WHERE l_quantity > 10 GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus")
def agg_group(spark, d):
    li = t(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_discount").where("l_quantity > 10")
    out = A.aggregate(li, ["l_returnflag", "l_linestatus"], {"sum_qty": F.sum("l_quantity"), "avg_disc": F.avg("l_discount"), "n": A.count_all()})
    return R.order(out, "l_returnflag", "l_linestatus")


@query("SELECT count(*) AS n, sum(o_totalprice) AS s, max(o_orderkey) AS hi FROM orders WHERE o_orderkey < 0")
def agg_empty(spark, d):
    return A.aggregate(t(spark, d, "orders").where("o_orderkey < 0"), [], {"n": A.count_all(), "s": F.sum("o_totalprice"), "hi": F.max("o_orderkey")})


@query("SELECT l_shipdate, sum(l_extendedprice * (1 - l_discount)) / count(*) AS per_line, CAST(max(l_linenumber) - min(l_linenumber) + count(*) AS BIGINT) AS k FROM lineitem GROUP BY l_shipdate")
def agg_expr(spark, d):
    li = t(spark, d, "lineitem", "l_shipdate", "l_extendedprice", "l_discount", "l_linenumber")
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return A.aggregate(li, ["l_shipdate"], {"per_line": revenue / A.count_all(), "k": (F.max("l_linenumber") - F.min("l_linenumber") + A.count_all()).cast("long")})


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 1500000 AND count(*) > 3")
def having_group(spark, d):
    return A.aggregate(t(spark, d, "orders", "o_custkey", "o_totalprice"), ["o_custkey"], {"n": A.count_all()}, having=(F.col("s") > 1500000) & (F.col("n") > 3), hidden={"s": F.sum("o_totalprice")})


@query("SELECT count(*) AS n FROM orders HAVING max(o_totalprice) < 0")
def having_implicit(spark, d):
    return A.aggregate(t(spark, d, "orders", "o_totalprice"), [], {"n": A.count_all()}, having=F.col("m") < 0, hidden={"m": F.max("o_totalprice")})


@query("SELECT x, count(*) AS n FROM (SELECT CASE WHEN c_acctbal > 0 THEN c_nationkey END AS x FROM customer) GROUP BY x")
def group_null(spark, d):
    c = t(spark, d, "customer", "c_acctbal", "c_nationkey")
    return A.aggregate(c.select(F.when(F.col("c_acctbal") > 0, F.col("c_nationkey")).alias("x")), ["x"], {"n": A.count_all()})


# Distinct, order, limit


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def distinct(spark, d):
    return R.distinct(t(spark, d, "customer"), {"c_mktsegment": "c_mktsegment", "c_nationkey": "c_nationkey"})


@query("SELECT DISTINCT o_custkey AS k FROM orders ORDER BY k DESC NULLS LAST")
def distinct_order(spark, d):
    return R.distinct(t(spark, d, "orders"), {"k": "o_custkey"}, keys=["-k"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS FIRST LIMIT 25")
def sort_topk(spark, d):
    return R.top(t(spark, d, "orders", "o_orderkey", "o_totalprice"), 25, "-o_totalprice", "o_orderkey")


@query("SELECT c_nationkey, c_custkey FROM customer ORDER BY 1 DESC NULLS LAST, 2 NULLS FIRST LIMIT 40")
def sort_position(spark, d):
    return R.top(t(spark, d, "customer", "c_nationkey", "c_custkey"), 40, -1, 2)


@query("SELECT o_orderkey, o_totalprice / 2 AS half FROM orders ORDER BY half NULLS FIRST, o_orderkey LIMIT 30")
def sort_alias(spark, d):
    return R.top(R.compute(t(spark, d, "orders"), {"o_orderkey": "o_orderkey", "half": V.divide(F.col("o_totalprice"), F.lit(2))}), 30, "half", "o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_extendedprice * l_discount DESC NULLS LAST, l_orderkey, l_linenumber LIMIT 20")
def sort_expr(spark, d):
    key = (F.col("l_extendedprice") * F.col("l_discount")).desc_nulls_last()
    return R.top(t(spark, d, "lineitem"), 20, key, "l_orderkey", "l_linenumber", then={"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber"})


@query("SELECT c_custkey, x FROM (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS x FROM customer) ORDER BY x NULLS FIRST, c_custkey LIMIT 50")
def sort_nulls(spark, d):
    c = t(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("x"))
    return R.top(c, 50, "x", "c_custkey")


@query("SELECT o_orderkey, 100 / (o_orderkey - 0) AS r FROM orders WHERE o_orderkey > 0 ORDER BY o_orderkey NULLS FIRST LIMIT 5")
def limit_deferred(spark, d):
    o = t(spark, d, "orders", "o_orderkey").where("o_orderkey > 0")
    return R.top(o, 5, "o_orderkey", then={"o_orderkey": "o_orderkey", "r": V.divide(F.lit(100), F.col("o_orderkey"))})


# Derived tables and common table expressions


@query("SELECT k, n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) x WHERE n > 15")
def derived(spark, d):
    x = A.aggregate(t(spark, d, "orders", "o_custkey"), ["o_custkey"], {"n": A.count_all()})
    return x.select(F.col("o_custkey").alias("k"), "n").where("n > 15")


@query("WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT c_name, n FROM per JOIN customer ON c_custkey = o_custkey")
def cte(spark, d):
    big = t(spark, d, "orders", "o_custkey", "o_totalprice").where("o_totalprice > 200000")
    per = A.aggregate(big, ["o_custkey"], {"n": A.count_all()})
    return J.inner(per, t(spark, d, "customer", "c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey")).select("c_name", "n")


@query("WITH s AS (SELECT o_custkey AS k, sum(o_totalprice) AS v FROM orders GROUP BY o_custkey) SELECT k, v FROM s WHERE v > (SELECT 2 * avg(v) FROM s)")
def cte_reuse(spark, d):
    s = A.aggregate(t(spark, d, "orders", "o_custkey", "o_totalprice"), ["o_custkey"], {"v": F.sum("o_totalprice")}).withColumnRenamed("o_custkey", "k")
    return s.where(F.col("v") > s.agg((2 * F.avg("v")).alias("a")).scalar())


@query("WITH x(a, b) AS (SELECT n_nationkey, n_name FROM nation) SELECT b, a FROM x WHERE a >= 5")
def cte_columns(spark, d):
    return t(spark, d, "nation", "n_nationkey", "n_name").toDF("a", "b").where("a >= 5").select("b", "a")


# Subqueries


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def sub_in(spark, d):
    return J.is_in(t(spark, d, "customer", "c_custkey"), "c_custkey", t(spark, d, "orders", "o_custkey", "o_totalprice").where("o_totalprice > 250000"), "o_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def sub_not_in(spark, d):
    return J.not_in(t(spark, d, "customer", "c_custkey"), "c_custkey", t(spark, d, "orders", "o_custkey", "o_totalprice").where("o_totalprice > 200000"), "o_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT CASE WHEN o_totalprice > 1000 THEN o_custkey END FROM orders)")
def sub_not_in_null(spark, d):
    o = t(spark, d, "orders", "o_custkey", "o_totalprice").select(F.when(F.col("o_totalprice") > 1000, F.col("o_custkey")).alias("k"))
    return J.not_in(t(spark, d, "customer", "c_custkey"), "c_custkey", o, "k")


@query("SELECT n_nationkey, (CASE WHEN n_nationkey > 3 THEN n_nationkey END) IN (SELECT o_orderkey FROM orders WHERE o_orderkey < 0) AS found FROM nation")
def sub_in_empty(spark, d):
    n = t(spark, d, "nation", "n_nationkey").withColumn("x", F.when(F.col("n_nationkey") > 3, F.col("n_nationkey").cast("long")))
    return Q.with_in(n, "found", "x", t(spark, d, "orders", "o_orderkey").where("o_orderkey < 0"), "o_orderkey").select("n_nationkey", "found")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def sub_exists(spark, d):
    o = t(spark, d, "orders", "o_custkey", "o_orderstatus").where("o_orderstatus = 'F'")
    return J.exists(t(spark, d, "customer", "c_custkey", "c_name"), o, F.col("o_custkey") == F.col("c_custkey"))


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def sub_not_exists(spark, d):
    li = t(spark, d, "lineitem", "l_partkey", "l_quantity").where("l_quantity > 45")
    return J.not_exists(t(spark, d, "part", "p_partkey"), li, F.col("l_partkey") == F.col("p_partkey"))


@query("SELECT DISTINCT l1.l_orderkey AS l_orderkey FROM lineitem l1 WHERE EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)")
def sub_exists_noneq(spark, d):
    li = t(spark, d, "lineitem", "l_orderkey", "l_suppkey")
    return R.distinct(Q.exists_where(li, {"l_orderkey": "l_orderkey"}, "l_suppkey", "<>", li, "l_suppkey"), {"l_orderkey": "l_orderkey"})


@query("SELECT c_custkey FROM customer a WHERE NOT EXISTS (SELECT 1 FROM customer b WHERE b.c_nationkey = a.c_nationkey AND b.c_acctbal > a.c_acctbal)")
def sub_not_exists_less(spark, d):
    c = t(spark, d, "customer", "c_custkey", "c_nationkey", "c_acctbal")
    return Q.exists_where(c, {"c_nationkey": "c_nationkey"}, "c_acctbal", "<", c, "c_acctbal", negate=True).select("c_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders)")
def sub_scalar(spark, d):
    o = t(spark, d, "orders", "o_orderkey", "o_totalprice")
    return o.where(F.col("o_totalprice") > Q.scalar(o.agg((1.5 * F.avg("o_totalprice")).alias("v")), "v"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity < (SELECT 0.2 * avg(x.l_quantity) FROM lineitem x WHERE x.l_partkey = lineitem.l_partkey)")
def sub_scalar_corr(spark, d):
    li = t(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return Q.with_aggregate(li, "v", li, {"l_partkey": "l_partkey"}, 0.2 * F.avg("l_quantity")).where("l_quantity < v").select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS hi FROM customer")
def sub_select_list(spark, d):
    c, o = t(spark, d, "customer", "c_custkey"), t(spark, d, "orders", "o_custkey", "o_totalprice")
    both = Q.with_aggregate(c, "v", o, {"c_custkey": "o_custkey"}, F.struct(A.count_all().alias("n"), F.max("o_totalprice").alias("hi")))
    return both.select("c_custkey", F.coalesce("v.n", F.lit(0).cast("long")).alias("n"), F.col("v.hi").alias("hi"))


@query("SELECT n_name, (SELECT r_name FROM region WHERE r_regionkey = n_regionkey) AS r FROM nation")
def sub_scalar_row(spark, d):
    return Q.with_scalar(t(spark, d, "nation"), "r", t(spark, d, "region"), {"n_regionkey": "r_regionkey"}, "r_name").select("n_name", "r")


@query("SELECT c_custkey FROM customer ORDER BY (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) DESC, c_custkey LIMIT 20")
def sub_order_by(spark, d):
    c = Q.with_aggregate(t(spark, d, "customer", "c_custkey"), "n", t(spark, d, "orders", "o_custkey"), {"c_custkey": "o_custkey"}, A.count_all(), F.lit(0))
    return R.top(c, 20, "-n", "c_custkey", then={"c_custkey": "c_custkey"})


@query("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > (SELECT avg(k) FROM (SELECT count(*) AS k FROM customer GROUP BY c_nationkey))")
def sub_having(spark, d):
    per = A.aggregate(t(spark, d, "customer", "c_nationkey"), ["c_nationkey"], {"n": A.count_all()})
    return per.where(F.col("n") > per.agg(F.avg("n").alias("a")).scalar())


@query("SELECT c_custkey, c_acctbal > ANY (SELECT s_acctbal FROM supplier) AS v FROM customer")
def any_gt(spark, d):
    return Q.with_quantified(t(spark, d, "customer", "c_custkey", "c_acctbal"), "v", "c_acctbal", ">", "ANY", t(spark, d, "supplier"), "s_acctbal").select("c_custkey", "v")


@query("SELECT c_custkey, c_acctbal >= ALL (SELECT s_acctbal FROM supplier) AS v FROM customer")
def all_ge(spark, d):
    return Q.with_quantified(t(spark, d, "customer", "c_custkey", "c_acctbal"), "v", "c_acctbal", ">=", "ALL", t(spark, d, "supplier"), "s_acctbal").select("c_custkey", "v")


@query("SELECT s_suppkey, s_suppkey = ANY (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49) AS v FROM supplier")
def any_eq(spark, d):
    return Q.with_quantified(t(spark, d, "supplier", "s_suppkey"), "v", "s_suppkey", "=", "ANY", t(spark, d, "lineitem").where("l_quantity > 49"), "l_suppkey").select("s_suppkey", "v")


@query("SELECT p_partkey, p_partkey <> ALL (SELECT CASE WHEN l_quantity > 2 THEN l_partkey END FROM lineitem WHERE l_quantity > 1.5 OR l_orderkey < 2000) AS v FROM part")
def all_ne(spark, d):
    li = t(spark, d, "lineitem").where("l_quantity > 1.5 OR l_orderkey < 2000").select(F.when(F.col("l_quantity") > 2, F.col("l_partkey")).alias("k"))
    return Q.with_quantified(t(spark, d, "part", "p_partkey"), "v", "p_partkey", "<>", "ALL", li, "k").select("p_partkey", "v")


@query("SELECT n_nationkey, n_nationkey > ANY (SELECT r_regionkey FROM region WHERE r_regionkey < 0) AS a, n_nationkey > ALL (SELECT r_regionkey FROM region WHERE r_regionkey < 0) AS b FROM nation")
def any_empty(spark, d):
    none = t(spark, d, "region").where("r_regionkey < 0")
    a = Q.with_quantified(t(spark, d, "nation", "n_nationkey"), "a", "n_nationkey", ">", "ANY", none, "r_regionkey")
    return Q.with_quantified(a, "b", "n_nationkey", ">", "ALL", none, "r_regionkey").select("n_nationkey", "a", "b")


@query("SELECT n_nationkey, n_nationkey > ALL (SELECT CASE WHEN r_regionkey > 1 THEN r_regionkey END FROM region) AS v, n_nationkey <= ANY (SELECT CASE WHEN r_regionkey > 1 THEN r_regionkey END FROM region) AS w FROM nation")
def all_null(spark, d):
    r = t(spark, d, "region").select(F.when(F.col("r_regionkey") > 1, F.col("r_regionkey")).alias("k"))
    n = Q.with_quantified(t(spark, d, "nation", "n_nationkey"), "v", "n_nationkey", ">", "ALL", r, "k")
    return Q.with_quantified(n, "w", "n_nationkey", "<=", "ANY", r, "k").select("n_nationkey", "v", "w")


@query("SELECT o_orderkey, o_totalprice > ALL (SELECT l_extendedprice FROM lineitem WHERE l_orderkey = o_orderkey) AS v FROM orders")
def all_corr(spark, d):
    li = t(spark, d, "lineitem", "l_orderkey", "l_extendedprice")
    return Q.with_quantified(t(spark, d, "orders", "o_orderkey", "o_totalprice"), "v", "o_totalprice", ">", "ALL", li, "l_extendedprice", {"o_orderkey": "l_orderkey"}).select("o_orderkey", "v")


@query("SELECT c_custkey, 100 * c_acctbal > ANY (SELECT o_totalprice FROM orders WHERE o_custkey = c_custkey) AS v FROM customer")
def any_corr(spark, d):
    o = t(spark, d, "orders", "o_custkey", "o_totalprice")
    c = t(spark, d, "customer", "c_custkey", "c_acctbal").withColumn("x", 100 * F.col("c_acctbal"))
    return Q.with_quantified(c, "v", "x", ">", "ANY", o, "o_totalprice", {"c_custkey": "o_custkey"}).select("c_custkey", "v")


@query("SELECT s_suppkey, s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000 AND c_custkey % 100 = s_suppkey % 100) AS v FROM supplier")
def sub_in_corr(spark, d):
    c = t(spark, d, "customer", "c_custkey", "c_nationkey", "c_acctbal").where("c_acctbal > 9000").withColumn("k", F.col("c_custkey") % 100)
    s = t(spark, d, "supplier", "s_suppkey", "s_nationkey").withColumn("k0", F.col("s_suppkey") % 100)
    return Q.with_in(s, "v", "s_nationkey", c, "c_nationkey", {"k0": "k"}).select("s_suppkey", "v")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND EXISTS (SELECT 1 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_orderkey = o_orderkey AND s_nationkey = c_nationkey))")
def nested_corr(spark, d):
    c, o = t(spark, d, "customer", "c_custkey", "c_nationkey"), t(spark, d, "orders", "o_orderkey", "o_custkey")
    reach = J.inner(t(spark, d, "lineitem", "l_orderkey", "l_suppkey"), t(spark, d, "supplier", "s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    lines = R.distinct(reach, {"l_orderkey": "l_orderkey", "s_nationkey": "s_nationkey"})  # before the shuffle, in part
    levels = [(o, F.col("o_custkey") == F.col("c_custkey")), (lines, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("s_nationkey") == F.col("c_nationkey")))]
    return J.exists_nested(c, ["c_custkey", "c_nationkey"], levels).select("c_custkey")


@query("SELECT n_nationkey FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > s_acctbal + 9000 AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 40 * s_acctbal AND o_orderstatus = 'F')))")
def nested_three(spark, d):
    n, s = t(spark, d, "nation", "n_nationkey"), t(spark, d, "supplier", "s_nationkey", "s_acctbal")
    c, o = t(spark, d, "customer", "c_custkey", "c_nationkey", "c_acctbal"), t(spark, d, "orders", "o_custkey", "o_totalprice", "o_orderstatus").where("o_orderstatus = 'F'")
    # the least balance of a nation decides: both conditions on it hold for it if they do for any other
    s = A.aggregate(s, ["s_nationkey"], {"s_acctbal": F.min("s_acctbal")})
    levels = [
        (s, F.col("s_nationkey") == F.col("n_nationkey")),
        (c, (F.col("c_nationkey") == F.col("n_nationkey")) & (F.col("c_acctbal") > F.col("s_acctbal") + 9000)),
        (o, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_totalprice") > 40 * F.col("s_acctbal"))),
    ]
    return J.exists_nested(n, ["n_nationkey"], levels, negate=True)


# Types


@query("SELECT o_orderpriority AS label, count(*) AS n, CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '4-NOT SPECIFIED' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '2-HIGH' THEN 4 WHEN '1-URGENT' THEN 5 END AS ord FROM orders GROUP BY o_orderpriority")
def enum_order(spark, d):
    labels = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]
    o = t(spark, d, "orders", "o_orderpriority").select(C.enum(F.col("o_orderpriority"), labels).alias("e"))
    return R.order(A.aggregate(o, ["e"], {"n": A.count_all()}), "e").select(C.enum_label(F.col("e")).alias("label"), "n", F.col("e.ord").alias("ord"))


@query("""SELECT o_custkey, list_extract(['5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH', '1-URGENT'], min(6 - CAST(left(o_orderpriority, 1) AS INT))) AS lo,
    list_extract(['5-LOW', '4-NOT SPECIFIED', '3-MEDIUM', '2-HIGH', '1-URGENT'], max(6 - CAST(left(o_orderpriority, 1) AS INT))) AS hi FROM orders GROUP BY o_custkey""")
def enum_min_max(spark, d):
    labels = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]
    o = t(spark, d, "orders", "o_custkey", "o_orderpriority").withColumn("e", C.enum(F.col("o_orderpriority"), labels))
    return A.aggregate(o, ["o_custkey"], {"lo": C.enum_label(F.min("e")), "hi": C.enum_label(F.max("e"))})


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment")
def list_group(spark, d):
    x = C.list_of(F.col("c_nationkey").cast("string"), F.col("c_mktsegment")).alias("x")
    g = A.aggregate(t(spark, d, "customer").select(x), ["x"], {"n": A.count_all()})
    return g.select(F.col("x")[0].cast("int").alias("c_nationkey"), F.col("x")[1].alias("c_mktsegment"), "n")


@query("SELECT c_custkey, c_nationkey FROM customer ORDER BY c_nationkey, c_mktsegment, c_custkey LIMIT 30")
def tuple_order(spark, d):
    c = t(spark, d, "customer").withColumn("x", C.tuple_of(F.col("c_nationkey"), F.col("c_mktsegment"), F.col("c_custkey")))
    return R.top(c, 30, "x", then={"c_custkey": "c_custkey", "c_nationkey": "c_nationkey"})


@query("SELECT CASE WHEN c_acctbal > 0 THEN c_nationkey END AS v, count(*) AS n FROM customer GROUP BY v")
def maybe_group(spark, d):
    c = t(spark, d, "customer").select(C.maybe(F.when(F.col("c_acctbal") > 0, F.col("c_nationkey")), "int").alias("m"))
    return A.aggregate(c, ["m"], {"n": A.count_all()}).select(F.get("m", F.lit(0)).alias("v"), "n")


@query("SELECT c_nationkey, min(c_acctbal > 0) AS lo, max(c_acctbal > 0) AS hi, min([CAST(c_custkey % 7 AS INT), c_nationkey])[1] AS list_lo, max({'a': c_mktsegment, 'b': c_custkey}).b AS tuple_hi FROM customer GROUP BY c_nationkey")
def min_max_composite(spark, d):
    pair = C.list_of((F.col("c_custkey") % 7).cast("int"), F.col("c_nationkey"), kind="int")
    both = C.tuple_of(F.col("c_mktsegment"), F.col("c_custkey"), kinds=["string", "bigint"])
    rich = F.col("c_acctbal") > 0
    return A.aggregate(t(spark, d, "customer"), ["c_nationkey"], {"lo": F.min(rich), "hi": F.max(rich), "list_lo": F.min(pair)[0], "tuple_hi": F.max(both)["_2"]})


@query("""SELECT '{"k":' || CAST(props->>'$.k' AS VARCHAR) || '}' AS props, count(*) AS n FROM events GROUP BY 1""")
def scalars_json(spark, d):
    """props as canonical JSON: equal objects are one group."""
    e = t(spark, d, "events", "props").select(S.json_text(F.col("props")).alias("props"))
    return A.aggregate(e, ["props"], {"n": A.count_all()})


@query("""SELECT event_id, '{"id":' || event_id || CASE WHEN value = floor(value) THEN ',"v":' || CAST(CAST(value AS BIGINT) AS VARCHAR) WHEN value >= 0.1 AND value < 10000000 THEN ',"v":' || value ELSE ',"v":' || (value * 100)::BIGINT || '.0e-2' END || '}' AS v FROM events WHERE value = floor(value) OR value >= 0.1""")
def scalars_json_numbers(spark, d):
    """Keys out of order, a repeated key, and whole numbers that come as 5.0."""
    e = t(spark, d, "events", "event_id", "value").where("value = floor(value) OR value >= 0.1")
    text = F.concat(F.lit('{ "v" : '), F.col("value").cast("string"), F.lit(', "id": '), F.col("event_id").cast("string"), F.lit('.000, "v": null }'))
    return e.select("event_id", S.json_text(text).alias("v"))


@query("SELECT strftime(ts, '%H:%M:%S.%f') AS tm, count(*) AS n FROM events GROUP BY tm")
def scalars_time(spark, d):
    e = t(spark, d, "events", "ts").select(S.time(F.date_format("ts", "HH:mm:ss.SSSSSS")).alias("tm"))
    return A.aggregate(e, ["tm"], {"n": A.count_all()})


@query("SELECT o_orderkey, printf('%08x-0000-4000-8000-%012x', o_orderkey, o_custkey) AS v FROM orders")
def scalars_uuid(spark, d):
    hexed = lambda c, n: F.lpad(F.hex(c), n, "0")
    o = t(spark, d, "orders", "o_orderkey", "o_custkey")
    return o.select("o_orderkey", S.uuid(F.concat(hexed("o_orderkey", 8), F.lit("-0000-4000-8000-"), hexed("o_custkey", 12))).alias("v"))


@query("SELECT c_custkey, printf('aa:bb:cc:%02x:%02x:%02x', c_custkey // 65536, c_custkey // 256 % 256, c_custkey % 256) AS v FROM customer")
def scalars_macaddr(spark, d):
    byte = lambda n: F.lpad(F.hex((F.floor(F.col("c_custkey") / n) % 256)), 2, "0")
    return t(spark, d, "customer", "c_custkey").select("c_custkey", S.macaddr(F.concat_ws("-", F.lit("AA"), F.lit("BB"), F.lit("CC"), byte(65536), byte(256), byte(1))).alias("v"))


@query("SELECT c_custkey, printf('10.%d.%d.%d', c_custkey // 65536, c_custkey // 256 % 256, c_custkey % 256) AS v4, printf('2001:0db8:0000:0000:0000:0000:%04x:%04x', c_nationkey, c_custkey % 65536) AS v6, printf('10.%d.%d.0/24', c_custkey // 65536, c_custkey // 256 % 256) AS net FROM customer")
def scalars_network(spark, d):
    c = t(spark, d, "customer", "c_custkey", "c_nationkey")
    byte = lambda n: (F.floor(F.col("c_custkey") / n) % 256).cast("string")
    six = F.concat(F.lit("2001:DB8::"), F.hex("c_nationkey"), F.lit(":"), F.hex(F.col("c_custkey") % 65536))
    four, net = F.concat_ws(".", F.lit("10"), byte(65536), byte(256), byte(1)), F.concat_ws(".", F.lit("10"), byte(65536), byte(256), F.lit("0/24"))
    return c.select("c_custkey", S.inet(four).alias("v4"), S.inet(six).alias("v6"), S.cidr(net).alias("net"))


@query("SELECT o_orderkey, printf('P%dM%dDT%d.250000S', o_custkey * 12 + 5, o_orderkey // 24, o_orderkey % 24 * 3600) AS v, printf('P0M%dDT0.000000S', 7 * o_orderkey) AS w FROM orders")
def scalars_interval(spark, d):
    o = t(spark, d, "orders", "o_orderkey", "o_custkey")
    text = F.concat(F.lit("P"), F.col("o_custkey"), F.lit("Y5MT"), F.col("o_orderkey"), F.lit("H0.25S"))
    return o.select("o_orderkey", S.interval(text).alias("v"), S.interval(F.concat(F.lit("P"), F.col("o_orderkey"), F.lit("W"))).alias("w"))


@query("SELECT event_id, strftime(ts - INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S.%fZ') AS v, strftime(ts + INTERVAL 8 HOUR, '%H:%M:%S.%fZ') AS w FROM events")
def scalars_zoned(spark, d):
    e, clock = t(spark, d, "events", "event_id", "ts"), F.date_format("ts", "HH:mm:ss.SSSSSS")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("t"), clock, F.lit("+05:30"))
    return e.select("event_id", S.timestamptz(stamp).alias("v"), S.timetz(F.concat(clock, F.lit("-08:00"))).alias("w"))


@query("SELECT o_orderdate::DATE::VARCHAR AS v, count(*) AS n FROM orders GROUP BY v")
def scalars_date(spark, d):
    o = t(spark, d, "orders", "o_orderdate").select(S.date(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("v"))
    return A.aggregate(o, ["v"], {"n": A.count_all()})


# Writes on declared tables, from the given ones


def _nations():
    return declared(Rule("n_nationkey", "int", nullable=False, unique=True, check="n_nationkey >= 0"), Rule("n_name", "string", coerce=lambda c: V.bounded_text(c, 25)), Rule("n_regionkey", "int", default=0))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL VALUES (100, 'ATLANTIS', 0), (101, NULL, 0)")
def dml_insert(spark, d):
    return _nations().insert(t(spark, d, "nation"), ["n_nationkey", "n_name"], [(100, "ATLANTIS"), (101, None)])


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 2 * (c_acctbal + 1) ELSE c_acctbal END AS c_acctbal FROM customer")
def dml_update(spark, d):
    table = declared(Rule("c_custkey", "bigint", nullable=False, unique=True), Rule("c_acctbal", "double"))
    return table.update(t(spark, d, "customer", "c_custkey", "c_acctbal"), [("c_acctbal", F.col("c_acctbal") + 1), ("c_acctbal", 2 * F.col("c_acctbal"))], F.col("c_acctbal") < 0)


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier WHERE NOT coalesce(s_acctbal < (SELECT avg(s_acctbal) FROM supplier), FALSE)")
def dml_delete(spark, d):
    s = t(spark, d, "supplier")
    table = declared(Rule("s_suppkey", "bigint"), Rule("s_name", "string"), Rule("s_nationkey", "int"), Rule("s_acctbal", "double"))
    return table.delete(s, F.col("s_acctbal") < s.agg(F.avg("s_acctbal").alias("a")).scalar())


@query("SELECT row_number() OVER (ORDER BY r_name) AS id, r_name AS name FROM region")
def dml_auto_increment(spark, d):
    table = declared(Rule("id", "bigint", auto_increment=True, unique=True), Rule("name", "string"))
    return table.insert_from(table.empty(spark), t(spark, d, "region", "r_name").select(F.col("r_name").alias("name")), ["name"])


@query("SELECT row_number() OVER (ORDER BY c_name) AS id, c_name AS name, c_acctbal AS v FROM customer")
def dml_insert_select(spark, d):
    """Rows of a DataFrame, numbered where they are; those of one name in the order of their keys, which the SQL leaves open."""
    table = declared(Rule("id", "bigint", auto_increment=True, unique=True), Rule("name", "string", nullable=False), Rule("v", "double"))
    return table.insert_from(table.empty(spark), t(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("v")), ["name", F.col("c_custkey")])


@query("""SELECT s_suppkey, s_name, CASE WHEN s_acctbal < 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_nationkey <> 3
    UNION ALL SELECT 100000000 + c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT -1, 'new', 7.0""")
def dml_stored(spark, d):
    """INSERT, UPDATE and DELETE that write files; the rows read back from these."""
    table = declared(Rule("s_suppkey", "bigint", nullable=False, unique=True), Rule("s_name", "string"), Rule("s_acctbal", "double", default=7), Rule("s_nationkey", "int", default=0))
    s = Stored.create(spark, table).insert_from(t(spark, d, "supplier", "s_suppkey", "s_name", "s_acctbal", "s_nationkey"))
    s = s.update([("s_acctbal", F.lit(0.0))], F.col("s_acctbal") < 0).delete(F.col("s_nationkey") == 3)
    rich = t(spark, d, "customer", "c_custkey", "c_name", "c_acctbal").where("c_acctbal > 9000")
    s = s.insert_from(rich.select((F.col("c_custkey") + 100_000_000).alias("s_suppkey"), F.col("c_name").alias("s_name"), F.col("c_acctbal").alias("s_acctbal")))
    return s.insert(["s_suppkey", "s_name"], [(-1, "new")]).read().select("s_suppkey", "s_name", "s_acctbal")


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CAST(p_size AS DOUBLE) AS size, CAST(5 AS DOUBLE) AS extra FROM part UNION ALL SELECT 'x', CAST(1 AS DOUBLE), CAST(6 AS DOUBLE)")
def ddl_alter_column(spark, d):
    """Types, defaults and NOT NULL changed; a renamed column keeps its CHECK."""
    table = declared(Rule("p_partkey", "bigint", unique=True), Rule("p_size", "int", check="p_size > 0 AND p_size < 1000"))
    state = t(spark, d, "part", "p_partkey", "p_size")
    state, table = set_type(state, table, "p_partkey", "string")
    state, table = set_type(state, table, "p_size", "double")
    state, table = rename_column(state, table, "p_size", "size")
    state, table = add_column(state, table, Rule("extra", "double", default=5))
    table = set_default(set_nullable(state, table, "size", False), "extra", 6)
    try:
        state = table.insert(state, ["p_partkey", "size"], [("y", 0)])
    except ConstraintError:
        state = table.insert(state, ["p_partkey", "size"], [("x", 1)])
    return state


@query("SELECT l_orderkey, l_quantity FROM lineitem")
def domain_alter(spark, d):
    """A stricter domain that some rows break is refused, one that all keep is taken."""
    table = declared(Rule("l_orderkey", "bigint"), with_domains({"positive": ("double", "VALUE > 0", True, None)}, "l_quantity", "positive"))
    state = t(spark, d, "lineitem", "l_orderkey", "l_quantity")
    try:
        table = alter_domain(state, table, "l_quantity", "VALUE > 10")
    except ConstraintError:
        table = alter_domain(state, table, "l_quantity", "VALUE > 0 AND VALUE < 1000", nullable=False)
    return table.validate(state)


@query("SELECT r_regionkey AS k, r_name, 'x' AS tag FROM region")
def ddl_alter(spark, d):
    table = declared(Rule("r_regionkey", "int", unique=True), Rule("r_name", "string"), Rule("old", "int"))
    state = t(spark, d, "region").withColumn("old", F.lit(1))
    state, table = add_column(state, table, Rule("tag", "string", nullable=False, default="x"))
    state, table = drop_column(state, table, "old")
    return rename_column(state, table, "r_regionkey", "k")[0]


@query("SELECT p_partkey, p_size FROM part")
def domain_check(spark, d):
    rule = with_domains({"positive": ("int", "VALUE > 0", True, None)}, "p_size", "positive")
    return declared(Rule("p_partkey", "bigint", unique=True), rule).validate(t(spark, d, "part", "p_partkey", "p_size"))


@query("SELECT s_suppkey, s_acctbal AS before, s_acctbal + 10 AS after FROM supplier WHERE s_nationkey < 5")
def dml_snapshot(spark, d):
    """A stored table's value from before an update still reads the old rows."""
    table = declared(Rule("s_suppkey", "bigint", unique=True), Rule("s_nationkey", "int"), Rule("s_acctbal", "double"))
    before = Stored.create(spark, table).insert_from(t(spark, d, "supplier", "s_suppkey", "s_nationkey", "s_acctbal"))
    after = before.update([("s_acctbal", F.col("s_acctbal") + 10)], F.col("s_nationkey") < 5)
    changed = J.inner(before.read().alias("b"), after.read().alias("a"), F.col("a.s_suppkey") == F.col("b.s_suppkey")).where("a.s_acctbal <> b.s_acctbal")
    return changed.select("b.s_suppkey", F.col("b.s_acctbal").alias("before"), F.col("a.s_acctbal").alias("after"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL VALUES (100, 'ATLANTIS', 0)")
def dml_savepoint(spark, d):
    """A statement that breaks a rule after a savepoint leaves the files of the savepoint."""
    savepoint = Stored.create(spark, _nations()).insert_from(t(spark, d, "nation")).insert(["n_nationkey", "n_name"], [(100, "ATLANTIS")])
    try:
        return savepoint.update([("n_nationkey", F.lit(7))]).read()
    except ConstraintError:
        return savepoint.read()


# Results as text


@query("SELECT r_regionkey || ',' || r_name AS value FROM region")
def sink_csv(spark, d):
    return tables.csv_lines(t(spark, d, "region", "r_regionkey", "r_name"))


@query("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS value FROM nation""")
def sink_json(spark, d):
    return tables.json_lines(t(spark, d, "nation", "n_nationkey", "n_name"))
