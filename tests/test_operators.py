import itertools

import pytest
from pyspark.sql import functions as F

from spalt.errors import AnalysisError
from spalt.operators import aggregates as A
from spalt.operators import joins as J
from spalt.operators import relational as R
from spalt.operators import subqueries as Q


@pytest.fixture
def keys(spark):
    left = spark.createDataFrame([(1,), (1,), (2,), (None,), (3,)], "k int")
    right = spark.createDataFrame([(1,), (1,), (None,)], "r int")
    return left, right


def values(df, c="k"):
    return sorted((r[c] for r in df.collect()), key=lambda v: (v is not None, v or 0))


def test_semi_and_anti_joins_with_null_keys(keys):
    left, right = keys
    assert values(J.is_in(left, "k", right, "r")) == [1, 1]
    assert values(J.exists(left, right, F.col("k") == F.col("r"))) == [1, 1]
    assert values(J.not_exists(left, right, F.col("k") == F.col("r"))) == [None, 2, 3]
    assert values(J.not_in(left, "k", right, "r")) == []
    assert values(J.not_in(left, "k", right.where("r = 1"), "r")) == [2, 3]
    assert values(J.not_in(left, "k", right.where("false"), "r")) == [None, 1, 1, 2, 3]


def test_semi_joins_don_t_pair_rows_off(keys):
    left, right = keys
    for df in (J.is_in(left, "k", right, "r"), J.not_in(left, "k", right, "r")):
        plan = df._jdf.queryExecution().toString()
        assert ("LeftSemi" in plan or "LeftAnti" in plan) and "Cartesian" not in plan and "BroadcastNestedLoopJoin" not in plan


def fold(x, op, every, rows):
    """x op ANY/ALL rows by folding three-valued OR or AND over them."""
    compare = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}[op]
    out = every
    for v in rows:
        r = None if x is None or v is None else compare(x, v)
        if every:
            out = False if out is False or r is False else None if out is None or r is None else True
        else:
            out = True if out is True or r is True else None if out is None or r is None else False
    return out


SETS = [[], [None], [1, None], [2], [1, 3], [2, 2], [1, 2, 3, None]]


@pytest.mark.parametrize(("op", "quantifier"), list(itertools.product(["=", "<>", "<", "<=", ">", ">="], ["ANY", "ALL"])))
def test_quantified_comparison_is_the_fold(spark, op, quantifier):
    xs = [None, 0, 1, 2, 3, 4]
    outer = spark.createDataFrame([(g, x) for g in range(len(SETS)) for x in xs], "g int, x int")
    inner = spark.createDataFrame([(g, v) for g, s in enumerate(SETS) for v in s], "h int, v int")
    got = {(r.g, r.x): r.y for r in Q.with_quantified(outer, "y", "x", op, quantifier, inner, "v", {"g": "h"}).collect()}
    assert got == {(g, x): fold(x, op, quantifier == "ALL", s) for g, s in enumerate(SETS) for x in xs}
    for g in (0, 2, 4):
        alone = Q.with_quantified(outer.where(F.col("g") == g), "y", "x", op, quantifier, inner.where(F.col("h") == g), "v")
        assert {r.x: r.y for r in alone.collect()} == {x: fold(x, op, quantifier == "ALL", SETS[g]) for x in xs}


def test_in_over_large_numbers(spark):
    big = spark.createDataFrame([(9007199254740995 + i,) for i in range(4)], "id long")
    floats = spark.createDataFrame([(9007199254740996.0,)], "v double")
    found = Q.with_in(big, "y", "id", floats, "v")
    assert [r.id for r in found.where("y").orderBy("id").collect()] == [9007199254740995, 9007199254740996, 9007199254740997]


def test_scalar_subqueries(spark):
    outer = spark.createDataFrame([(1,), (2,), (3,)], "a int")
    inner = spark.createDataFrame([(1, "x"), (2, None)], "b int, v string")
    assert {r.a: r.s for r in Q.with_scalar(outer, "s", inner, {"a": "b"}, "v").collect()} == {1: "x", 2: None, 3: None}
    twice = inner.unionByName(inner)
    with pytest.raises(Exception, match="scalar subquery returned more than one row"):
        Q.with_scalar(outer, "s", twice, {"a": "b"}, "v").collect()
    with pytest.raises(Exception, match="scalar subquery returned more than one row"):
        outer.withColumn("s", Q.scalar(inner, "v")).collect()
    assert [r.s for r in outer.withColumn("s", Q.scalar(inner.where("b = 9"), "v")).collect()] == [None] * 3
    counted = Q.with_aggregate(outer, "n", twice, {"a": "b"}, A.count_all(), F.lit(0))
    assert {r.a: r.n for r in counted.collect()} == {1: 2, 2: 2, 3: 0}


def test_left_join_on_a_subquery_over_both_sides(spark):
    left = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "id int, x int")
    right = spark.createDataFrame([(10, 5), (10, 6), (20, 7)], "y int, z int")
    some = spark.createDataFrame([(1, 6), (9, 7)], "i int, j int")
    out = J.left_matching(left, right, F.col("x") == F.col("y"), lambda p: J.exists(p, some, (F.col("i") == F.col("id")) & (F.col("j") == F.col("z"))))
    assert sorted((r.id, r.z) for r in out.collect() if r.z) == [(1, 6)] and out.count() == 3


def test_left_join_on_a_subquery_with_null_and_repeated_rows(spark):
    left = spark.createDataFrame([(1, 10), (1, 10), (None, 10), (None, None), (2, 20), (2, 20)], "id int, x int")
    right = spark.createDataFrame([(10, 5), (10, 6), (20, 7)], "y int, z int")
    some = spark.createDataFrame([(5,), (6,)], "j int")
    out = J.left_matching(left, right, F.col("x") == F.col("y"), lambda p: J.exists(p, some, F.col("j") == F.col("z")))
    want = [(1, 10, 5), (1, 10, 5), (1, 10, 6), (1, 10, 6), (None, 10, 5), (None, 10, 6), (None, None, None), (2, 20, None), (2, 20, None)]
    assert sorted(((r.id, r.x, r.z) for r in out.collect()), key=repr) == sorted(want, key=repr) and out.columns == ["id", "x", "y", "z"]


def test_nested_subqueries_name_every_level_before(spark):
    a = spark.createDataFrame([(1, 1), (2, 1), (3, None), (None, 1)], "a int, x int")
    b = spark.createDataFrame([(1, 5), (1, 6), (2, 7), (3, 5)], "b int, y int")
    c = spark.createDataFrame([(5, 1), (6, 2), (7, None)], "c int, z int")
    levels = [(b, F.col("b") == F.col("a")), (c, (F.col("c") == F.col("y")) & (F.col("z") == F.col("x")))]
    want = {x for x, k in ((1, 1), (2, 1), (3, None), (None, 1)) if any(p == x and any(q == y and z == k and z is not None for q, z in ((5, 1), (6, 2), (7, None))) for p, y in ((1, 5), (1, 6), (2, 7), (3, 5)))}
    assert {r.a for r in J.exists_nested(a, ["a", "x"], levels).collect()} == want == {1}
    assert {r.a for r in J.exists_nested(a, ["a", "x"], levels, negate=True).collect()} == {2, 3, None}


def test_subqueries_by_another_comparison(spark):
    rows = [(1, 1), (1, 2), (2, 5), (2, None), (None, 3), (3, 3)]
    df, other = spark.createDataFrame(rows, "g int, v int"), spark.createDataFrame([*rows, (2, 1)], "h int, w int")
    test = {"<>": lambda a, b: a != b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "=": lambda a, b: a == b}
    for op, f in test.items():
        want = sorted(r for r in rows if r[0] is not None and r[1] is not None and any(h == r[0] and w is not None and f(r[1], w) for h, w in [*rows, (2, 1)]))
        assert sorted(map(tuple, Q.exists_where(df, {"g": "h"}, "v", op, other, "w").collect())) == want
        rest = [tuple(r) for r in Q.exists_where(df, {"g": "h"}, "v", op, other, "w", negate=True).collect()]
        assert sorted(rest, key=repr) == sorted((r for r in rows if r not in want), key=repr)


def test_helper_names_give_way(spark):
    outer = spark.createDataFrame([(1, 2, 3, 4, 5, 6)], "key0 int, facts int, hit int, value int, n int, v int")
    inner = spark.createDataFrame([(1, 5)], "b int, n int")
    for df in (Q.with_in(outer, "y", "n", inner, "n", {"key0": "b"}), Q.with_quantified(outer, "y", "n", ">=", "ALL", inner, "n", {"key0": "b"}), Q.with_scalar(outer, "y", inner, {"key0": "b"}, "n").withColumn("y", F.col("y") == 5)):
        assert [tuple(r) for r in df.collect()] == [(1, 2, 3, 4, 5, 6, True)] and df.columns == [*outer.columns, "y"]
    assert J.is_in(outer, "n", inner, "n").columns == J.not_in(outer, "n", inner.where("false"), "n").columns == outer.columns


def test_joins_without_an_equality_and_with_a_hot_one(spark):
    points = spark.createDataFrame([(i, i * 0.5 - 5) for i in range(40)] + [(99, None)], "i int, x double")
    ranges = spark.createDataFrame([(1, -3.0, 4.0), (2, 1.0, 1.0), (3, 5.0, 2.0), (4, None, 9.0), (5, 14.5, 99.0)], "r int, low double, high double")
    want = {(i, r) for i, x in [(i, i * 0.5 - 5) for i in range(40)] for r, a, z in ((1, -3, 4), (2, 1, 1), (5, 14.5, 99)) if a <= x <= z}
    for width in (0.7, 3, 1000):
        out = J.within(points, ranges, "x", "low", "high", width)
        rows = [(r.i, r.r) for r in out.collect()]
        assert set(rows) == want and len(rows) == len(want)
        plan = out._jdf.queryExecution().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert {(r.i, r.r) for r in J.within(points, ranges, "x", "low", "high", 2, "left").collect()} == want | {(i, None) for i in [*range(40), 99] if i not in {w[0] for w in want}}
    left, right = spark.createDataFrame([(k % 3 or None, k) for k in range(30)], "k int, a int"), spark.createDataFrame([(1, 1), (1, 2), (2, 3), (None, 4)], "j int, b int")
    for how in ("inner", "left"):
        plain = left.join(right, F.col("k") == F.col("j"), how)
        assert sorted(map(repr, J.salted(left, right, "k", "j", 5, how=how).collect())) == sorted(map(repr, plain.collect()))


def test_order_puts_null_lowest(spark):
    df = spark.createDataFrame([(1, 2), (2, None), (3, 1)], "id int, v int")
    assert [r.id for r in R.order(df, "v").collect()] == [2, 3, 1]
    assert [r.id for r in R.order(df, "-v").collect()] == [1, 3, 2]
    assert [r.id for r in R.order(df, -2, 1).collect()] == [1, 3, 2]
    with pytest.raises(AnalysisError, match="position is outside the select list"):
        R.order(df, 3)
    with pytest.raises(AnalysisError, match="must appear in the select list"):
        R.distinct(df, {"id": "id"}, ["v"])
    with pytest.raises(AnalysisError):
        R.top(df, -1, "id")


def test_projection_after_the_limit(spark):
    df = spark.createDataFrame([(i,) for i in range(6)], "i int")
    fails = F.when(F.col("i") > 1, F.raise_error(F.lit("too far")).cast("int")).otherwise(F.col("i"))
    assert [r.x for r in R.top(df, 2, "i", then={"x": fails}).collect()] == [0, 1]


def test_labels_are_the_texts(spark):
    u, o = spark.createDataFrame([(1, "Alice")], "id int, name string").alias("u"), spark.createDataFrame([(1, 7)], "user_id int, n int").alias("o")
    out = R.project(J.inner(u, o, F.col("u.id") == F.col("o.user_id")), "u.name", "o.n", "n + 1")
    assert out.columns == ["u.name", "o.n", "n + 1"] and tuple(out.first()) == ("Alice", 7, 8)


def test_aggregates(spark):
    df = spark.createDataFrame([(1, 10), (1, 20), (2, 5), (None, 1), (None, None)], "g int, v int")
    out = A.aggregate(df, ["g"], {"s": F.sum("v"), "n": F.count("v"), "m": A.count_all()})
    assert {tuple(r) for r in out.collect()} == {(1, 30, 2, 2), (2, 5, 1, 1), (None, 1, 1, 2)}
    assert [tuple(r) for r in A.aggregate(df, ["g"], {"s": F.sum("v")}, having=F.col("s") > 5).collect()] == [(1, 30)]
    empty = A.aggregate(df.where("false"), [], {"n": A.count_all(), "s": F.sum("v"), "a": F.avg("v")}).collect()
    assert [tuple(r) for r in empty] == [(0, None, None)]
    with pytest.raises(AnalysisError, match="unknown column"):
        A.aggregate(df, ["nope"], {"n": A.count_all()})
    for keys, outputs in ((["g"], {"v": F.col("v")}), ([], {"n": A.count_all(), "g": F.col("g")}), (["g"], {"x": F.col("v") + F.sum("v")})):
        with pytest.raises(AnalysisError, match="GROUP BY"):
            A.aggregate(df, keys, outputs)


def test_filters_and_columns_reach_the_scan(spark, small):
    df = R.in_range(R.scan(spark, small, "orders", ["o_orderkey", "o_totalprice"]), "o_orderkey", 10, 20)
    plan = df._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThanOrEqual(o_orderkey,10), LessThanOrEqual(o_orderkey,20)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_limit_of_an_order_is_one_operator(spark, small):
    assert "TakeOrderedAndProject" in R.top(R.scan(spark, small, "orders"), 5, "-o_totalprice")._jdf.queryExecution().toString()
