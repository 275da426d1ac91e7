import pytest
from pyspark.sql import functions as F

from spalt.errors import TypeMismatch
from spalt.functions import composites as C
from spalt.functions import scalars as S
from spalt.functions import values as V


def one(spark, column, text=None):
    return spark.createDataFrame([(text,)], "x string").select(column.alias("y")).first().y


@pytest.mark.parametrize(
    ("form", "text", "want"),
    [
        (S.uuid, "550E8400-E29B-41D4-A716-446655440000", "550e8400-e29b-41d4-a716-446655440000"),
        (S.macaddr, "AA-BB-CC-00-11-22", "aa:bb:cc:00:11:22"),
        (S.time, "10:20:30", "10:20:30.000000"),
        (S.time, "10:20:30.5", "10:20:30.500000"),
        (S.timetz, "01:00:00+02:00", "23:00:00.000000Z"),
        (S.timestamptz, "2024-01-01T00:30:00+01:00", "2023-12-31T23:30:00.000000Z"),
        (S.json_text, '{"b": 1.0, "a": [1e2, null], "b": 2}', '{"a":[100,null],"b":1}'),
        (S.timetz, "00:30:00+01:00", "23:30:00.000000Z"),
        (S.timetz, "23:59:59.000001-23:59", "23:58:59.000001Z"),
        (S.timestamptz, "2026-01-01T00:00:00.25+08:00", "2025-12-31T16:00:00.250000Z"),
        (S.timestamptz, "2025-12-31t16:00:00.250000z", "2025-12-31T16:00:00.250000Z"),
        (S.timestamptz, "2024-02-29T00:00:00Z", "2024-02-29T00:00:00.000000Z"),
        (S.json_text, '{"b":2.0,"a":1}', '{"a":1,"b":2}'),
        (S.json_text, '{"nested":{"z":0,"a":[true,null]}}', '{"nested":{"a":[true,null],"z":0}}'),
        (S.json_text, '{"a":1,"a":2}', '{"a":1}'),
        (S.json_text, " null ", "null"),
        (S.json_text, "12345678901234567890123456789012", "12345678901234567890123456789012"),
        (S.json_text, "[1e400, 0.12345678901234567890, 0.05, 1E-7, -0.0, 123456789.25, 1e1025]", "[1" + "0" * 400 + ",0.1234567890123456789,5.0e-2,1.0e-7,0,1.2345678925e8,1.0e1025]"),
        (S.json_text, '"\\b\\u000c\\n\\u00e9\\/\\u0001"', '"\\u0008\\u000c\\né/\\u0001"'),
        (S.inet, "192.0.2.1", "192.0.2.1"),
        (S.inet, "2001:DB8::1", "2001:0db8:0000:0000:0000:0000:0000:0001"),
        (S.inet, "::ffff:192.0.2.1", "0000:0000:0000:0000:0000:ffff:c000:0201"),
        (S.cidr, "192.0.2.0/24", "192.0.2.0/24"),
        (S.cidr, "2001:db8::/32", "2001:0db8:0000:0000:0000:0000:0000:0000/32"),
        (S.interval, "P1Y2M", "P14M0DT0.000000S"),
        (S.interval, "P2W", "P0M14DT0.000000S"),
        (S.interval, "PT25H", "P0M1DT3600.000000S"),
        (S.interval, "-PT0.25S", "-P0M0DT0.250000S"),
        (S.interval, "-P0D", "P0M0DT0.000000S"),
        (S.cidr, "10.1.0.0/16", "10.1.0.0/16"),
        (S.interval, "P1Y2M3DT4H5M6.5S", "P14M3DT14706.500000S"),
        (S.interval, "PT36H", "P0M1DT43200.000000S"),
        (S.date, "2024-99-99", "2024-99-99"),
    ],
)
def test_canonical_forms(spark, form, text, want):
    assert one(spark, form(F.col("x")), text) == want
    assert one(spark, form(F.col("x")), None) is None


@pytest.mark.parametrize(
    ("form", "text"),
    [(S.uuid, "550e8400"), (S.uuid, "550e8400e29b41d4a716446655440000"), (S.uuid, "550g8400-e29b-41d4-a716-446655440000"), (S.uuid, "550e8400-e29b-41d4-a716-446655440000\n"),
     (S.macaddr, "aa:bb"), (S.macaddr, "aa:bb:cc:00:11:222"), (S.macaddr, "aa:bb:cc:00:11-22"), (S.macaddr, "aa:bb:cc:00:11:22\n"),
     (S.time, "24:00:00"), (S.time, "10:00:00.1234567"), (S.time, "10:00:00\n"), (S.timetz, "10:00:00"), (S.timetz, "10:00:00Z\n"),
     *((S.timestamptz, x) for x in ("2026-02-29T00:00:00Z", "2024-13-01T00:00:00Z", "2026-01-01T24:00:00Z", "2026-01-01T00:00:60Z", "2026-01-01T00:00:00", "2026-01-01T00:00:00-00:00", "2026-01-01T00:00:00+24:00", "2026-01-01T00:00:00.1234567Z", "0999-12-31T00:00:00Z", "9999-12-31T23:59:59-01:00")),
     (S.json_text, "{a:1}"), (S.json_text, "{bad}"), (S.json_text, "NaN"), (S.json_text, '"\\ud800"'), (S.json_text, "[" * 100_000),
     *((S.inet, x) for x in ("10.0.0.256", "256.0.0.1", "01.2.3.4", "1::2::3", "1:2:3:4:5:6:7", "192.0.2.1::", "::1%eth0", "10.0.0.1/32", "1.2.3.4\n", "١.2.3.4")),
     *((S.cidr, x) for x in ("10.1.2.3/16", "192.0.2.1/24", "192.0.2.0/33", "::1/0", "::/-1", "10.0.0.0", "10.0.0.0/")),
     *((S.interval, x) for x in ("P", "PT", "P1WT1H", "P1W2D", "PT1.1234567S", "P1D1Y", "P1234567890123456789D", "P1DT")),
     (S.date, "2024-1-2"), (S.date, "2024-01-02\n"), (S.timestamp, "2024-01-02 03:04\n")],
)
def test_wrong_texts_are_errors(spark, form, text):
    with pytest.raises(Exception, match="invalid"):
        one(spark, form(F.col("x")), text)


def test_zoned_times_don_t_follow_the_session(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert one(spark, S.timestamptz(F.col("x")), "2024-03-10T02:30:00+00:00") == "2024-03-10T02:30:00.000000Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_comparisons_stay_in_a_family(spark):
    df = spark.createDataFrame([(1, 1.0, "1", True)], "i int, d double, s string, b boolean")
    assert df.select(V.compare(df, F.col("i"), "=", F.col("d"))).first()[0] and df.select(V.compare(df, F.col("s"), "<>", F.lit(None))).first()[0] is None
    for x, y in (("i", "s"), ("b", "i"), ("s", "b")):
        with pytest.raises(TypeMismatch, match="cannot compare these values"):
            V.compare(df, F.col(x), "<", F.col(y))


def test_composites_hold_no_nulls_and_one_type(spark):
    null = F.lit(None).cast("int")
    for bad in (C.list_of(F.lit(1), null), C.tuple_of(F.lit("a"), null), C.some(null), C.list_of(F.lit(1), F.lit("a"), kind="int"), C.tuple_of(F.lit(1), kinds=["string"])):
        with pytest.raises(Exception, match="type error"):
            spark.range(1).select(bad).collect()
    assert spark.range(1).select(C.list_of(F.lit(1), kind="int"), C.tuple_of(F.lit(1), F.lit("a"), kinds=["int", "string"])).first()[1]._2 == "a"
    assert spark.range(1).select(C.enum_literal("b", ["a", "b"]) > C.enum_literal("a", ["a", "b"])).first()[0]


def test_division(spark):
    row = spark.range(1).select(V.divide_int(F.lit(7), F.lit(2)), V.divide_int(F.lit(-7), F.lit(2)), V.divide(F.lit(7), F.lit(2)), V.divide_int(F.lit(None).cast("int"), F.lit(2))).first()
    assert tuple(row) == (3, -3, 3.5, None)
    for f in (V.divide_int, V.divide):
        with pytest.raises(Exception, match="division by zero"):
            spark.range(1).select(f(F.lit(1), F.col("id"))).collect()


def test_decimals_and_bounded_texts(spark):
    d = lambda x, p, s: one(spark, V.decimal(F.lit(x), p, s))
    assert d(99.994, 4, 2) == 99.99 and d(2.5, 2, 0) == 2.0 and d(3.5, 2, 0) == 4.0
    with pytest.raises(Exception, match="decimal value exceeds precision"):
        d(99.996, 4, 2)
    assert one(spark, V.bounded_text(F.col("x"), 3), "日本語") == "日本語" and one(spark, V.length(F.col("x")), "日本語") == 3
    with pytest.raises(Exception, match="longer than 3"):
        one(spark, V.bounded_text(F.col("x"), 3), "four")
    assert [r[0] for r in spark.createDataFrame([(True,), (None,)], "b boolean").select(V.negate(F.col("b"))).collect()] == [False, None]


def test_enums_order_as_declared(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,), ("b",), ("z",)], "s string").select(C.enum(F.col("s"), ["z", "a", "b"]).alias("e"))
    assert [r.l for r in df.orderBy("e").select(C.enum_label(F.col("e")).alias("l")).collect()] == [None, "z", "z", "a", "b"]
    assert df.agg(F.min("e"), F.max("e")).first()[1].label == "b"
    assert {(r.e and r.e.label, r["count"]) for r in df.groupBy("e").count().collect()} == {(None, 1), ("z", 2), ("a", 1), ("b", 1)}
    with pytest.raises(Exception, match="not a label: q"):
        spark.range(1).select(C.enum(F.lit("q"), ["z"])).collect()


def test_optionals_lists_and_tuples(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 2)], "id int, v int").withColumn("m", C.maybe(F.col("v"), "int"))
    assert [r.id for r in df.orderBy("m").collect()] == [1, 3, 2] and df.where("m IS NULL").count() == 0
    lists = spark.createDataFrame([(1, [10]), (2, [2, 9]), (3, [2]), (4, None)], "id int, xs array<int>")
    assert [r.id for r in lists.orderBy("xs").collect()] == [4, 3, 2, 1]
    pairs = df.where("v IS NOT NULL").select("id", C.tuple_of(F.col("v"), F.col("id")).alias("t"))
    assert pairs.where(F.col("t") == C.tuple_of(F.lit(5), F.lit(2))).first().id == 2
    assert spark.range(1).select(C.some(F.lit(1)) > C.nothing("int")).first()[0] and spark.range(1).select(C.list_of(F.lit(1), F.lit(2))).first()[0] == [1, 2]
