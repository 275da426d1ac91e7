import pytest

from spalt.plans.queries import ORACLE, QUERIES
from tests.compare import assert_same, duck


@pytest.fixture(scope="module")
def connection(small):
    return duck(small)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_rows_are_those_of_the_sql(spark, small, connection, name):
    assert_same(QUERIES[name](spark, small), connection, ORACLE[name])


def test_json_groups(spark, small):
    import json
    from collections import Counter

    want = Counter(json.dumps(json.loads(r.props), sort_keys=True, separators=(",", ":")) for r in spark.read.parquet(f"{small}/events.parquet").collect())
    assert {r.props: r.n for r in QUERIES["scalars_json"](spark, small).collect()} == want


@pytest.fixture
def odd(spark, tmp_path):
    """Tables with NULL and NaN balances, nations without a supplier and without a customer, and customers without an order."""
    import duckdb

    c = duckdb.connect()
    c.execute("CREATE TABLE nation AS SELECT CAST(i AS INT) AS n_nationkey FROM range(8) g(i)")
    c.execute("""CREATE TABLE supplier AS SELECT i AS s_suppkey, CASE WHEN i % 41 <> 0 THEN CAST(i % 7 AS INT) END AS s_nationkey,
        CASE WHEN i % 7 = 4 OR i % 11 = 0 THEN NULL WHEN i % 7 = 5 THEN CAST('nan' AS DOUBLE) ELSE i * 97 % 11000 - 1000 END AS s_acctbal FROM range(300) g(i)""")
    c.execute("""CREATE TABLE customer AS SELECT i AS c_custkey, CASE WHEN i % 43 <> 0 THEN CAST(i % 8 * (i % 8) % 7 AS INT) END AS c_nationkey,
        CASE WHEN i % 9 = 0 THEN NULL WHEN i % 50 = 7 THEN CAST('nan' AS DOUBLE) ELSE i * 89 % 10999 - 1000 END AS c_acctbal FROM range(600) g(i)""")
    c.execute("""CREATE TABLE orders AS SELECT i AS o_orderkey, CASE WHEN i % 37 <> 0 THEN i * 13 % 500 END AS o_custkey,
        CASE WHEN i % 10 = 0 THEN NULL WHEN i = 333 THEN CAST('nan' AS DOUBLE) ELSE i * 7919 % 400000 END AS o_totalprice, substr('FOP', i % 3 + 1, 1) AS o_orderstatus FROM range(900) g(i)""")
    for name in ("nation", "supplier", "customer", "orders"):
        c.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet'")
    return str(tmp_path), c


def test_nested_three_meets_a_row_of_each_nation(spark, odd):
    folder, c = odd
    df = QUERIES["nested_three"](spark, folder)
    assert_same(df, c, ORACLE["nested_three"])
    assert "min(s_acctbal" in df._jdf.queryExecution().optimizedPlan().toString()  # not each supplier with each customer


def test_join_on_subquery_writes_each_customers_pairs_together(spark, odd, small, tmp_path):
    folder, c = odd
    assert_same(QUERIES["join_on_subquery"](spark, folder), c, ORACLE["join_on_subquery"])
    pairs = QUERIES["join_on_subquery"](spark, folder).where("c_custkey IS NOT NULL")
    runs = sum(a.c_custkey != b.c_custkey for part in pairs.rdd.glom().collect() for a, b in zip(part, part[1:], strict=False))
    assert runs < 600 < pairs.count()  # a customer's rows come one after the other, so that columns of them stay short
