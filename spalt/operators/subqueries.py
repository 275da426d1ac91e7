"""Subqueries as values: scalar, IN, ANY and ALL, with three-valued results, correlated by equality or not.

A subquery's rows are first summed to one row, or to one for each value of its correlation keys, and that row is what
meets the outer rows: nothing is paired off, and the partial sums run where the data are.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spalt.errors import AnalysisError
from spalt.operators.names import fresh

TOO_MANY = "scalar subquery returned more than one row"


def scalar(values: DataFrame, v: str) -> Column:
    """The one value of an uncorrelated subquery: NULL for no row, an error for several."""
    return values.agg(F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit(TOO_MANY)).cast(values.schema[v].dataType)).otherwise(F.first(v))).scalar()


def _keys(outer: DataFrame, on: Mapping[str, str]) -> dict[str, str]:
    """Inner column -> a name that outer doesn't have, for the correlation keys in order."""
    return {b: fresh(f"key{i}", outer) for i, b in enumerate(on.values())}


def with_scalar(outer: DataFrame, label: str, inner: DataFrame, on: Mapping[str, str], v: str) -> DataFrame:
    """outer with the value of a subquery correlated by outer column = inner column, under the rules of scalar()."""
    n, value = fresh("n", outer), fresh("value", outer)
    summed = inner.groupBy(*(F.col(b).alias(k) for b, k in _keys(outer, on).items())).agg(F.count(F.lit(1)).alias(n), F.first(v).alias(value))
    out = F.when(F.col(n) > 1, F.raise_error(F.lit(TOO_MANY)).cast(inner.schema[v].dataType)).otherwise(F.col(value))
    return _correlate(outer, summed, on).withColumn(label, out).drop(*({n, value} - {label}))


def with_aggregate(outer: DataFrame, label: str, inner: DataFrame, on: Mapping[str, str], value: Column, if_none: Column | None = None) -> DataFrame:
    """outer with an aggregate over the inner rows that agree on the correlation keys; if_none where there are none."""
    v, some = fresh("value", outer), fresh("some", outer)
    summed = inner.groupBy(*(F.col(b).alias(k) for b, k in _keys(outer, on).items())).agg(value.alias(v), F.lit(True).alias(some))
    out = F.col(v) if if_none is None else F.when(F.col(some), F.col(v)).otherwise(if_none)
    return _correlate(outer, summed, on).withColumn(label, out).drop(*({v, some} - {label}))


def _correlate(outer: DataFrame, summed: DataFrame, on: Mapping[str, str]) -> DataFrame:
    keys, condition = list(_keys(outer, on).values()), F.lit(True)
    for a, k in zip(on, keys, strict=True):
        condition = condition & (F.col(a) == F.col(k))
    return outer.join(summed, condition, "left").drop(*keys)


def _facts(v: Column) -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), F.count_if(v.isNull()).alias("nulls"), F.min(v).alias("low"), F.max(v).alias("high")]


def _verdict(x: Column, op: str, every: bool, f: Column) -> Column:
    """x op ANY/ALL (values) from count, NULLs, least and greatest value, for operators that these decide."""
    low, high = f["low"], f["high"]
    same = (low == x) & (high == x)
    deciding = {
        (">", False): x > low, (">=", False): x >= low, ("<", False): x < high, ("<=", False): x <= high, ("<>", False): ~same,
        (">", True): ~(x > high), (">=", True): ~(x >= high), ("<", True): ~(x < low), ("<=", True): ~(x <= low), ("=", True): ~same,
    }.get((op, every))
    if deciding is None:
        raise AnalysisError(f"{op} {'ALL' if every else 'ANY'} is a membership: use with_in")
    return _three_valued(x, f, deciding, every)


def _three_valued(x: Column, f: Column, deciding: Column, every: bool) -> Column:
    usual, decided = F.lit(every), F.lit(not every)
    n, nulls = F.coalesce(f["n"], F.lit(0)), F.coalesce(f["nulls"], F.lit(0))
    return F.when(n == 0, usual).when(x.isNull(), F.lit(None).cast("boolean")).when(deciding, decided).when(nulls > 0, F.lit(None).cast("boolean")).otherwise(usual)


def with_quantified(outer: DataFrame, label: str, x: str, op: str, quantifier: str, inner: DataFrame, v: str, on: Mapping[str, str] | None = None) -> DataFrame:
    """outer with x op ANY (inner.v) or x op ALL (inner.v): TRUE, FALSE or NULL."""
    every = quantifier.upper() == "ALL"
    if (op, every) in (("=", False), ("<>", True)):
        out = with_in(outer, label, x, inner, v, on)
        return out.withColumn(label, ~F.col(label)) if every else out
    facts = fresh("facts", outer)
    if on:
        keys = [F.col(b).alias(k) for b, k in _keys(outer, on).items()]
        joined = _correlate(outer, inner.groupBy(*keys).agg(F.struct(*_facts(F.col(v))).alias(facts)), on)
    else:
        joined = outer.withColumn(facts, inner.agg(F.struct(*_facts(F.col(v)))).scalar())
    return joined.withColumn(label, _verdict(F.col(x), op, every, F.col(facts))).drop(facts)


def with_in(outer: DataFrame, label: str, x: str, inner: DataFrame, v: str, on: Mapping[str, str] | None = None) -> DataFrame:
    """outer with x IN (inner.v): TRUE, FALSE or NULL; FALSE for no rows even if x is NULL.

    inner is summed once to a row for each value (of each correlation key); the hits and the counts both come from these.
    """
    on = dict(on or {})
    facts, hit, value, n = fresh("facts", outer), fresh("hit", outer), fresh("value", outer), fresh("n", outer)
    keys = _keys(outer, on)
    each = inner.groupBy(*(F.col(b).alias(k) for b, k in keys.items()), F.col(v).alias(value)).agg(F.count(F.lit(1)).alias(n))
    counts = F.struct(F.sum(n).alias("n"), F.coalesce(F.sum(F.when(F.col(value).isNull(), F.col(n))), F.lit(0)).alias("nulls"))
    if on:
        joined = _correlate(outer, each.groupBy(*keys.values()).agg(counts.alias(facts)), on)
    else:
        joined = outer.withColumn(facts, each.agg(counts).scalar())
    condition = F.col(x) == F.col(value)
    for a, k in zip(on, keys.values(), strict=True):
        condition = condition & (F.col(a) == F.col(k))
    joined = joined.join(each.select(*keys.values(), value, F.lit(True).alias(hit)), condition, "left").drop(*keys.values(), value)
    return joined.withColumn(label, _three_valued(F.col(x), F.col(facts), F.coalesce(F.col(hit), F.lit(False)), False)).drop(facts, hit)


def exists_where(outer: DataFrame, on: Mapping[str, str], x: str, op: str, inner: DataFrame, v: str, negate: bool = False) -> DataFrame:
    """Outer rows for which an inner row agrees on the keys and has x op v: a correlation by another comparison than equality.

    That is x op ANY (v) being TRUE, which the least and greatest v of each key decide: no pairs of rows are made.
    """
    name = fresh("found", outer)
    found = F.coalesce(F.col(name), F.lit(False))
    return with_quantified(outer, name, x, op, "ANY", inner, v, on).where(~found if negate else found).drop(name)
