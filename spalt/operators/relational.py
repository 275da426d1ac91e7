"""Scans, projections, ordering, limits and distinct rows, with NULL lowest in every order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spalt.errors import AnalysisError, TypeMismatch

Key = str | int | Column
#: Scalars that have equality alone.
UNORDERED = ("json", "inet", "cidr", "interval")


def scan(spark: SparkSession, folder: str, name: str, columns: Sequence[str] | None = None, alias: str | None = None) -> DataFrame:
    """A table of the folder; columns reach the file reader, alias gives names like a.col."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    df = df if columns is None else df.select(*columns)
    return df if alias is None else df.alias(alias)


def lookup(df: DataFrame, column: str, value: Any) -> DataFrame:
    """Rows whose column equals a value: a filter that the file reader gets."""
    return df.where(F.col(column) == F.lit(value))


def in_range(df: DataFrame, column: str, low: Any = None, high: Any = None, include_low: bool = True, include_high: bool = True) -> DataFrame:
    """Rows between bounds; each bound may be missing, open or closed."""
    c = F.col(column)
    if low is not None:
        df = df.where(c >= F.lit(low) if include_low else c > F.lit(low))
    if high is not None:
        df = df.where(c <= F.lit(high) if include_high else c < F.lit(high))
    return df


def compute(df: DataFrame, outputs: Mapping[str, Column | str]) -> DataFrame:
    """A computed projection: label -> expression or column name, in order."""
    return df.select(*((F.col(e) if isinstance(e, str) else e).alias(label) for label, e in outputs.items()))


def project(df: DataFrame, *items: str) -> DataFrame:
    """Output columns by their texts, which are their labels too: 'u.name' of an aliased table stays u.name, 'a + 1' is a + 1."""
    return df.select(*(F.expr(x).alias(x) for x in items))


def unit(spark: SparkSession, outputs: Mapping[str, Column]) -> DataFrame:
    """One row of constants: a select without a table."""
    return compute(spark.range(1), outputs)


def sort_keys(df: DataFrame, keys: Sequence[Key]) -> list[Column]:
    """'c' ascending, '-c' descending, n or -n the n-th output column; NULL counts as lowest either way.

    A column whose metadata say that it holds canonical texts without an order (JSON, networks, intervals) is an error.
    """
    out = []
    for k in keys:
        if isinstance(k, Column):
            out.append(k)
            continue
        if isinstance(k, int):
            if not 1 <= abs(k) <= len(df.columns):
                raise AnalysisError("ORDER BY: position is outside the select list")
            name, down = f"`{df.columns[abs(k) - 1]}`", k < 0
        else:
            name, down = k.removeprefix("-"), k.startswith("-")
        scalar = next((f.metadata.get("scalar") for f in df.schema if f.name == name.strip("`")), None)
        if scalar in UNORDERED:
            raise TypeMismatch(f"ORDER BY: type capability: {scalar} has no order")
        out.append(F.col(name).desc_nulls_last() if down else F.col(name).asc_nulls_first())
    return out


def order(df: DataFrame, *keys: Key) -> DataFrame:
    return df.orderBy(*sort_keys(df, keys))


def top(df: DataFrame, n: int, *keys: Key, then: Mapping[str, Column | str] | None = None) -> DataFrame:
    """The first n rows of the order. `then` is projected after the limit, so it is computed for n rows alone."""
    if n < 0:
        raise AnalysisError("LIMIT must not be negative")
    out = (order(df, *keys) if keys else df).limit(n)
    return out if then is None else compute(out, then)


def distinct(df: DataFrame, outputs: Mapping[str, Column | str] | None = None, keys: Sequence[Key] = ()) -> DataFrame:
    """Distinct output rows, in the order of keys, which must be output columns."""
    out = (df if outputs is None else compute(df, outputs)).distinct()
    for k in keys:
        if isinstance(k, str) and k.removeprefix("-") not in out.columns:
            raise AnalysisError("DISTINCT: ORDER BY column must appear in the select list")
    return order(out, *keys) if keys else out
