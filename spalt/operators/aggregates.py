"""Grouping with COUNT, SUM, AVG, MIN and MAX, and HAVING over the groups."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spalt.errors import AnalysisError


def count_all() -> Column:
    return F.count(F.lit(1))


def aggregate(df: DataFrame, keys: Sequence[str], outputs: Mapping[str, Column], having: Column | None = None, hidden: Mapping[str, Column] | None = None) -> DataFrame:
    """One row for each combination of keys, NULL being a value like any other; without keys exactly one row.

    having filters groups by keys, outputs, or the aggregates in hidden, which are not returned. A bare column that is no
    key is an error.
    """
    unknown = [k for k in keys if k not in df.columns]
    if unknown:
        raise AnalysisError(f"unknown column in GROUP BY: {unknown[0]} (available: {', '.join(df.columns)})")
    made = [c.alias(n) for n, c in {**outputs, **(hidden or {})}.items()]
    try:
        out = df.groupBy(*keys).agg(*made) if keys else df.agg(*made)
        if having is not None:
            out = out.where(having)
    except AnalysisException as e:
        if e.getCondition() in ("MISSING_AGGREGATION", "MISSING_GROUP_BY", "UNRESOLVED_COLUMN.WITH_SUGGESTION", "UNSUPPORTED_EXPR_FOR_OPERATOR", "INVALID_WHERE_CONDITION"):
            raise AnalysisError(f"a column outside of aggregates must be in GROUP BY: {e.getMessage()}") from e
        raise
    return out.drop(*hidden) if hidden else out
