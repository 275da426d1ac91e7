"""Inner and left joins, semi and anti joins, joins without an equality or with a hot one, and joins whose condition holds a
subquery over both sides."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spalt.operators.names import fresh

On = Column | Sequence[Column]


def inner(left: DataFrame, right: DataFrame, on: On) -> DataFrame:
    return left.join(right, on, "inner")


def left(left_: DataFrame, right: DataFrame, on: On) -> DataFrame:
    """Unmatched left rows are kept with NULLs."""
    return left_.join(right, on, "left")


def exists(outer: DataFrame, inner_: DataFrame, on: On) -> DataFrame:
    """Outer rows for which the correlated subquery has a row."""
    return outer.join(inner_, on, "left_semi")


def not_exists(outer: DataFrame, inner_: DataFrame, on: On) -> DataFrame:
    return outer.join(inner_, on, "left_anti")


def is_in(outer: DataFrame, x: str, values: DataFrame, v: str) -> DataFrame:
    """Outer rows for which x IN (values) is TRUE."""
    name = fresh("v", outer)
    return outer.join(values.select(F.col(v).alias(name)), F.col(x) == F.col(name), "left_semi")


def not_in(outer: DataFrame, x: str, values: DataFrame, v: str) -> DataFrame:
    """Outer rows for which x NOT IN (values) is TRUE: all if there are no values, none if one of them is NULL.

    An anti join on equality and one row of counts, so that no side has to be broadcast.
    """
    name, facts = fresh("v", outer), fresh("facts", outer)
    values = values.select(F.col(v).alias(name))
    counts = values.agg(F.struct(F.count(F.lit(1)).alias("n"), F.count_if(F.col(name).isNull()).alias("nulls"))).scalar()
    kept = outer.join(values, F.col(x) == F.col(name), "left_anti").withColumn(facts, counts)
    return kept.where((F.col(f"{facts}.n") == 0) | (F.col(x).isNotNull() & (F.col(f"{facts}.nulls") == 0))).drop(facts)


def same_row(left_: DataFrame, names: dict[str, str]) -> Column:
    """Equality of rows, NULLs being equal: left columns against the other side's names for them."""
    out = F.lit(True)
    for c, other in names.items():
        out = out & left_[c].eqNullSafe(F.col(other))
    return out


def left_matching(left_: DataFrame, right: DataFrame, on: On, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A left join whose matches must also pass `keep`, any filter or semi join over both sides' columns.

    The pairs are an inner join that keep filters; left rows of which no pair is left follow, padded with NULLs. Equal left
    rows have equal matches, so this needs no key, and rows with NULLs are like any other. The two sides' column names differ.
    """
    pairs = keep(left_.join(right, on, "inner"))
    names = {c: fresh(f"{c}_own", left_, right) for c in left_.columns}
    matched = pairs.select(*(F.col(c).alias(n) for c, n in names.items())).distinct()
    alone = left_.join(matched, same_row(left_, names), "left_anti")
    padded = alone.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema))
    return pairs.select(*left_.columns, *right.columns).unionByName(padded)


def exists_nested(outer: DataFrame, refs: Sequence[str], levels: Sequence[tuple[DataFrame, On]], negate: bool = False) -> DataFrame:
    """Outer rows for which the first level has a row for which the second has one, and so on: EXISTS in EXISTS.

    Each level's condition may name columns of the outer rows (refs) and of every level before it. The distinct values of
    refs meet the first level once; what passes is one row for each such value that the outer rows are matched with.
    Rows that pass a level are paired off with the next, so a level whose values are only compared, not matched, should come
    as the least or greatest value of its key where that decides.
    """
    (inner_, on), *rest = levels
    if not rest:
        return outer.join(inner_, on, "left_anti" if negate else "left_semi")
    bound = outer.select(*refs).distinct().join(inner_, on, "inner")
    passed = exists_nested(bound, bound.columns, rest)
    names = {c: fresh(f"{c}_own", outer) for c in refs}
    passed = passed.select(*(F.col(c).alias(n) for c, n in names.items())).distinct()
    return outer.join(passed, same_row(outer, names), "left_anti" if negate else "left_semi")


def salted(left_: DataFrame, right: DataFrame, left_key: str, right_key: str, salts: int, extra: Column | None = None, how: str = "inner") -> DataFrame:
    """A join on few or hot key values: left rows are dealt to `salts` parts of their key, each of which has the right rows."""
    a, b = fresh("salt", left_, right), fresh("salt_right", left_, right)
    dealt = left_.withColumn(a, F.pmod(F.xxhash64(*(F.col(c) for c in left_.columns)), F.lit(salts)))
    copies = right.withColumn(b, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    on = (dealt[left_key] == copies[right_key]) & (F.col(a) == F.col(b))
    return dealt.join(copies, on if extra is None else on & extra, how).drop(a, b)


def within(left_: DataFrame, right: DataFrame, x: str, low: str, high: str, width: float, how: str = "inner") -> DataFrame:
    """left JOIN right ON x BETWEEN low AND high, as an equality of cells of `width` and the condition: nothing is crossed.

    A right row is in every cell that its range touches, a left row in one, so each pair is found once. Choose a width
    like the usual range; a wide range among narrow ones costs a row for each cell.
    """
    a, b = fresh("cell", left_, right), fresh("cell_right", left_, right)
    cell = lambda c: F.floor(F.col(c) / F.lit(float(width)))
    placed = left_.withColumn(a, cell(x))
    spread = right.where(F.col(low) <= F.col(high)).withColumn(b, F.explode(F.sequence(cell(low), cell(high))))
    return placed.join(spread, (F.col(a) == F.col(b)) & F.col(x).between(F.col(low), F.col(high)), how).drop(a, b)


def above(left_: DataFrame, right: DataFrame, left_key: str, right_key: str, value: str, bound: Column, salts: int = 32, parts: int = 200, chunk: int = 128) -> DataFrame:
    """left JOIN right ON left_key = right_key AND value > bound, for few keys: a left join of value against a bound of left rows.

    Right rows, the many, are dealt to `salts` parts of their key and sent once; left rows go to each part, `chunk` of them in
    a row and those of like bounds together. A part gives the pairs of a chunk with one right row after the other, so that
    the same short runs of values repeat and what is written of the pairs stays small. Whether a left row has a pair is
    decided by its key's greatest value.
    """
    salt, salt_left, top, low, key, at, some, one = (fresh(n, left_, right) for n in ("salt", "salt_left", "top", "bound", "key", "at", "some", "one"))
    bounded = left_.withColumn(low, bound)
    dealt = right.withColumn(salt, F.pmod(F.xxhash64(*right.columns), F.lit(salts))).repartition(parts, right_key, salt)
    placed = bounded.where(F.col(left_key).isNotNull()).withColumn(at, F.floor((F.row_number().over(Window.partitionBy(left_key).orderBy(low)) - 1) / chunk))
    chunks = placed.groupBy(F.col(left_key).alias(key), at).agg(F.sort_array(F.collect_list(F.struct(low, *left_.columns))).alias(some)).drop(at)
    chunks = chunks.withColumn(salt_left, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))).repartition(parts, key, salt_left)
    # the chunks are on the side that is read on, the right rows of a part on the side that is read again for each
    met = chunks.join(dealt.hint("merge"), (F.col(key) == F.col(right_key)) & (F.col(salt_left) == F.col(salt)))
    pairs = met.select(*right.columns, F.explode(some).alias(one)).where(F.col(value) > F.col(f"{one}.{low}"))
    tops = right.groupBy(F.col(right_key).alias(key)).agg(F.max(value).alias(top))
    alone = bounded.join(tops, F.col(left_key) == F.col(key), "left").where(~F.coalesce(F.col(top) > F.col(low), F.lit(False)))
    padded = alone.select(*left_.columns, *(F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema))
    return pairs.select(*(F.col(f"{one}.{c}").alias(c) for c in left_.columns), *right.columns).unionByName(padded)
