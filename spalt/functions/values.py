"""Expressions with strict semantics: typed division, decimals kept as doubles, text length, negation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spalt.errors import TypeMismatch


def _nonzero(b: Column) -> Column:
    return F.when(b == 0, F.raise_error(F.lit("division by zero")).cast("int")).otherwise(F.lit(1))


def divide_int(a: Column, b: Column) -> Column:
    """Integer division that truncates toward zero; a zero divisor is an error, NULL gives NULL."""
    return F.when(_nonzero(b) == 1, F.call_function("div", a.cast("long"), b.cast("long")))


def divide(a: Column, b: Column) -> Column:
    """Division of doubles; a zero divisor is an error too."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(_nonzero(b) == 1, a / b)


def decimal(x: Column, precision: int = 10, scale: int = 0) -> Column:
    """A double rounded half-even to `scale` places, an error from 10^(precision - scale) on."""
    y = F.rint(x.cast("double") * F.lit(10.0**scale)) / F.lit(10.0**scale)
    return F.when(F.abs(y) >= F.lit(10.0 ** (precision - scale)), F.raise_error(F.lit("decimal value exceeds precision")).cast("double")).otherwise(y)


def length(text: Column) -> Column:
    """Code points of a text."""
    return F.length(text)


def negate(b: Column) -> Column:
    """NOT with NULL for NULL."""
    return ~b


def bounded_text(text: Column, n: int) -> Column:
    """A text of at most n characters; longer is an error, nothing is cut or padded."""
    return F.when(F.length(text) > n, F.raise_error(F.lit(f"text longer than {n} characters")).cast("string")).otherwise(text)


_COMPARE = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def family(kind: T.DataType) -> str:
    """What a type can be compared with: numbers with numbers, every other type with its own."""
    return "number" if isinstance(kind, T.NumericType) else kind.simpleString()


def compare(df: DataFrame, left: Column, op: str, right: Column) -> Column:
    """left op right over rows of df, an error for types of different families, where Spark would cast one; NULL compares with all."""
    kinds = [f.dataType for f in df.select(left.alias("a"), right.alias("b")).schema]
    if not any(isinstance(k, T.NullType) for k in kinds) and family(kinds[0]) != family(kinds[1]):
        raise TypeMismatch(f"type error: cannot compare these values ({kinds[0].simpleString()} and {kinds[1].simpleString()})")
    return _COMPARE[op](left, right)
