"""Enums, optional values, lists and tuples as Spark structs and arrays, whose own order and equality serve them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from spalt.errors import AnalysisError


def enum(label: Column, labels: Sequence[str]) -> Column:
    """struct(ord, label): orders, groups and joins in the order of declaration; an unknown label is an error."""
    if len(set(labels)) != len(labels):
        raise AnalysisError("enum labels must be unique")
    at = F.array_position(F.array(*map(F.lit, labels)), label).cast("int")
    at = F.when(label.isNotNull() & (at == 0), F.raise_error(F.concat(F.lit("not a label: "), label)).cast("int")).otherwise(at)
    return F.when(label.isNotNull(), F.struct(at.alias("ord"), label.alias("label")))


def enum_label(value: Column) -> Column:
    return value["label"]


def enum_literal(value: str, labels: Sequence[str]) -> Column:
    """A text that takes the enum type of the other side of a comparison."""
    if value not in labels:
        raise AnalysisError(f"not a label: {value}")
    return enum(F.lit(value), labels)


def _inside(values: Sequence[Column], made: Column, kinds: Sequence[str] | None) -> tuple[Column, Column]:
    """(a condition that is TRUE, or an error where a value is NULL or not of its type, made)."""
    bad = F.lit(False)
    for i, v in enumerate(values):
        bad = bad | v.isNull()
        if kinds is not None:
            bad = F.when(F.typeof(v) != F.lit(kinds[i]), F.raise_error(F.concat(F.lit(f"type error: expected {kinds[i]}, not "), F.typeof(v))).cast("boolean")).otherwise(bad)
    return F.when(bad, F.raise_error(F.lit("type error: NULL inside a composite value")).cast("boolean")).otherwise(F.lit(True)), made


def some(value: Column) -> Column:
    """An optional that holds a value, which is not NULL: an array of one. NULL < nothing < something."""
    sound, made = _inside([value], F.array(value), None)
    return F.when(sound, made)


def nothing(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def maybe(value: Column, kind: str) -> Column:
    """NULL becomes the empty optional, which is not SQL NULL."""
    return F.when(value.isNull(), nothing(kind)).otherwise(F.array(value.cast(kind)))


def list_of(*values: Column, kind: str | None = None) -> Column:
    """A list without NULLs; of exactly this type if kind is given."""
    if not values:
        return nothing(kind or "void")
    sound, made = _inside(values, F.array(*values), [kind] * len(values) if kind else None)
    return F.when(sound, made)


def tuple_of(*values: Column, kinds: Sequence[str] | None = None) -> Column:
    """A tuple without NULLs; of exactly these types if kinds are given."""
    sound, made = _inside(values, F.struct(*(v.alias(f"_{i}") for i, v in enumerate(values, 1))), kinds)
    return F.when(sound, made)
