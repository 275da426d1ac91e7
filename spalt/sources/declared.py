"""Declared tables: column rules, and INSERT, UPDATE and DELETE as DataFrame transformations.

A table's state is an immutable DataFrame. Each statement gives the next state, or an error that leaves the state as it
was; keeping an earlier DataFrame is a snapshot. Rules are checked by aggregates, never row by row in the driver, and over
what a statement brings alone: new rows against each other and, in unique columns, by a semi join against the state. States
that live in files are spalt.sources.stored's.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark.sql.window import Window

from spalt.errors import AnalysisError, ConstraintError, TypeMismatch
from spalt.operators.names import fresh
from spalt.operators.relational import Key, sort_keys
from spalt.sources.shared import written


@dataclass(frozen=True)
class Rule:
    """A column of a declared table.

    check: a condition over the row; a NULL result fails. domain: a condition over the column; a NULL result passes.
    coerce: Column -> Column, applied to what is written, for canonical forms and lengths. scalar: the name of the scalar
    whose canonical texts the column holds, for the rules of order.
    """

    name: str
    kind: str
    nullable: bool = True
    default: Any = None
    auto_increment: bool = False
    unique: bool = False
    check: str | None = None
    domain: str | None = None
    coerce: Any = None
    scalar: str | None = None

    def written(self, value: Column) -> Column:
        """What the column holds of a value that is written to it."""
        value = self.coerce(value) if self.coerce else value
        return value.cast(self.kind).alias(self.name, metadata={"scalar": self.scalar} if self.scalar else {})

    def literal(self, value: Any) -> Any:
        """A Python value of the kind: whole numbers become doubles or decimals, texts become dates."""
        if value is None or self.coerce:
            return None if value is None else str(value)
        number = isinstance(value, int | float | Decimal) and not isinstance(value, bool)
        kind = T.DataType.fromDDL(self.kind)
        if isinstance(kind, T.FractionalType) and number:
            return Decimal(str(value)) if isinstance(kind, T.DecimalType) else float(value)
        if isinstance(kind, T.IntegralType) and number and value == int(value):
            return int(value)
        if isinstance(value, str) and isinstance(kind, T.DateType | T.TimestampType):
            return (datetime.date if isinstance(kind, T.DateType) else datetime.datetime).fromisoformat(value)
        fits = (T.StringType, str), (T.BooleanType, bool), (T.BinaryType, bytes | bytearray), (T.DateType, datetime.date), (T.TimestampType, datetime.datetime)
        if any(isinstance(kind, k) and not isinstance(value, v) for k, v in fits) or isinstance(kind, T.NumericType):
            raise TypeMismatch(f"type error: cannot put this value into column {self.name}: {value!r}")
        return value


@dataclass(frozen=True)
class Declared:
    rules: tuple[Rule, ...]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(r.name, T.DataType.fromDDL(r.kind), True, {"declared": r.kind} | ({"scalar": r.scalar} if r.scalar else {})) for r in self.rules])

    def empty(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([], self.schema)

    def names(self) -> list[str]:
        return [r.name for r in self.rules]

    def rule(self, name: str, statement: str = "ALTER TABLE") -> Rule:
        for r in self.rules:
            if r.name == name:
                return r
        raise AnalysisError(f"unknown column in {statement}: {name} (available: {', '.join(self.names())})")

    def check_rows(self, rows: DataFrame) -> DataFrame:
        """rows, if each keeps the rules of its own: one aggregate over them."""
        tests: list[tuple[str, Column]] = []
        for r in self.rules:
            if not r.nullable or r.auto_increment:
                tests.append((f"NOT NULL: column {r.name} cannot be null", F.col(r.name).isNull()))
            if r.check:
                tests.append((f"CHECK on {r.name} failed", ~F.coalesce(F.expr(r.check), F.lit(False))))
            if r.domain:
                tests.append((f"CHECK on DOMAIN {r.name} failed", ~F.coalesce(F.expr(r.domain), F.lit(True))))
        if tests:
            found = rows.agg(*(F.count_if(t).alias(f"t{i}") for i, (_, t) in enumerate(tests))).first()
            for i, (message, _) in enumerate(tests):
                if found[i]:
                    raise ConstraintError(message)
        return rows

    def check_unique(self, rows: DataFrame, beside: DataFrame | None = None, columns: Sequence[str] | None = None) -> DataFrame:
        """rows, if no unique column (of `columns`) has a value twice in them, or in them and in rows beside them."""
        for r in self.rules:
            if r.unique and (columns is None or r.name in columns):
                some = rows.where(F.col(r.name).isNotNull()).select(r.name)
                twice = some.groupBy(r.name).count().where("count > 1")
                if not twice.isEmpty() or (beside is not None and not beside.select(r.name).join(some, r.name, "left_semi").isEmpty()):
                    raise ConstraintError(f"UNIQUE: duplicate value in column {r.name}")
        return rows

    def validate(self, state: DataFrame) -> DataFrame:
        """state, if all rules hold on all of it."""
        return self.check_unique(self.check_rows(state))

    def new_rows(self, state: DataFrame, columns: Sequence[str], rows: Sequence[Sequence[Any]]) -> DataFrame:
        """The rows of one VALUES list as the table holds them, if they may follow state; missing columns get their default, the next number, or NULL."""
        self._known(columns)
        if any(len(v) != len(columns) for v in rows):
            raise AnalysisError("INSERT: a row's values don't match the columns")
        full = [dict(zip(columns, v, strict=True)) for v in rows]
        for r in self.rules:
            if r.auto_increment:
                top = state.agg(F.max(r.name)).first()[0] or 0
                for row in full:
                    if row.get(r.name) is None:
                        row[r.name] = top + 1
                    top = max(top, row[r.name])
            elif r.name not in columns:
                for row in full:
                    row[r.name] = r.default
        values = [tuple(r.literal(row.get(r.name)) for r in self.rules) for row in full]
        kinds = T.StructType([T.StructField(r.name, T.StringType() if r.coerce else T.DataType.fromDDL(r.kind)) for r in self.rules])
        new = state.sparkSession.createDataFrame(values, kinds).select(*(r.written(F.col(r.name)) for r in self.rules))
        return self.check_unique(self.check_rows(new), state)

    def rows_of(self, state: DataFrame, source: DataFrame, order: Sequence[Key] = ()) -> DataFrame:
        """The rows of a DataFrame as the table holds them, if they may follow state.

        An AUTO_INCREMENT column that source lacks is numbered in `order`: Spark deals the rows to ranges, counts each
        range, and a row's number is its range's first and its place there. The dealt rows are written once below the
        shared folder: a second plan of the same rows would deal them to other ranges. Rows that the order leaves tied
        come in any order.
        """
        self._known(source.columns)
        number = next((r.name for r in self.rules if r.auto_increment and r.name not in source.columns), None)
        if number:
            if not order:
                raise AnalysisError("INSERT: rows without numbers need an order")
            part, at = fresh("part", source), fresh("at", source)
            dealt = source.orderBy(*sort_keys(source, order)).withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id() % (1 << 33))
            dealt = written(dealt)
            first = fresh("first", source)
            sizes = dealt.groupBy(part).count()  # a row for each range
            before = sizes.select(part, (F.sum("count").over(Window.orderBy(part)) - F.col("count")).alias(first))
            top = state.agg(F.coalesce(F.max(number), F.lit(0)).alias("top")).scalar()
            source = dealt.join(before, part).withColumn(number, top + F.col(first) + F.col(at) + 1).drop(part, at, first)
        given = set(source.columns)
        new = source.select(*(r.written(F.col(r.name) if r.name in given else F.lit(r.literal(r.default))) for r in self.rules))
        return self.check_unique(self.check_rows(new), state)

    def _known(self, columns: Sequence[str]) -> None:
        if len(set(columns)) != len(columns):
            raise AnalysisError("INSERT: a column is named twice")
        for c in columns:
            self.rule(c, "INSERT")

    def insert(self, state: DataFrame, columns: Sequence[str], rows: Sequence[Sequence[Any]]) -> DataFrame:
        """The state and the rows of one VALUES list."""
        return state.unionByName(self.new_rows(state, columns, rows))

    def insert_from(self, state: DataFrame, source: DataFrame, order: Sequence[Key] = ()) -> DataFrame:
        """The state and the rows of a DataFrame."""
        return state.unionByName(self.rows_of(state, source, order))

    def update(self, state: DataFrame, assignments: Sequence[tuple[str, Column]], where: Column | None = None) -> DataFrame:
        """Assignments from left to right, later ones seeing earlier results; the rows are chosen before any."""
        mark = fresh("chosen", state)
        out = state.withColumn(mark, F.lit(True) if where is None else F.coalesce(where, F.lit(False)))
        for c, e in assignments:
            rule = self.rule(c, "UPDATE")
            out = out.withColumn(c, F.when(F.col(mark), rule.written(e)).otherwise(F.col(c)))
        self.check_rows(out.where(F.col(mark)))
        return self.check_unique(out.drop(mark), columns=[c for c, _ in assignments])

    def delete(self, state: DataFrame, where: Column | None = None) -> DataFrame:
        """Rows for which the condition is not TRUE."""
        return state.limit(0) if where is None else state.where(~F.coalesce(where, F.lit(False)))


def declared(*rules: Rule) -> Declared:
    if sum(r.auto_increment for r in rules) > 1:
        raise AnalysisError("one AUTO_INCREMENT column at most")
    return Declared(tuple(rules))


def add_column(state: DataFrame, table: Declared, rule: Rule) -> tuple[DataFrame, Declared]:
    """ALTER TABLE ADD COLUMN: old rows get the default, in its canonical form."""
    if rule.name in state.columns:
        raise AnalysisError(f"column {rule.name} already exists")
    after = Declared((*table.rules, rule))
    return after.validate(state.withColumn(rule.name, rule.written(F.lit(rule.literal(rule.default))))), after


def drop_column(state: DataFrame, table: Declared, name: str) -> tuple[DataFrame, Declared]:
    if name not in state.columns:
        raise AnalysisError(f"unknown column: {name}")
    return state.drop(name), Declared(tuple(r for r in table.rules if r.name != name))


def _renamed(condition: str | None, old: str, new: str) -> str | None:
    """A condition that names a column by its new name; texts stay as they are."""
    def name(m: re.Match) -> str:
        return f"`{new}`" if m[0].strip("`").lower() == old.lower() else m[0]

    return condition and re.sub(r"'(?:[^']|'')*'|`[^`]*`|[A-Za-z_][A-Za-z_0-9]*", name, condition)


def rename_column(state: DataFrame, table: Declared, old: str, new: str) -> tuple[DataFrame, Declared]:
    """ALTER TABLE RENAME COLUMN: conditions of all columns follow."""
    if old not in state.columns or new in state.columns:
        raise AnalysisError(f"cannot rename {old} to {new}")
    rules = (replace(r, name=new if r.name == old else r.name, check=_renamed(r.check, old, new), domain=_renamed(r.domain, old, new)) for r in table.rules)
    return state.withColumnRenamed(old, new), Declared(tuple(rules))


def _altered(table: Declared, name: str, **changes: Any) -> Declared:
    table.rule(name)
    return Declared(tuple(replace(r, **changes) if r.name == name else r for r in table.rules))


def set_type(state: DataFrame, table: Declared, name: str, kind: str, coerce: Any = None) -> tuple[DataFrame, Declared]:
    """ALTER COLUMN TYPE: the column is cast, a value that can't be is an error, and all rules are checked again."""
    after = _altered(table, name, kind=kind, coerce=coerce)
    return after.validate(state.withColumn(name, after.rule(name).written(F.col(name)))), after


def set_default(table: Declared, name: str, default: Any) -> Declared:
    """ALTER COLUMN SET DEFAULT; None drops it. Old rows stay."""
    after = _altered(table, name, default=default)
    after.rule(name).literal(default)
    return after


def set_nullable(state: DataFrame, table: Declared, name: str, nullable: bool) -> Declared:
    """ALTER COLUMN DROP NOT NULL, or SET NOT NULL if no row has a NULL."""
    after = _altered(table, name, nullable=nullable)
    after.check_rows(state)
    return after


def alter_domain(state: DataFrame, table: Declared, name: str, condition: str | None, nullable: bool = True) -> Declared:
    """ALTER DOMAIN of a column: a new condition over VALUE, if all rows keep it."""
    after = _altered(table, name, domain=condition and re.sub(r"\bVALUE\b", f"`{name}`", condition), nullable=nullable)
    after.check_rows(state)
    return after


def with_domains(domains: Mapping[str, tuple[str, str | None, bool, Any]], name: str, domain: str) -> Rule:
    """A column of a named domain: (kind, condition over VALUE, nullable, default)."""
    kind, condition, nullable, default = domains[domain]
    return Rule(name, kind, nullable=nullable, default=default, domain=condition and re.sub(r"\bVALUE\b", f"`{name}`", condition))
