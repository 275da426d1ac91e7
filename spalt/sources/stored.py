"""Declared tables whose rows are Parquet files, written by Spark.

A table is a list of folders. INSERT writes its new rows into one more; UPDATE and DELETE write what is left into a new one.
A statement gives a new value of the table and changes no file of the old one, so an old value is a snapshot or a savepoint,
and a statement that fails leaves what was. drop() deletes what no kept value needs. Several writers at a time are the work
of a table format.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession

from spalt.operators.relational import Key
from spalt.sources.declared import Declared
from spalt.sources.shared import shared_folder


@dataclass(frozen=True)
class Stored:
    spark: SparkSession
    table: Declared
    base: str
    folders: tuple[str, ...] = ()

    @classmethod
    def create(cls, spark: SparkSession, table: Declared, base: str | None = None) -> Stored:
        """A table without rows, below base or the shared folder."""
        return cls(spark, table, f"{base or shared_folder(spark)}/table-{uuid.uuid4().hex}")

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.table.schema).parquet(*self.folders) if self.folders else self.table.empty(self.spark)

    def _write(self, rows: DataFrame) -> str:
        folder = f"{self.base}/{uuid.uuid4().hex}"
        rows.write.parquet(folder)
        return folder

    def _append(self, new: DataFrame) -> Stored:
        return replace(self, folders=(*self.folders, self._write(new)))

    def insert(self, columns: Sequence[str], rows: Sequence[Sequence[Any]]) -> Stored:
        return self._append(self.table.new_rows(self.read(), columns, rows))

    def insert_from(self, source: DataFrame, order: Sequence[Key] = ()) -> Stored:
        return self._append(self.table.rows_of(self.read(), source, order))

    def replace_all(self, rows: DataFrame) -> Stored:
        """These rows alone, if all rules hold on them."""
        return replace(self, folders=(self._write(self.table.rows_of(self.table.empty(self.spark), rows)),))

    def update(self, assignments: Sequence[tuple[str, Column]], where: Column | None = None) -> Stored:
        return replace(self, folders=(self._write(self.table.update(self.read(), assignments, where)),))

    def delete(self, where: Column | None = None) -> Stored:
        return replace(self, folders=(self._write(self.table.delete(self.read(), where)),))

    def drop(self, keep: Sequence[Stored] = ()) -> None:
        """Delete the folders of this value that none of `keep` has."""
        for folder in set(self.folders) - {f for k in keep for f in k.folders}:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
