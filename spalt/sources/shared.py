"""The folder that driver and executors share, and rows that are written there once."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _alone() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spalt-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on one machine alone, a new folder where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder or _alone()


def written(rows: DataFrame) -> DataFrame:
    """The rows, written as Parquet files in the shared folder and read from these: every plan over them sees the same."""
    folder = f"{shared_folder(rows.sparkSession)}/rows-{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)
