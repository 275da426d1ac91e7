"""What the corpus operators share: tables, Arrow mapping over texts, tables in the shared folder."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows and bytes of text that a Python function gets at once; texts of some hundred KB still make a moderate batch.
BATCH_ROWS = 300
BATCH_BYTES = 3_000_000


@contextmanager
def arrow_batches(spark: SparkSession) -> Iterator[None]:
    """Bound what an Arrow batch holds, in rows and in bytes, for what runs inside; the session's own settings come back."""
    bounds = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {k: spark.conf.get(k) for k in bounds}
    for k, v in bounds.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of BATCH_ROWS rows at most, and of BATCH_BYTES bytes of that column unless one row has more."""
    if batch.num_rows <= BATCH_ROWS and (batch.num_rows <= 1 or batch.column(column).nbytes <= BATCH_BYTES):
        if batch.num_rows:
            yield batch
        return
    half = min(BATCH_ROWS, (batch.num_rows + 1) // 2)
    for i in range(0, batch.num_rows, half):
        yield from slices(batch.slice(i, half), column)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on one machine alone, a new folder where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = _alone()
    return folder


@lru_cache(maxsize=1)
def _alone() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spalt-")


#: Folders that materialize() wrote and forget() has not deleted, oldest first.
_written: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it: cuts the lineage, and survives lost executors."""
    folder = f"{shared_folder(df.sparkSession)}/spalt-{uuid.uuid4().hex}"
    _written.append(folder)
    with arrow_batches(df.sparkSession):
        df.write.parquet(f"{folder}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")


def table_folder(spark: SparkSession, name: str) -> str:
    """A folder for a table of that name, which forget() deletes like those of materialize()."""
    _written.append(f"{shared_folder(spark)}/spalt-{name}")
    return _written[-1]


def forget(spark: SparkSession, start: int = 0) -> int:
    """Delete the tables that materialize() has written since `start`, all but the last; the number to begin from next time."""
    for folder in _written[start:-1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    del _written[start:-1]
    return start


def written() -> int:
    return len(_written)


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has, whatever their extra columns are called."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_key(docs: DataFrame, name: str) -> DataFrame:
    """docs and a struct column that no two rows share and that every plan gives to the same row: (doc_id, h, copy).

    h is a hash of the text. Rows that agree in doc_id and h are written once with a number each, `copy`; all others
    are known by the two, without a copy of the table. The key's order is that of doc_id, nulls first.
    """
    twin, own = fresh("twin", docs), F.struct(F.col("doc_id"), F.xxhash64("text").alias("h"))
    twins = materialize(docs.select(own.alias(twin)).groupBy(twin).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(twin), "twins")
    numbered = lambda rows, copy: rows.withColumn(name, F.struct(F.col("doc_id"), F.xxhash64("text").alias("h"), copy.alias("copy")))
    if twins.isEmpty():
        return numbered(docs, F.lit(0).cast("long"))
    again = materialize(numbered(docs.join(twins, own == F.col(twin), "left_semi"), F.monotonically_increasing_id()), "again")
    return numbered(docs.join(twins, own == F.col(twin), "left_anti"), F.lit(0).cast("long")).unionByName(again)


def word_hashes(texts: Sequence[bytes], is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words of all texts, the place of each text's first and the end): words are runs of the bytes
    that is_word marks, a space not among them; each distinct word is hashed once."""
    import xxhash

    data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    word = is_word[data]
    start = word.copy()
    start[1:] &= ~word[:-1]
    first = np.flatnonzero(start)
    packed = data[word]
    offsets = np.append(np.flatnonzero(start[word]), len(packed)).astype(np.int32)
    coded = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).dictionary_encode()
    known = np.fromiter(map(xxhash.xxh64_intdigest, coded.dictionary.to_numpy(zero_copy_only=False)), np.uint64, len(coded.dictionary))
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return known[coded.indices.to_numpy()], np.searchsorted(first, begins)


#: Odd factors of the mixing of hashes.
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9], np.uint64)


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each `size` consecutive words."""
    n = max(0, len(hashes) - size + 1)
    g = np.full(n, size, np.uint64)
    for k in range(size):
        g = (g ^ g >> np.uint64(29)) * ODD[k % len(ODD)] + hashes[k : k + n]
    g *= ODD[0]
    return g ^ g >> np.uint64(32)


def crc32_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; null for a null key."""
    return F.crc32(key.cast("string")) % n


def with_text_columns(
    docs: DataFrame, fields: Sequence[T.StructField], make: Callable[[], Callable[[list], list]], text: str = "text", keep: Sequence[str] | None = None
) -> DataFrame:
    """Append columns computed from a text column in parts of Arrow batches.

    make() runs once in a task and gives a function from a list of texts (or None) to one list or Arrow array for
    each field. keep: the columns of docs that stay (all by default); a field can't have the name of one of them.
    """
    keep = list(docs.columns if keep is None else keep)
    clash = {c.lower() for c in keep} & {f.name.lower() for f in fields}
    if clash:
        raise ValueError(f"the table has columns {sorted(clash)} already: name the new ones otherwise")
    slot = fresh("text__", docs)
    source = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").cast("string").alias(slot))
    kinds = [to_arrow_type(f.dataType) for f in fields]
    n, names = len(keep), [*keep, *(f.name for f in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for whole in batches:
            for b in slices(whole, n):
                out = compute(b.column(n).to_pylist())
                made = [x.cast(k) if isinstance(x, pa.Array) else pa.array(x, type=k) for x, k in zip(out, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:n], *made], names)
        del compute
        give_back()

    return source.mapInArrow(run, T.StructType([*(docs.schema[c] for c in keep), *fields]))


def give_back() -> None:
    """What a task's Python has freed goes back to the system: workers outlive their tasks and wait beside others."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def added(docs: DataFrame, columns: Sequence[str], names: dict[str, str] | None = None) -> list[str]:
    """Names for new columns: those that `names` gives, else their own, with _ behind them where docs has such a column."""
    return [(names or {}).get(c) or fresh(c, docs) for c in columns]
