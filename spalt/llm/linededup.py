"""Line dedup by overlapping three-line windows (operator 2), in DataFrame functions alone.

Lines are the pieces of a text between newlines, compared exactly. Every three consecutive lines of a document that
are not all blank make a window, known by two 64-bit hashes over the hashes of its lines. Of the windows that occur
more than once in the table, the first by (doc_id, line number) stays; the lines that any later occurrence covers,
merged over overlapping windows, are removed.

Only keys and positions are shuffled to find repeats. A window that a large share of the rows hold is counted with
partial sums, and its rows are joined to the one row of its key, a join whose large partitions AQE can split. All
joins are merge joins, at every size: what they join grows with the table.

Defined results: a null text stays null with no lines; a text of fewer than three lines stays; a text all of whose
lines go becomes empty. Each row is a document of its own, known by with_row_key(); doc_id gives the order alone, rows
without one come first, and rows with the same doc_id are ordered by a hash of the text. An empty table gives an empty
result. Other columns stay, and a new column whose name is taken gets a _ behind it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spalt.llm.common import added, fresh, materialize, with_row_key

KEY = ["k1", "k2"]


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(docs: DataFrame) -> DataFrame:
    """(row, pos, k1, k2) of docs (row, text): one row for every window that is not blank."""
    hashed = docs.select(
        "row",
        # a blank line has the hash 0, so that blank windows are known without their text
        F.transform(split_lines(F.col("text")), lambda x: F.when(F.trim(x) == "", F.lit(0).cast("long")).otherwise(F.xxhash64(x))).alias("h"),
    ).where(F.size("h") >= 3)
    n = F.size("h") - 2
    shifted = F.arrays_zip(F.slice("h", F.lit(1), n).alias("a"), F.slice("h", F.lit(2), n).alias("b"), F.slice("h", F.lit(3), n).alias("c"))
    rows = hashed.select("row", F.posexplode(shifted).alias("pos", "w")).select("row", "pos", "w.a", "w.b", "w.c")
    rows = rows.where("a <> 0 OR b <> 0 OR c <> 0")
    return rows.select("row", "pos", F.xxhash64("a", "b", "c").alias("k1"), F.xxhash64("c", F.lit(1), "a", "b").alias("k2"))


def removed_lines(docs: DataFrame) -> DataFrame:
    """(row, removed): the sorted line numbers that a row of docs (row, text) loses; rows that lose none have no row."""
    all_windows = windows(docs)
    repeated = materialize(all_windows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*KEY), "repeated")
    found = materialize(all_windows.join(repeated.hint("merge"), KEY), "found")
    first = materialize(found.groupBy(*KEY).agg(F.min(F.struct("row", "pos")).alias("first")), "first")
    later = found.join(first.hint("merge"), KEY).where(F.struct("row", "pos") > F.col("first"))
    lines = later.select("row", F.explode(F.array(F.col("pos"), F.col("pos") + 1, F.col("pos") + 2)).alias("line"))
    return lines.groupBy("row").agg(F.array_sort(F.collect_set("line")).alias("removed"))


def dedup_lines(docs: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """docs with repeated passages cut from text, and two more columns: n_lines and n_removed (renamed by names)."""
    n_lines, n_removed = added(docs, ["n_lines", "n_removed"], names)
    row, key, taken = fresh("row", docs), fresh("removed_row", docs), fresh("removed", docs)
    keyed = with_row_key(docs, row)
    gone = materialize(removed_lines(keyed.select(F.col(row).alias("row"), "text")), "removed").select(F.col("row").alias(key), F.col("removed").alias(taken))
    joined = keyed.join(gone.hint("merge"), F.col(row) == F.col(key), "left")
    # `lines` is a column of its own, used several times: Spark splits a text once, not once for each line
    lines = fresh("lines", joined)
    joined = joined.withColumn(lines, split_lines(F.col("text")))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(taken))
    cut = F.array_join(F.transform(kept, lambda i: F.get(F.col(lines), i)), "\n")
    return joined.select(
        *(F.when(F.col(taken).isNull(), F.col("text")).otherwise(cut).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias(n_lines),
        F.coalesce(F.size(taken), F.lit(0)).cast("long").alias(n_removed),
    )
