"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment (operator 10).

Words are runs of characters other than ASCII white space and punctuation, lower-cased; of scripts that put no spaces
between words each character is one. A first pass counts the words of the test items over all documents. A 3-gram of an
item is a rare seed if its words, taken as independent, would meet at a rate of RARE or less; rarity comes from single
words, so an item that leaked into a third of the documents keeps its seeds. An item with fewer than LEAST rare seeds uses
its LEAST rarest. The second pass joins the documents' 3-grams to the seeds. Hits of an item that lie close together in a
text make a passage; passages that can't reach the threshold even if all their words of the item aligned are dropped, and
the others are joined to their items and aligned: match +2, mismatch and gap -1, best local score over twice the item's
length is the similarity.

Everything is keyed by 64-bit hashes of words and of 3-grams and joined by Spark, however many items there are; what is
broadcast are two bit filters (of the items' words, of the seeds) of FILTER_BITS bits at most, which only save work: what
they let pass is joined. An alignment that reaches the threshold spans less than three times its item, so a long passage is
aligned in windows of six items' lengths, three apart, with two rows of scores at a time: memory follows the item, not the
text. Texts meet their hits in merge joins, at every size. A text's hits are one group, in proportion to its words; a seed that many texts hold meets its few items in a join
whose large partitions AQE can split.

Defined results: a null text or item is empty and matches nothing; items of fewer than three words have no seeds and
match nothing; of several passages the most similar counts, on ties the first; equal items count once; repeated rows give
repeated results, a null doc_id is like any other; empty tables give empty results; other columns stay out of the way.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spalt.llm.common import fresh, materialize, run_hashes, slices, with_row_key, word_hashes

GRAM = 3
RARE = 1e-8
LEAST = 4
THRESHOLD = 0.5
MATCH, MISS = 2, 1
#: Bits for each key of a filter, and bits of a filter at most.
KEY_BITS, FILTER_BITS = 32, 1 << 30
_SPACE = bytes(32 if not (chr(i).isalnum() or i >= 128) else i for i in range(256))
_WORD = np.frombuffer(_SPACE, np.uint8) != 32
#: Blocks of scripts without spaces between words (Thai to Myanmar, kana, Han).
_UNSPACED = re.compile("([฀-႟぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff])")


def plain(text: str | None) -> bytes:
    text = (text or "").lower()
    return (text if text.isascii() else _UNSPACED.sub(r" \1 ", text)).encode()


def words(text: str | None) -> list[bytes]:
    return plain(text).translate(_SPACE).split()


def hashed(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    return word_hashes([plain(t) for t in texts], _WORD)


class Filter:
    """Bits of keys: two for each. Never lacks a key; has some others."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(size: int):
        """The two places of a column `key` in a filter of `size` bits, a power of two."""
        return F.array(F.col("key").bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned("key", 34).bitwiseAND(F.lit(size - 1)))

    @classmethod
    def of(cls, keys: DataFrame) -> Filter:
        """Of distinct keys: Spark sets the bits of each 64-bit word; the words are what reaches the driver."""
        size = 64
        while size < min(FILTER_BITS, KEY_BITS * keys.count()):
            size *= 2
        at = keys.select(F.explode(cls.places(size)).alias("at"))
        one = F.expr("shiftleft(CAST(1 AS BIGINT), CAST(at & 63 AS INT))")
        rows = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
        bits = np.zeros(size // 64, np.int64)
        bits[rows["word"].to_numpy()] = rows["bits"].to_numpy()
        return cls(bits.view(np.uint64))

    def has(self, keys: np.ndarray) -> np.ndarray:
        size = np.uint64(64 * len(self.bits) - 1)
        out = np.ones(len(keys), bool)
        for at in (keys & size, keys >> np.uint64(34) & size):
            out &= (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local score of the item in the passage, and the passage's words [begin, end) that it covers.

    A cell holds the score in its upper half and the first column of its alignment below, so two rows are enough.
    """
    m, unit = len(passage), 1 << 32
    column = np.arange(m + 1, dtype=np.int64)
    step = column * (MISS * unit)
    above, best = column.copy(), (0, 0, 0)
    for word in item.tolist():
        row = np.maximum(above[:-1] + np.where(passage == word, MATCH, -MISS) * unit, above[1:] - MISS * unit)
        row = np.concatenate((column[:1], np.maximum(row, column[1:])))  # score 0 begins anew
        above = np.maximum.accumulate(row + step) - step  # gaps in the item, from any earlier column
        above = np.maximum(above, column)
        at = int(np.argmax(above >> 32))
        score = int(above[at]) >> 32
        if score > best[0]:
            best = (score, int(above[at]) & (unit - 1), at)
    return best


def similarity(item: np.ndarray, passage: np.ndarray, threshold: float) -> tuple[float, int, int] | None:
    """The best alignment of the item in the passage, if it reaches the threshold."""
    n, best = len(item), None
    need = threshold * MATCH * n
    kinds, own = np.unique(item, return_counts=True)
    for low in range(0, max(1, len(passage) - 3 * n), 3 * n):
        part = passage[low : low + 6 * n]
        at = np.minimum(np.searchsorted(kinds, part), len(kinds) - 1)
        there = np.bincount(at[kinds[at] == part], minlength=len(kinds))
        if MATCH * int(np.minimum(own, there).sum()) < need:
            continue
        score, a, b = align(item, part)
        if score >= need and (best is None or score > best[0]):
            best = (score, low + a, low + b)
    return best and (best[0] / (MATCH * n), best[1], best[2])


def item_words(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, hashes): distinct items of GRAM words and more, numbered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                hashes, starts = hashed(b.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0), lists], ["item_id", "hashes"])

    kind = T.StructType([T.StructField("item_id", benchmark.schema["item_id"].dataType), T.StructField("hashes", T.ArrayType(T.LongType()))])
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct().mapInArrow(run, kind)
    items = items.where(F.size("hashes") >= GRAM).distinct()
    return materialize(items.select(F.monotonically_increasing_id().alias("item"), "item_id", "hashes"), "items")


def count_words(docs: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, int]:
    """((key, n): occurrences over all documents of the keys and some others, all words). Tasks sum their own counts first."""
    held = docs.sparkSession.sparkContext.broadcast(Filter.of(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, keys, counts = 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["key", "n"])

        for whole in batches:
            for b in slices(whole, 0):
                hashes, _ = hashed(b.column(0).to_pylist())
                total += len(hashes)
                new, n = np.unique(hashes, return_counts=True)
                known = held.value.has(new)
                both, own = np.unique(np.concatenate((keys, new[known])), return_inverse=True)
                keys, counts = both, np.bincount(own, np.concatenate((counts, n[known])), len(both)).astype(np.int64)
                if len(keys) > 1_000_000:
                    yield rows()
                    keys, counts = keys[:0], counts[:0]
        yield rows()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())], ["key", "n"])

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "counts")
    total = counted.where("key IS NULL").first()
    return counted.where("key IS NOT NULL"), total["n"] if total else 0


def rare_seeds(items: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(key, item, n): the seeds of each item, and its words."""
    each = items.select("item", F.posexplode("hashes").alias("at", "key")).join(counts, "key", "left")
    lists = each.groupBy("item").agg(F.array_sort(F.collect_list(F.struct("at", "key", F.coalesce("n", F.lit(0)).alias("n")))).alias("w"))
    lists = lists.select("item", F.transform("w", lambda x: x["key"]).alias("hashes"), F.transform("w", lambda x: x["n"].cast("double")).alias("counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, hashes, seen in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                rate = np.log(np.maximum(np.array(seen), 0.5) / max(total, 1))
                grams = run_hashes(np.array(hashes, np.int64).view(np.uint64), GRAM)
                chance = sum(rate[k : k + len(grams)] for k in range(GRAM))
                rare = chance <= np.log(RARE)
                if rare.sum() < LEAST:
                    rare = np.zeros(len(grams), bool)
                    rare[np.argsort(chance, kind="stable")[:LEAST]] = True
                found = np.unique(grams[rare]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), item, np.int64)), pa.array(np.full(len(found), len(hashes), np.int32))], ["key", "item", "n"])

    return materialize(lists.mapInArrow(run, "key long, item long, n int"), "seeds")


def hits(docs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(row, item, n, at): where the texts of docs (row, text) hold a seed of an item."""
    held = docs.sparkSession.sparkContext.broadcast(Filter.of(seeds.select("key").distinct()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                hashes, starts = hashed(b.column(1).to_pylist())
                grams = run_hashes(hashes, GRAM)
                at = np.flatnonzero(held.value.has(grams))
                doc = np.searchsorted(starts, at, side="right") - 1
                inside = at + GRAM <= starts[doc + 1]
                at, doc = at[inside], doc[inside]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(grams[at].view(np.int64)), pa.array(at - starts[doc])], ["row", "key", "at"])

    kind = T.StructType([docs.schema["row"], T.StructField("key", T.LongType()), T.StructField("at", T.LongType())])
    met = docs.select("row", F.col("text").cast("string").alias("text")).mapInArrow(run, kind)
    return met.join(seeds, "key").select("row", "item", "n", "at")


def passages(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(row, item, low, part): the words of docs (row, text) about each run of hits of an item, from word `low` on."""
    lists = found.groupBy("row").agg(F.collect_list(F.struct("item", "at", "n")).alias("met")).withColumnRenamed("row", "own")
    whole = docs.join(lists.hint("merge"), F.col("row") == F.col("own")).select("row", F.col("text").cast("string").alias("text"), "met")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                hashes, _ = hashed([b.column(1)[i].as_py()])
                met = b.column(2)[i].values
                item, at, n = (met.field(c).to_numpy() for c in ("item", "at", "n"))
                order = np.lexsort((at, item))
                item, at, n = item[order], at[order], n[order]
                new = np.ones(len(item), bool)
                new[1:] = (item[1:] != item[:-1]) | (at[1:] - at[:-1] > 2 * n[1:])
                first = np.flatnonzero(new)
                last = np.append(first[1:], len(item)) - 1
                low = np.maximum(0, at[first] - 2 * n[first])
                high = np.minimum(len(hashes), at[last] + GRAM + 2 * n[first])
                parts = [hashes[a:z].view(np.int64) for a, z in zip(low.tolist(), high.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.full(len(first), i))), pa.array(item[first]), pa.array(low), pa.array(parts, pa.list_(pa.int64()))], ["row", "item", "low", "part"])

    kind = T.StructType([docs.schema["row"], T.StructField("item", T.LongType()), T.StructField("low", T.LongType()), T.StructField("part", T.ArrayType(T.LongType()))])
    return whole.mapInArrow(run, kind)


def aligned(parts: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """(row, item_id, similarity, begin_word, end_word): each text's best passage of each item, if it reaches the threshold."""
    both = parts.join(items, "item").select("row", "item", "item_id", "low", "part", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, out = [], []
            for i in range(b.num_rows):
                part, item = (b.column(c)[i].values.to_numpy() for c in (4, 5))
                best = similarity(item, part, threshold)
                if best:
                    rows.append(i)
                    low = b.column(3)[i].as_py()
                    out.append((best[0], low + best[1], low + best[2]))
            columns = [b.column(c).take(pa.array(rows, pa.int64())) for c in (0, 1, 2)]
            values = list(zip(*out, strict=True)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(v, k) for v, k in zip(values, (pa.float64(), pa.int64(), pa.int64()), strict=True))], ["row", "item", "item_id", "similarity", "begin_word", "end_word"])

    kind = T.StructType([*(both.schema[c] for c in ("row", "item", "item_id")), T.StructField("similarity", T.DoubleType()), T.StructField("begin_word", T.LongType()), T.StructField("end_word", T.LongType())])
    best = F.max(F.struct("similarity", (-F.col("begin_word")).alias("first"), "end_word", "item_id")).alias("best")
    found = both.mapInArrow(run, kind).groupBy("row", "item").agg(best)
    return found.select("row", "best.item_id", "best.similarity", (-F.col("best.first")).alias("begin_word"), "best.end_word")


def found_items(docs: DataFrame, benchmark: DataFrame, threshold: float) -> DataFrame:
    """aligned() over docs (row, text), written once."""
    items = item_words(benchmark)
    counts, total = count_words(docs, items.select(F.explode("hashes").alias("key")).distinct())
    found = materialize(hits(docs, rare_seeds(items, counts, total)), "hits")
    return materialize(aligned(passages(docs, found), items, threshold), "found")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, similarity, begin_word, end_word): the documents' passages that hold a copy, maybe edited, of an item."""
    keyed = with_row_key(docs.select("doc_id", "text"), "row").select("row", "text")
    return found_items(keyed, benchmark, threshold).select("row.doc_id", "item_id", "similarity", "begin_word", "end_word")


def keep_clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that hold no test item, with the columns of docs."""
    row, out = fresh("row", docs), fresh("out", docs)
    keyed = with_row_key(docs, row)
    found = found_items(keyed.select(F.col(row).alias("row"), "text"), benchmark, threshold)
    return keyed.join(found.select(F.col("row").alias(out)).distinct().hint("merge"), F.col(row) == F.col(out), "left_anti").drop(row)
