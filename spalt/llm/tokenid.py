"""Token ids as files of Simple-8b blocks (operator 7), and exact counts of encoded lengths (operator 4).

The ids of documents follow each other in ascending doc_id order, each document's ended by one more id. The documents
are dealt out by ranges of (doc_id, hash of the text), so that one doc_id on many rows is no single range, and sorted
within each; a range is a shard. A shard is a sequence of rows of a Parquet table in the shared folder: some hundreds
of whole documents each, their ids as one Simple-8b payload (spalt.llm.simple8b) with the documents' lengths beside it
and the place of the first id in the shard. Only one total for each shard goes through the driver, for the place of
the shard's first id in the whole.

Defined results: a null text is like an empty one and holds its end id alone; null doc_ids come first; rows with the
same doc_id follow each other by the hash of their text, and equal rows are written as often as they occur; an empty
table has no shards and no rows.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spalt.llm import simple8b
from spalt.llm.common import materialize, slices, with_text_columns

#: Words whose ids a worker remembers; beyond it, it starts anew.
STORE = 600_000
#: Words that the library encodes in one call, a space between them.
RUN = 1000
_SPACE, _LETTER, _DIGIT, _MARK, _OTHER = range(5)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Kind of each byte of a lower-case plain text in UTF-8: ASCII, and the letters of Latin-1 that begin with the byte C3."""
    kinds = np.full(256, _OTHER, np.uint8)
    kinds[33:127] = _MARK
    kinds[[0, *range(9, 14), 32]] = _SPACE
    kinds[list(b"0123456789")] = _DIGIT
    kinds[[*range(97, 123), *range(0x80, 0xC0), 0xC3]] = _LETTER
    return kinds


class _Places(dict):
    """Word -> its number, given out as words come; `new` has those of late."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, word) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class WordCodec:
    """Ids of the tokenizers library, found once for each word.

    The file's normaliser and pre-tokenizer never look across ASCII white space. Texts of plain characters (_kinds) are
    cut at once, as arrays of bytes, into the lower-case words of the file's own pattern; their equal words are one entry
    of an Arrow dictionary. Any other text is cut at ASCII white space alone, and a text with a special token's string not
    at all. The library encodes each new word once, plain ones in runs that the end-of-word pieces part again; what it
    gave is kept in one flat array.
    """

    def __init__(self, file: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        spec = json.load(open(file, encoding="utf-8"))
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        pattern = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
        self.cuttable = pattern == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and kinds == ["NFC", "Replace", "Lowercase"]
        specials = [x["content"] for x in spec.get("added_tokens", [])]
        self.specials = re.compile("|".join(map(re.escape, specials)), re.IGNORECASE) if specials else None
        self.hints = sorted({x[:2].lower() for x in specials})
        suffix, vocabulary = spec["model"].get("end_of_word_suffix"), self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # pieces that end a word
        if suffix:
            self.last[[i for x, i in vocabulary.items() if x.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.places = _Places()
        self.flat, self.first = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _numbers(self, words: pa.Array, joined: bool) -> np.ndarray:
        """The number of each word; the library encodes those that have none yet, in runs if `joined`."""
        coded = words.dictionary_encode()
        own = np.fromiter(map(self.places.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)), np.int64, len(coded.dictionary))
        new, self.places.new = self.places.new, []
        if new:
            ids, sizes = self._look_up(new, joined)
            self.flat = np.concatenate((self.flat, ids))
            self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(sizes)))
        return own[coded.indices.to_numpy()]

    def _look_up(self, words: list[str], joined: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words, how many each has)."""
        if joined:
            runs = [" ".join(words[i : i + RUN]) for i in range(0, len(words), RUN)]
            ids = np.array(list(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False))), np.int32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(words) and ends[-1] == len(ids):
                return ids, np.diff(ends, prepend=0)
        found = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array(list(chain.from_iterable(found)), np.int32), np.array(list(map(len, found)), np.int64)

    def _cut_plain(self, low: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """(words of all texts, how many each has, numbers of texts that aren't plain, whose words are wrong); no text has a NUL."""
        data = np.frombuffer(("\0".join(low) + "\0\0\0").encode(), np.uint8)  # room to look ahead
        kind = _kinds()[data]
        starts = np.concatenate((np.zeros(1, np.int64), np.flatnonzero(data[:-3] == 0) + 1))
        sign = np.flatnonzero((data == 0x97) | (data == 0xB7))
        odd = np.concatenate((np.flatnonzero(kind == _OTHER), sign[data[sign - 1] == 0xC3]))  # C3 97 and C3 B7 are no letters
        start = np.ones(len(data), bool)
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start |= kind == _DIGIT
        quote = np.flatnonzero(start & (data == 39))
        quote = quote[kind[quote + 1] == _LETTER]
        one, two = data[quote + 1], data[quote + 2]
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        size = np.where(np.isin(one, list(b"stmd")), 2, np.where(long, 3, 0))
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        start[quote + size] = True
        word = kind != _SPACE
        start &= word
        first = np.flatnonzero(start[word]).astype(np.int32)
        packed = data[word]
        words = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.append(first, np.int32(len(packed)))), pa.py_buffer(packed))
        counts = np.diff(np.searchsorted(np.flatnonzero(start), np.append(starts, len(data))))
        return words, counts, np.unique(np.searchsorted(starts, odd, side="right") - 1)

    def _cut(self, text: str) -> list[str]:
        if not self.cuttable or (self.specials and self.specials.search(text)):
            return [text]
        return [b.decode() for b in text.encode().split()]  # bytes: ASCII white space alone

    def _words(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the words of all texts, how many each text has)."""
        low = [t.lower() for t in texts]
        rest = [i for i, t in enumerate(low) if not self.cuttable or "\0" in t or any(h in t for h in self.hints)]
        plain = sorted(set(range(len(texts))) - set(rest)) if rest else list(range(len(texts)))
        if plain:
            words, counts, odd = self._cut_plain([low[i] for i in plain])
            if len(odd):
                rest = sorted([*rest, *(plain[i] for i in odd.tolist())])
                plain = sorted(set(plain) - set(rest))
                words, counts, _ = self._cut_plain([low[i] for i in plain]) if plain else (pa.array([], pa.string()), np.zeros(0, np.int64), None)
            numbers = self._numbers(words, True)
            if not rest:
                return numbers, counts
        else:
            numbers, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        cut = [self._cut(texts[i]) for i in rest]
        numbers = np.concatenate((numbers, self._numbers(pa.array(list(chain.from_iterable(cut)), pa.string()), False)))
        of = np.concatenate((np.array(plain, np.int64), np.array(rest, np.int64)))
        sizes = np.concatenate((counts, np.array(list(map(len, cut)), np.int64)))
        order = np.argsort(np.repeat(of, sizes), kind="stable")
        return numbers[order], sizes[np.argsort(of)]

    def encode_flat(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each text has)."""
        if len(self.places) > STORE:
            self._forget()
        words, counts = self._words(texts)
        begin = self.first[words]
        size = self.first[words + 1] - begin
        ends = np.cumsum(size)
        out = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)]
        upto = np.concatenate((np.zeros(1, np.int64), ends))[np.cumsum(np.concatenate((np.zeros(1, np.int64), counts)))]
        return out, np.diff(upto)

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        ids, sizes = self.encode_flat(texts)
        return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] if len(sizes) else []


@lru_cache(maxsize=4)
def word_codec(file: str) -> WordCodec:
    return WordCodec(file)


@lru_cache(maxsize=4)
def rank_encoding(file: str, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(file, "rb"))}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


ROW = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("payload", T.BinaryType())])


def write_token_files(docs: DataFrame, file: str, end_id: int, name: str = "token_ids") -> DataFrame:
    """Encode docs into the format above and write it to the shared folder; the written table's rows."""
    slot = "shard"

    def run(batches):
        codec, first = word_codec(file), 0
        for b in (part for whole in batches for part in slices(whole, 1)):
            ids, sizes = codec.encode_flat([t or "" for t in b.column(1).to_pylist()])
            flat = np.insert(ids.astype(np.int64), np.cumsum(sizes), end_id)
            lengths = (sizes + 1).tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([b.column(2)[0].as_py()], pa.int32()), pa.array([first], pa.int64()), pa.array([b.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([simple8b.encode(flat)], pa.binary())],
                ROW.names,
            )
            first += len(flat)

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"))
    dealt = keyed.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("h")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h")
    return materialize(dealt.select("doc_id", "text", F.spark_partition_id().alias(slot)).mapInArrow(run, ROW), name)


def read_token_files(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), one row for each document, from the files alone."""
    totals = rows.select("shard", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n")).collect()  # a number for each shard
    base, at = {}, 0
    for r in sorted(totals, key=lambda r: r["shard"]):
        base[r["shard"]] = at
        at += r["n"]

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                ids = simple8b.decode(row["payload"]).astype("<u4")
                lengths = np.array(row["lengths"], np.int64)
                begin = np.cumsum(lengths) - lengths
                crc = [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(begin.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(begin + (base[row["shard"]] + row["first"])), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def length_histogram(docs: DataFrame, file: str, pattern: str) -> DataFrame:
    """(n_tokens, n_docs): documents of each encoded length, null texts as length 0."""

    def make():
        encoding = rank_encoding(file, pattern)

        def compute(texts: list) -> list:
            return [[len(encoding.encode_ordinary(t)) if t else 0 for t in texts]]

        return compute

    lengths = with_text_columns(docs.select("text"), [T.StructField("n_tokens", T.LongType())], make, keep=[])
    return materialize(lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")), "lengths")  # read more than once


def suffix_sums(histogram: DataFrame, span: int = 1024) -> DataFrame:
    """The histogram and, for each length as a context limit: docs_at_least, tokens_at_least, docs_up_to,
    truncated_tokens (the corpus's tokens if every document is cut to this length), total_docs and total_tokens.

    Sums run within spans of lengths, and over the spans' totals, so no window holds every length.
    """
    h = histogram.withColumn("span", F.floor(F.col("n_tokens") / span)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    totals = h.groupBy("span").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    above = Window.orderBy(F.col("span").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select("span", (F.sum("d").over(above) - F.col("d")).alias("d_above"), (F.sum("t").over(above) - F.col("t")).alias("t_above"), F.sum("d").over(everything).alias("total_docs"), F.sum("t").over(everything).alias("total_tokens"))
    within = Window.partitionBy("span").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = h.join(totals, "span").withColumn("docs_at_least", F.sum("n_docs").over(within) + F.col("d_above")).withColumn("tokens_at_least", F.sum("tokens").over(within) + F.col("t_above"))
    docs_up_to = F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")
    truncated = F.col("total_tokens") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")
    return s.select("n_tokens", "n_docs", "docs_at_least", "tokens_at_least", docs_up_to.alias("docs_up_to"), truncated.alias("truncated_tokens"), "total_docs", "total_tokens")


def quantile(sums: DataFrame, q: float) -> int | None:
    """The least length that at least a share q of the documents do not exceed; null of an empty table."""
    return sums.where((F.col("docs_up_to") >= F.ceil(q * F.col("total_docs"))) & (F.col("docs_up_to") > 0)).agg(F.min("n_tokens")).first()[0]


def truncated_total(sums: DataFrame, limit: int) -> int:
    """Tokens of the corpus if every document is cut to `limit`, for any limit, between lengths too."""
    s = sums.agg(F.sum(F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs"))).first()[0]
    return s or 0
