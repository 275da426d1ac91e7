"""Removal of repeated byte strings through a difference-cover sample and blocks of suffixes (operator 5).

A byte goes if a string of `WIDTH` bytes of its document that covers it also starts anywhere else. Of a suffix order,
only ties of WIDTH bytes matter here, so suffixes are put in blocks, and in order within a block, by hashes of their
first bytes: equal strings are neighbours as they are in a suffix array, and no text travels with a suffix.

The sample: positions whose remainder modulo PERIOD is in COVER. COVER is a difference cover: for any two positions
there is a shift under PERIOD that brings both into the sample. It settles, in four rounds of blocks,
1. which sample suffixes tie over WIDTH - PERIOD + 1 bytes. A string of WIDTH bytes that occurs twice has a tied sample
   suffix within its first PERIOD places, so all other suffixes are done with;
2. long ties: a sample suffix that ties over WIDTH + PERIOD bytes decides the PERIOD + 1 suffixes from its place on, and
   these need no order of their own;
3. the suffixes that are still open, at the edges of repeats, have tied sample suffixes too: which of these the open
   ones stand on, in any document;
4. only suffixes that stand on such a sample suffix, open or decided, can tie with an open one: their WIDTH bytes are
   compared in blocks.

Memory: documents are packed into groups of about GROUP_BYTES (a longer document is a group of its own) in a table
bucketed by group, so that answers meet their text without shuffling it. A group sends each distinct value once to its
block, and the answer is a bit for each value in the order sent. A block is about BLOCK_VALUES values; a value that a
third of the rows hold has one entry for each group in its block, not one for each row. Rounds 1 and 3 compare 40 bits
beside the block's number, where a false tie only costs work; rounds 2 and 4 decide, on 128 bits of two hashes: no bytes are
compared, and among the 10^14 suffixes of 100 TB a false tie has a chance of 10^-11.

A group's row is small where there are many more blocks than values in a group: from some TB on, rows of a few values cost
more than their values. A document is one group whatever its length and takes some 60 bytes of memory a byte. Tables that
are written on the way are deleted once the result is written.

Defined results: null and empty texts have no bytes; texts under WIDTH bytes keep all; repeated rows are texts like any
other and so are removed wholly from WIDTH bytes on, in all copies; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import secrets
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spalt.llm.common import arrow_batches, forget, materialize, table_folder, written

WIDTH = 200
#: A perfect difference set, every remainder modulo PERIOD is a difference of two of them.
PERIOD, COVER = 57, (0, 1, 3, 13, 32, 36, 43, 52)
GROUP_BYTES = 3_000_000
BLOCK_VALUES = 2_000_000
GROUPS = "group_id long, doc_ids array<long>, lengths array<long>, payload binary"
SENT = "block int, group_id long, data binary, twice binary"
ANSWERS = "group_id long, round int, block int, bits binary"


def pack(docs: DataFrame) -> DataFrame:
    """Groups of whole documents: (group_id, doc_ids, lengths, payload)."""

    def flush(ids: list, texts: list) -> pa.RecordBatch:
        columns = [[secrets.randbits(63)], [ids], [[len(t) for t in texts]], [b"".join(texts)]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["group_id", "doc_ids", "lengths", "payload"])

    def run(batches):
        ids, texts, size = [], [], 0
        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = (t or "").encode()
                if ids and size + len(t) > GROUP_BYTES:
                    yield flush(ids, texts)
                    ids, texts, size = [], [], 0
                ids.append(d)
                texts.append(t)
                size += len(t)
        if ids:
            yield flush(ids, texts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, GROUPS)


def bucketed(groups: DataFrame, n: int) -> tuple[DataFrame, str]:
    """Written once to the shared folder in n buckets by group_id: later joins on it don't move the texts. Also the table's name."""
    spark, name = groups.sparkSession, f"spalt_groups_{uuid.uuid4().hex}"
    options = {"path": table_folder(spark, name), "compression": "zstd", "parquet.block.size": str(32 << 20), "parquet.enable.dictionary": "false"}
    with arrow_batches(spark):
        groups.write.bucketBy(n, "group_id").options(**options).format("parquet").saveAsTable(name)
    return spark.table(name), name


@lru_cache(maxsize=1)
def _tables(size: int) -> tuple[np.ndarray, ...]:
    """For two rolling hashes: values of bytes, powers of an odd base and of its inverse modulo 2^64."""
    draw = np.random.Generator(np.random.PCG64(20))
    values = draw.integers(0, 2**64, (2, 256), dtype=np.uint64)
    bases = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]
    out = [values]
    for base in bases:
        for b in (base, pow(base, -1, 2**64)):
            steps = np.full(size + 1, b, np.uint64)
            steps[0] = 1
            out.append(np.cumprod(steps))
    return tuple(out)


class Group:
    """One group's bytes, and the suffixes that each round is about."""

    def __init__(self, payload: bytes, lengths: list[int], blocks: int):
        self.bytes = np.frombuffer(payload, np.uint8)
        n = len(self.bytes)
        self.blocks = blocks
        size = 1 << max(22, (n + 1).bit_length())
        self.tables = _tables(size)
        ends = np.cumsum(np.array(lengths, np.int64))
        self.starts, self.ends = ends - lengths, ends
        self.end_of = np.repeat(ends, lengths)  # the end of the document that a byte is in
        self.sums: dict[int, np.ndarray] = {}

    def hash(self, which: int, at: np.ndarray, width: int) -> np.ndarray:
        """Mixed 64-bit hashes of the strings of `width` bytes that start at `at`."""
        if which not in self.sums:
            power = self.tables[1 + 2 * which]
            self.sums[which] = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.tables[0][which][self.bytes] * power[: len(self.bytes)])))
        s = self.sums[which]
        h = (s[at + width] - s[at]) * self.tables[2 + 2 * which][at]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ h >> np.uint64(32)

    def keys(self, at: np.ndarray, width: int, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (block, value, more) in order, and for each suffix the number of its own."""
        h = self.hash(0, at, width)
        block = ((h >> np.uint64(40)) % np.uint64(self.blocks)).astype(np.int64)
        if not wide:
            key, own = np.unique((block.astype(np.uint64) << np.uint64(40)) | (h & np.uint64((1 << 40) - 1)), return_inverse=True)
            return (key >> np.uint64(40)).astype(np.int64), key & np.uint64((1 << 40) - 1), np.zeros(len(key), np.uint64), own
        more = self.hash(1, at, width)
        order = np.lexsort((more, h, block))
        b, v, m = block[order], h[order], more[order]
        new = np.ones(len(at), bool)
        new[1:] = (b[1:] != b[:-1]) | (v[1:] != v[:-1]) | (m[1:] != m[:-1])
        own = np.empty(len(at), np.int64)
        own[order] = np.cumsum(new) - 1
        return b[new], v[new], m[new], own

    def sample(self) -> np.ndarray:
        at = (np.arange(0, len(self.bytes), PERIOD)[:, None] + np.array(COVER)).reshape(-1)
        at = at[at < len(self.bytes)]
        return at[at + WIDTH - PERIOD + 1 <= self.end_of[at]]

    def marked(self, at: np.ndarray, before: int, after: int) -> np.ndarray:
        """Flags of the places from at - before to at + after."""
        n = len(self.bytes)
        d = np.bincount(np.maximum(at - before, 0), minlength=n + 1)[: n + 1] - np.bincount(np.minimum(at + after + 1, n), minlength=n + 1)[: n + 1]
        return np.cumsum(d[:n]) > 0

    def suffixes(self, number: int, answers: dict[int, dict[int, bytes]]) -> tuple[np.ndarray, int, bool]:
        """(places, width, wide) of a round, from the answers of those before."""
        if number == 1:
            return self.sample(), WIDTH - PERIOD + 1, False
        if number == 2:
            tied = self.tied(1, answers)
            return tied[tied + WIDTH + PERIOD <= self.end_of[tied]], WIDTH + PERIOD, True
        if number == 3:
            return self.tied(1, answers), WIDTH - PERIOD + 1, False
        at = np.flatnonzero(self.marked(self.tied(3, answers), PERIOD - 1, 0))
        return at[at + WIDTH <= self.end_of[at]], WIDTH, True

    def open_samples(self, at: np.ndarray, answers: dict[int, dict[int, bytes]]) -> np.ndarray:
        """Flags of tied sample suffixes that a suffix stands on which long ties have not decided."""
        places = np.flatnonzero(self.marked(at, PERIOD - 1, 0) & ~self.marked(self.tied(2, answers), 0, PERIOD))
        places = places[places + WIDTH <= self.end_of[places]]
        return self.marked(places, 0, PERIOD - 1)[at]

    def tied(self, number: int, answers: dict[int, dict[int, bytes]]) -> np.ndarray:
        """Places of the round whose values were found again."""
        at, width, wide = self.suffixes(number, answers)
        block, _, _, own = self.keys(at, width, wide)
        return at[unpack(block, answers.get(number, {}))[own]]

    def repeated(self, answers: dict[int, dict[int, bytes]]) -> np.ndarray:
        """Flags of the bytes to remove."""
        return self.marked(self.tied(2, answers), 0, PERIOD + WIDTH - 1) | self.marked(self.tied(4, answers), 0, WIDTH - 1)


def unpack(block: np.ndarray, bits: dict[int, bytes]) -> np.ndarray:
    """Answers to values in the order of keys()."""
    out = np.zeros(len(block), bool)
    if not len(block):
        return out
    here, first = np.unique(block, return_index=True)
    for b, i, j in zip(here.tolist(), first.tolist(), [*first.tolist()[1:], len(block)], strict=True):
        if b in bits:
            out[i:j] = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=j - i).astype(bool)
    return out


def _answers(row: dict) -> dict[int, dict[int, bytes]]:
    out: dict[int, dict[int, bytes]] = {}
    for a in row.get("answers") or ():
        out.setdefault(a["round"], {})[a["block"]] = a["bits"]
    return out


def _send(number: int, blocks: int):
    """Each group's distinct values of a round, a row for each block."""
    schema = pa.schema([("block", pa.int32()), ("group_id", pa.int64()), ("data", pa.binary()), ("twice", pa.binary())])

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                g = Group(row["payload"], row["lengths"], blocks)
                answers = _answers(row)
                at, width, wide = g.suffixes(number, answers)
                if not len(at):
                    continue
                block, value, more, own = g.keys(at, width, wide)
                twice = np.bincount(own, g.open_samples(at, answers) if number == 3 else None, len(block)) > (number != 3)
                here, first = np.unique(block, return_index=True)
                rows = []
                for k, x, y in zip(here.tolist(), first.tolist(), [*first.tolist()[1:], len(block)], strict=True):
                    data = value[x:y].astype("<u8").tobytes() + more[x:y].astype("<u8").tobytes() if wide else value[x:y].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
                    rows.append((k, row["group_id"], data, np.packbits(twice[x:y]).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _settle(number: int):
    """Order one block's values; the bit of a value says whether it is there again, in round 3 whether an open suffix stands on it."""
    wide = number in (2, 4)
    schema = pa.schema([("group_id", pa.int64()), ("round", pa.int32()), ("block", pa.int32()), ("bits", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        values, more, twice = [], [], []
        for data, flags in zip(table["data"].to_pylist(), table["twice"].to_pylist(), strict=True):
            n = len(data) // (16 if wide else 5)
            if wide:
                values.append(np.frombuffer(data, "<u8", n))
                more.append(np.frombuffer(data, "<u8", n, 8 * n))
            else:
                v = np.zeros((n, 8), np.uint8)
                v[:, :5] = np.frombuffer(data, np.uint8).reshape(n, 5)
                values.append(v.view("<u8").reshape(-1))
            twice.append(np.unpackbits(np.frombuffer(flags, np.uint8), count=n).astype(bool))
        sizes = [len(x) for x in values]
        v, hit = np.concatenate(values), np.concatenate(twice)
        if wide:
            m = np.concatenate(more)
            order = np.lexsort((m, v))
            same = (v[order][1:] == v[order][:-1]) & (m[order][1:] == m[order][:-1])
        else:
            order = np.argsort(v)
            s = v[order]
            same = s[1:] == s[:-1]
        if number == 3:
            heads = np.flatnonzero(np.concatenate((np.ones(1, bool), ~same)))
            hit[order] = np.repeat(np.logical_or.reduceat(hit[order], heads), np.diff(np.append(heads, len(order))))
            same = np.zeros(len(same), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        bits = [np.packbits(x).tobytes() for x in np.split(hit, np.cumsum(sizes)[:-1])]
        n = table.num_rows
        return pa.Table.from_arrays([table["group_id"], pa.array([number] * n, pa.int32()), table["block"], pa.array(bits, pa.binary())], schema=schema)

    return run


def _with_answers(groups: DataFrame, answers: DataFrame | None) -> DataFrame:
    if answers is None:
        return groups.select("group_id", "doc_ids", "lengths", "payload")
    listed = answers.groupBy("group_id").agg(F.collect_list(F.struct("round", "block", "bits")).alias("answers"))
    return groups.join(listed.hint("shuffle_hash"), "group_id", "left")


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), and `kept`, the remaining bytes, if with_text."""
    spark = docs.sparkSession
    n_buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    start = written()
    groups, name = bucketed(pack(docs), n_buckets)
    total = groups.select(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    blocks = max(n_buckets, -(-total * len(COVER) // (PERIOD * BLOCK_VALUES)))
    answers = None
    for number in (1, 2, 3, 4):
        sent = _with_answers(groups, answers).mapInArrow(_send(number, blocks), SENT)
        new = materialize(sent.groupBy("block").applyInArrow(_settle(number), ANSWERS), f"answers{number}")
        answers = new if answers is None else answers.unionByName(new)

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                g = Group(row["payload"], row["lengths"], blocks)
                gone = g.repeated(_answers(row))
                out: list[list] = [[] for _ in range(4 + with_text)]
                for x, y in zip(g.starts.tolist(), g.ends.tolist(), strict=True):
                    flags = gone[x:y]
                    kept = g.bytes[x:y][~flags].tobytes()
                    runs = int(flags[:1].sum()) + int((flags[1:] & ~flags[:-1]).sum())
                    for column, value in zip(out, [y - x, int(flags.sum()), runs, hashlib.sha256(kept).hexdigest(), kept], strict=False):
                        column.append(value)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                columns = [pa.array(row["doc_ids"], pa.int64()), *(pa.array(c, k) for c, k in zip(out, kinds, strict=False))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(columns)])

    out = _with_answers(groups, answers).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
    out = materialize(out, "kept")
    forget(spark, start)
    spark.sql(f"DROP TABLE {name}")
    return out
