"""SentencePiece encoding and decoding with byte offsets into the source (operator 3).

The normaliser walks the source by the model's compiled character map: at each place the longest key that is a prefix
of what follows gives the normalised characters, and every normalised byte records the source byte where its key
began. Pieces are runs of normalised bytes, so this alignment gives each piece its span of source bytes, as the
sentencepiece library reports them.

Ids are those of the library for the whole text. No piece of a model with escaped spaces may hold a space mark after
another character for the text to be cut before its spaces and each cut be encoded once; the codec looks at the
vocabulary and hands over whole texts where this doesn't hold, and texts that hold a space mark themselves. Decoding is the library's, of all ids of the document.

Defined results: a null text is like an empty one: no ids; other columns stay, and a new column whose name is taken gets a
_ behind it; repeated rows are encoded one by one, an empty table gives an empty result, and memory is that of one batch of
whole texts and a bounded store of words.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Sequence
from copy import copy
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spalt.llm.common import added, with_text_columns

MARK = "▁"
#: Cuts whose ids a task remembers; beyond it, it starts anew.
STORE = 150_000


class CharMap:
    """A compiled character map: a double-array trie of UTF-8 keys, whose values are offsets into NUL-ended strings."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.strings = blob[4 + size :]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def longest(self, source: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, length of the key) of the longest key that starts at `at`."""
        if not self.units:
            return None
        found, node = None, self._offset(self.units[0])
        for i in range(at, len(source)):
            node ^= source[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & ((1 << 31) | 0xFF) != source[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                value = self.units[node] & 0x7FFFFFFF
                found = (self.strings[value : self.strings.index(b"\0", value)], i + 1 - at)
        return found


class Normalizer:
    """Source bytes to normalised bytes and, for each of these and for the end, the source byte it comes from."""

    def __init__(self, spec):
        self.map = CharMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.prefix, self.trim = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.space = MARK.encode() if spec.escape_whitespaces else b" "

    def __call__(self, source: bytes) -> tuple[bytes, np.ndarray]:
        if self.map is None and not self.trim and self.space != b" ":
            return self._plain(source)
        out, align, at = bytearray(), [], 0
        before_is_space = self.trim
        pieces = []
        while at < len(source):
            hit = self.map.longest(source, at) if self.map else None
            if hit is None:
                length = next((n for lead, n in ((0xF0, 4), (0xE0, 3), (0xC0, 2)) if source[at] >= lead), 1)
                hit = (source[at : at + length], length)
            pieces.append((hit[0], at))
            at += hit[1]
        end = len(source)
        if self.trim:
            while pieces and not pieces[-1][0].strip(b" "):
                end = pieces.pop()[1]
            first = next((i for i, (p, _) in enumerate(pieces) if p.strip(b" ")), len(pieces))
            pieces = pieces[first:]
        if self.prefix and pieces:
            out += self.space
            align += [pieces[0][1]] * len(self.space)
        for piece, begin in pieces:
            for c in piece.decode():
                if c == " ":
                    if before_is_space and self.trim:
                        continue
                    add = self.space
                else:
                    add = c.encode()
                before_is_space = c == " "
                out += add
                align += [begin] * len(add)
        return bytes(out), np.array([*align, end], np.int64)

    def _plain(self, source: bytes) -> tuple[bytes, np.ndarray]:
        """Without a map: every character stands for itself, a space for the mark."""
        raw = np.frombuffer(source, np.uint8)
        at = np.arange(len(raw))
        begin = np.maximum.accumulate(np.where((raw & 0xC0) == 0x80, 0, at)) if len(raw) else at
        align = np.repeat(begin, np.where(raw == 32, len(self.space), 1))
        if self.prefix and len(raw):
            align = np.concatenate((np.zeros(len(self.space), np.int64), align))
        return (self.space if self.prefix and source else b"") + source.replace(b" ", self.space), np.append(align, len(raw))


class Codec:
    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        proto = pb.ModelProto()
        proto.ParseFromString(open(model_file, "rb").read())
        self.normalizer = Normalizer(proto.normalizer_spec)
        kinds = pb.ModelProto.SentencePiece
        self.unknown = self.model.unk_id()
        self.lengths = np.array([1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in proto.pieces], np.int64)
        spec = proto.normalizer_spec
        cuttable = spec.add_dummy_prefix and not spec.remove_extra_whitespaces and not spec.precompiled_charsmap and spec.escape_whitespaces
        self.cuttable = cuttable and not any(MARK in p.piece.lstrip(MARK) for p in proto.pieces) and not any(p.type == kinds.USER_DEFINED for p in proto.pieces)
        self.store: dict[str, tuple[int, ...]] = {}
        self.bare = (self.model.piece_to_id(MARK),)

    def _cuts(self, text: str) -> list[str]:
        """The text before each run of spaces; a cut lacks the space that the model's prefix gives back."""
        if not text:
            return []
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [x[1:] for x in re.findall(r" +[^ ]*", " " + text)]
        return text.split(" ")

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        if not self.cuttable:
            return self.model.encode(list(texts), num_threads=1)
        whole = [i for i, t in enumerate(texts) if MARK in t]  # a mark of the source can join the next cut's
        if whole:
            out: list = [None] * len(texts)
            rest = [i for i, t in enumerate(texts) if MARK not in t]
            for places, ids in ((whole, self.model.encode([texts[i] for i in whole], num_threads=1)), (rest, self.encode([texts[i] for i in rest]))):
                for i, x in zip(places, ids, strict=True):
                    out[i] = x
            return out
        cuts = [self._cuts(t) for t in texts]
        if len(self.store) > STORE:
            self.store.clear()
        store = self.store
        new = [x for x in set(chain.from_iterable(cuts)) if x not in store]
        store.update(zip(new, map(tuple, self.model.encode(new, num_threads=1)), strict=True))
        store[""] = self.bare  # a cut of one bare space: the prefix alone
        return [list(chain.from_iterable(map(store.__getitem__, c))) for c in cuts]

    def spans(self, text: str, ids: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        """First source byte of each piece, and the byte after its last."""
        normal, align = self.normalizer(text.encode())
        if self.unknown in ids and self.lengths[self.unknown] != 1:
            sizes = np.array([len(p.piece.encode()) for p in self.model.encode(text, return_type="proto").pieces], np.int64)
        else:
            sizes = self.lengths[np.asarray(ids, np.int64)] if len(ids) else np.zeros(0, np.int64)
        ends = np.cumsum(sizes)
        if len(ids) and ends[-1] != len(normal):
            raise ValueError("pieces don't cover the normalised text")
        return align[ends - sizes], align[ends]


_loaded = lru_cache(maxsize=1)(Codec)


def codec(model_file: str) -> Codec:
    """The model's codec, loaded once in a worker, with a store of its own."""
    c = copy(_loaded(model_file))
    c.store = {}
    return c


def sha256(data: str) -> str:
    return hashlib.sha256(data.encode()).hexdigest()


#: Columns that encode() can give: type, and value from the codec, the text, its ids, its spans and its decoded text.
COLUMNS = {
    "ids": (T.ArrayType(T.IntegerType()), lambda c, t, ids, spans, back: ids),
    "begins": (T.ArrayType(T.IntegerType()), lambda c, t, ids, spans, back: spans()[0]),
    "ends": (T.ArrayType(T.IntegerType()), lambda c, t, ids, spans, back: spans()[1]),
    "decoded": (T.StringType(), lambda c, t, ids, spans, back: back),
    "n_tokens": (T.LongType(), lambda c, t, ids, spans, back: len(ids)),
    "ids_sha256": (T.StringType(), lambda c, t, ids, spans, back: sha256(",".join(map(str, ids)))),
    "decoded_sha256": (T.StringType(), lambda c, t, ids, spans, back: sha256(back)),
    "spans_crc32": (T.LongType(), lambda c, t, ids, spans, back: zlib.crc32(np.stack(spans()).astype("<i4").tobytes())),
}


def encode(docs: DataFrame, model_file: str, columns: Sequence[str] = ("ids", "begins", "ends"), names: dict[str, str] | None = None) -> DataFrame:
    """docs and the columns asked for, of COLUMNS; names renames them."""
    columns, given = list(columns), added(docs, columns, names)
    decodes = any(c.startswith("decoded") for c in columns)

    def make():
        c = codec(model_file)

        def compute(texts: list) -> list:
            texts = [t or "" for t in texts]
            ids = c.encode(texts)
            back = c.model.decode(ids) if decodes and ids else [""] * len(ids)
            out: list[list] = [[] for _ in columns]
            for t, i, b in zip(texts, ids, back, strict=True):
                spans = lru_cache(maxsize=1)(lambda t=t, i=i: c.spans(t, i))
                for column, name in zip(out, columns, strict=True):
                    column.append(COLUMNS[name][1](c, t, i, spans, b))
            return out

        return compute

    return with_text_columns(docs, [T.StructField(n, COLUMNS[x][0]) for n, x in zip(given, columns, strict=True)], make)


def decode(rows: DataFrame, model_file: str, ids: str = "ids") -> DataFrame:
    """rows and `decoded`, the library's text of the ids; null ids decode to an empty text."""
    import pyarrow as pa

    def run(batches):
        model = codec(model_file).model
        for b in batches:
            back = model.decode([x or [] for x in b.column(ids).to_pylist()]) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(back, pa.string())], [*b.schema.names, "decoded"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())]))
