import hashlib
import random
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import sentencepiece

from spalt.llm import pieces
from tests.llm.conftest import LONG

FILE = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  ", " a", "a ", "a  b ", "a\n\nb", "▁x ▁", "日本語 テキスト🎉 🎉🎉", "<s> hi</s> <unk>", "tab\tand\r\nend", "\x00z", "é x́", "don't STOP 12345 ...", "x" * 5000, "   \n   ", LONG[:50_000]]


def test_ids_and_spans_are_the_library_s():
    model, codec = sentencepiece.SentencePieceProcessor(model_file=FILE), pieces.codec(FILE)
    assert codec.cuttable and codec.encode(TEXTS) == model.encode(TEXTS)
    codec.cuttable = False
    assert codec.encode(TEXTS) == model.encode(TEXTS)
    codec.cuttable = True
    for t in TEXTS:
        b, e = codec.spans(t, model.encode(t))
        assert list(zip(b.tolist(), e.tolist(), strict=True)) == [(p.begin, p.end) for p in model.encode(t, return_type="proto").pieces], t


def test_space_marks_in_the_source():
    r = random.Random(6)
    texts = ["a ▁ ▁ ▁b", "▁ ▁", "no mark", "▁", *("".join(r.choices("ab ▁", k=r.randrange(1, 12))) for _ in range(3000))]
    model, codec = sentencepiece.SentencePieceProcessor(model_file=FILE), pieces.codec(FILE)
    assert codec.cuttable and codec.encode(texts) == model.encode(texts)


def trie(rules):
    """A double array of the rules: each node's children at its offset, an offset for each node that no other uses."""
    units, strings = {0: None}, b""
    nodes = [(0, b"")]
    free = 256
    while nodes:
        at, prefix = nodes.pop()
        after = {k[len(prefix)] for k in rules if k.startswith(prefix) and len(k) > len(prefix)}
        offset, free = free, free + 256
        base = at ^ offset
        leaf = prefix in rules
        label = prefix[-1] if prefix else 0
        step = offset if offset < 1 << 21 else None
        units[at] = step << 10 | (256 if leaf else 0) | label
        if leaf:
            units[base] = 1 << 31 | len(strings)
            strings += rules[prefix] + b"\0"
        for c in after:
            nodes.append((base ^ c, prefix + bytes([c])))
    array = [units.get(i, 0) for i in range(max(units) + 1)]
    blob = b"".join(u.to_bytes(4, "little") for u in array)
    return len(blob).to_bytes(4, "little") + blob + strings


def test_the_longest_key_wins_and_spans_follow_the_source():
    rules = {b"a": b"1", b"ab": b"22", "é".encode(): b"e", "…".encode(): b"...", b"\t": b" ", b"q": b""}
    spec = SimpleNamespace(precompiled_charsmap=trie(rules), add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=False)
    out, align = pieces.Normalizer(spec)("  ab a\t é…qz ".encode())
    assert out == b" 22 1 e...z"
    source = "  ab a\t é…qz ".encode()
    assert align.tolist() == [2, 2, 2, 4, 5, 6, 8, 10, 10, 10, 14, 15]
    assert source[align[7] : align[10]].decode() == "…q"
    spec.remove_extra_whitespaces = False
    assert pieces.Normalizer(spec)(b"a  b")[0] == b" 1  b"


def test_columns_round_trip(documents):
    docs = documents([None, *TEXTS, TEXTS[5]]).selectExpr("*", "1 AS ids")
    out = pieces.encode(docs, FILE, ["ids", "begins", "ends", "decoded"], {"ids": "piece_ids"}).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=FILE)
    for r in out:
        assert r.piece_ids == model.encode(r.text or "") and r.decoded == model.decode(r.piece_ids) and r.ids == 1
        assert len(r.begins) == len(r.ends) == len(r.piece_ids)
    again = pieces.decode(pieces.encode(docs.select("doc_id", "text"), FILE, ["ids"]), FILE)
    assert {r.doc_id: r.decoded for r in again.collect()} == {r.doc_id: r.decoded for r in out}
    assert pieces.encode(docs.limit(0), FILE, ["n_tokens"]).count() == 0


def test_query(spark, small):
    from spalt.llm.queries import QUERIES

    model = sentencepiece.SentencePieceProcessor(model_file=FILE)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.spans_crc32) for r in QUERIES["op3_sentencepiece"](spark, small).collect()}
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        ids = model.encode(r.text)
        found = [(p.begin, p.end) for p in model.encode(r.text, return_type="proto").pieces]
        spans = np.array(found, "<i4").reshape(-1, 2).T
        assert got.pop(r.doc_id) == (len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids)), zlib.crc32(np.ascontiguousarray(spans).tobytes()))
    assert not got
