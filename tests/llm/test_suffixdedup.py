import hashlib
import random
from collections import Counter

from spalt.llm import suffixdedup
from tests.llm.conftest import LONG

W = suffixdedup.WIDTH


def brute(rows):
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(t[i : i + W] for _, t in data for i in range(len(t) - W + 1))
    out = []
    for d, t in data:
        gone = bytearray(len(t))
        for i in range(len(t) - W + 1):
            if seen[t[i : i + W]] > 1:
                gone[i : i + W] = b"\1" * W
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        out.append((d, len(t), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def check(docs, rows):
    assert sorted(map(tuple, suffixdedup.remove_repeats(docs).collect()), key=repr) == brute(rows)


def test_cover():
    assert {(a - b) % suffixdedup.PERIOD for a in suffixdedup.COVER for b in suffixdedup.COVER} == set(range(suffixdedup.PERIOD))


def test_lengths_about_the_width(documents):
    r = random.Random(7)
    word = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    shared = [word(n) for n in (199, 200, 201, 256, 257, 258, 314, 500, 900)]
    texts = [None, "", "short", "x" * 199, "y" * 200, "z" * 201, "ab" * 300]
    for s in shared:
        for _ in range(3):
            texts.append(word(r.randrange(80)) + s[r.randrange(3) :] + word(r.randrange(80)))
    texts += [texts[-1], texts[-1], texts[10] + texts[12] + texts[20]]
    r.shuffle(texts)
    check(documents(texts), list(enumerate(texts)))


def test_edits_of_copies(documents):
    r = random.Random(8)
    base = "".join(r.choice("abcdef ") for _ in range(3000))
    texts = [base]
    for _ in range(12):
        t = list(base)
        for _ in range(r.randrange(1, 12)):
            t[r.randrange(len(t))] = r.choice("XYZ")
        texts.append("".join(t[r.randrange(60) :]))
    check(documents(texts), list(enumerate(texts)))


def test_groups_long_texts_and_extra_columns(documents, monkeypatch):
    monkeypatch.setattr(suffixdedup, "GROUP_BYTES", 2000)
    r = random.Random(9)
    texts = ["".join(r.choice("abc") for _ in range(r.randrange(1500))) for _ in range(12)]
    texts += [texts[3] + texts[4], None, LONG[:30_000]]
    ids = [*range(13), None, 5]
    docs = documents(texts, ids).selectExpr("*", "1 AS payload", "2 AS group_id")
    check(docs, list(zip(ids, texts, strict=True)))
    kept = {r.doc_id: r.kept for r in suffixdedup.remove_repeats(docs, with_text=True).collect()}
    assert kept[12] == b"" or len(kept[12]) < len(texts[12])
    assert suffixdedup.remove_repeats(docs.limit(0)).count() == 0


def test_query(spark, small):
    from spalt.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(docs, rows)
    got = QUERIES["op5_suffix_dedup"](spark, small)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    everything = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(everything)
