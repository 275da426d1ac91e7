import random

from spalt.llm.linededup import dedup_lines
from tests.compare import assert_same, duck


def brute(rows):
    """(doc_id, text) in any order -> (text, n_lines, n_removed) of each."""
    where: dict = {}
    key = lambda d: (d is not None, d or 0)
    for d, t in rows:
        lines = t.split("\n") if t is not None else []
        for p in range(len(lines) - 2):
            if any(x.strip(" ") for x in lines[p : p + 3]):
                where.setdefault(tuple(lines[p : p + 3]), set()).add((key(d), p))
    gone: dict = {}
    for places in where.values():
        for k, p in sorted(places)[1:]:
            gone.setdefault(k, set()).update((p, p + 1, p + 2))
    out = []
    for d, t in rows:
        lines = t.split("\n") if t is not None else []
        cut = gone.get(key(d), set())
        out.append((d, "\n".join(x for i, x in enumerate(lines) if i not in cut) if t is not None else None, len(lines), len(cut)))
    return out


def check(documents, texts, ids=None):
    rows = list(zip(range(len(texts)) if ids is None else ids, texts, strict=True))
    got = [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in dedup_lines(documents(texts, ids)).select("doc_id", "text", "n_lines", "n_removed").collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)


def test_edges(documents):
    check(documents, [None, "", "a", "a\nb", "a\nb\nc", "x\na\nb\nc\ny", "a\nb\nc", "\n\n\n", "\n\n\n", "z\nz\nz\nz\nz", "a\r\nb\r\nc", "a\nb\nc\nd\ne\nf", "q\nb\nc\nd\ne\nf"])


def test_null_and_repeated_ids(documents):
    check(documents, ["a\nb\nc", "a\nb\nc", "a\nb\nc", "w\na\nb\nc"], [None, 3, 3, 1])


def test_rows_without_an_id_of_their_own_lose_their_own_lines(documents):
    texts = ["a\nb\nc", "k\nl\nm\na\nb\nc", "p\nq\nr\ns\nt\nu", "p\nq\nr\ns\nt\nu", "v\nw\nx"]
    for i in (None, 7):
        rows = dedup_lines(documents(texts, [i] * 5)).collect()
        # of the two that hold a, b, c the first by its hash stays; of the equal ones, either
        assert sum(r.n_removed for r in rows) == 9 and sum("a\nb\nc" in r.text for r in rows) == 1
        assert sorted(r.text for r in rows if r.text[:1] in ("p", "v")) == [texts[2], texts[4]]


def test_random_lines(documents):
    r = random.Random(3)
    check(documents, ["\n".join(r.choice("abc") for _ in range(r.randrange(30))) for _ in range(60)])


def test_long_text_and_extra_columns(documents):
    long = "\n".join(f"line {i}" for i in range(30_000))
    docs = documents([long, long + "\nmore"]).selectExpr("*", "1 AS n_lines", "2 AS removed", "3 AS lines")
    out = dedup_lines(docs, {"n_lines": "total", "n_removed": "cut"})
    assert [(r.doc_id, r.total, r.cut, r.n_lines) for r in out.orderBy("doc_id").collect()] == [(0, 30_000, 0, 1), (1, 30_001, 30_000, 1)]
    assert dedup_lines(docs).columns == [*docs.columns, "n_lines_", "n_removed"]
    assert dedup_lines(docs.limit(0)).count() == 0


def test_query_matches_sql_and_stays_native(spark, small):
    from spalt.llm.queries import ORACLE, QUERIES

    df = QUERIES["op2_line_dedup"](spark, small)
    assert_same(df, duck(small), ORACLE["op2_line_dedup"])
    assert "Python" not in df._jdf.queryExecution().toString()
