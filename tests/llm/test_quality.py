from collections import Counter

from spalt.llm.quality import BASE, RULES, Features, Rule, cascade_order, judge, keep_good, measure
from tests.compare import assert_same, duck
from tests.llm.conftest import LONG

CLEAN = " ".join(f"word{i} thing{i}" for i in range(60))
CASES = [None, "", " \n\t", CLEAN, CLEAN, "a b c " * 40, CLEAN + " ###" * 40, CLEAN.upper(), "same line\n" * 2 + CLEAN, LONG, "x" * 300_000, "a\x1cb c d"]


def brute(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_features_match_brute_force():
    for t in CASES:
        f = Features(t)
        assert (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words) == brute(t)


def test_cascade_gives_the_verdict_of_all_rules(documents):
    got = {r.doc_id: r for r in judge(documents(CASES), features=["n_words"]).collect()}
    assert len(got) == len(CASES)
    for i, t in enumerate(CASES):
        assert got[i].kept == (not any(r.rejects(Features(t)) for r in RULES)), t
        assert (got[i].rejected_by is None) == got[i].kept
    assert got[3].kept and not got[5].kept and not got[6].kept and not got[7].kept


def test_order_is_rejections_per_cost_of_what_is_left():
    rules = [Rule(n, lambda f: False) for n in ("a", "b", "c", "d")]
    # b rejects 40 texts cheaply; of a's 50 it has had 40 already, of c's 30 none
    left = {0b0011: 40, 0b0001: 10, 0b0100: 30, 0: 20}
    assert [r.name for r in cascade_order(rules, (left, [1.0, 0.125, 1.0, 1.0]))] == ["b", "c", "a", "d"]
    assert [r.name for r in cascade_order(rules, ({}, [1.0, 1.0, 0.5, 1.0]))] == ["c", "a", "b", "d"]
    assert set(BASE) <= {r.name for r in RULES}


def test_measures_are_of_all_files(spark, documents):
    docs = documents(CASES)
    masks, seconds = measure(docs)
    assert sum(masks.values()) == len(CASES) and len(seconds) == len(RULES) and all(s > 0 for s in seconds)
    for mask in masks:
        assert any(sum(r.rejects(Features(t)) << i for i, r in enumerate(RULES)) == mask for t in CASES)
    assert measure(docs.limit(0)) == ({}, [0.0] * len(RULES))
    some = sum(measure(documents([CLEAN] * 2000), sample_rows=200)[0].values())
    assert 100 < some < 300


def test_upper_case_is_that_of_the_sql(spark, documents, folder):
    texts = ["Ⅷ Ⓐ ª º ß Ǆ ǅ ñ É 日本 x" + " a b" * 30, "ÀÉÎ Ω ж Ж" * 30, "ⅧⅧⅧ ab" * 40, "ªºªº AB" * 40]
    d = folder(documents=documents(texts))
    from spalt.llm.queries import ORACLE, QUERIES

    con = __import__("duckdb").connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    assert_same(QUERIES["op8_quality_rules"](spark, d), con, ORACLE["op8_quality_rules"])


def test_filter_keeps_columns_and_takes_empty_tables(spark, documents):
    docs = documents(CASES).selectExpr("*", "1 AS kept", "2 AS rejected_by")
    out = keep_good(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == {3, 4, 8}
    assert keep_good(docs.limit(0)).count() == 0
    assert judge(docs).columns == [*docs.columns, "kept_", "rejected_by_"]


def test_query_matches_sql(spark, small):
    from spalt.llm.queries import ORACLE, QUERIES

    assert_same(QUERIES["op8_quality_rules"](spark, small), duck(small), ORACLE["op8_quality_rules"])
