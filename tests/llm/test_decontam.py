import random

import numpy as np

from spalt.llm import decontam
from tests.llm.conftest import LONG

R = random.Random(2)
VOCABULARY = ["the", "of", "and"] * 60 + [f"w{i}x" for i in range(3000)]
WORDS = lambda n: [R.choice(VOCABULARY) for _ in range(n)]


def slow_align(item, passage):
    best, h = 0, [[0] * (len(passage) + 1) for _ in range(len(item) + 1)]
    for i in range(1, len(item) + 1):
        for j in range(1, len(passage) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if item[i - 1] == passage[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_alignment_matches_brute_force():
    r = np.random.default_rng(1)
    for _ in range(60):
        a, b = r.integers(0, 4, r.integers(1, 12)), r.integers(0, 4, r.integers(1, 25))
        score, begin, end = decontam.align(a, b)
        assert score == slow_align(a.tolist(), b.tolist()) == slow_align(a.tolist(), b[begin:end].tolist())


def edited(words, share):
    out = []
    for w in words:
        x = R.random()
        if x < share / 3:
            continue
        out += [f"new{R.randrange(99)}"] if x < 2 * share / 3 else [w, "extra"] if x < share else [w]
    return out


def corpus():
    items = [" ".join(WORDS(n)) for n in (8, 12, 20, 30, 50, 50)] + [None, "", "two words", items_tail()]
    texts = [" ".join(WORDS(R.randrange(5, 300))) for _ in range(60)] + [None, "", "the", LONG]
    for i in range(6):
        words = items[i].split()
        for share in (0, 0.1, 0.2):
            texts.append(" ".join([*WORDS(90), *(edited(words, share) if len(words) > 15 else words), *WORDS(70)]))
        texts.append(items[i].upper().replace(" ", ",  "))
    texts += [texts[-1], " ".join([items[4], *WORDS(400), items[4]])]
    return items, texts


def items_tail():
    return " ".join(["the of and"] * 6)


def test_planted_passages_and_clean_texts(spark, documents):
    items, texts = corpus()
    benchmark = spark.createDataFrame([(100 + i, t) for i, t in enumerate(items)], "item_id long, text string")
    docs = documents(texts).selectExpr("*", "1 AS item_id", "2 AS m")
    want = set()
    for d, t in enumerate(texts):
        for i, x in enumerate(items):
            a, b = decontam.words(x), decontam.words(t)
            if len(a) >= 3 and len(b) < 5000 and slow_align(a, b) >= decontam.THRESHOLD * 2 * len(a):
                want.add((d, 100 + i))
    rows = decontam.contaminated(docs, benchmark).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert len(rows) == len(got) and got == want and len(want) >= 26
    for r in rows:
        own, passage = decontam.words(items[r.item_id - 100]), decontam.words(texts[r.doc_id])[r.begin_word : r.end_word]
        assert np.isclose(r.similarity, slow_align(own, passage) / (2 * len(own)))
    clean = decontam.keep_clean(docs, benchmark)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {d for d, _ in want}


def test_filters_of_any_size_give_the_same(spark, documents, monkeypatch):
    items, texts = corpus()
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    one = sorted((r.doc_id, r.item_id, r.similarity) for r in decontam.contaminated(documents(texts), benchmark).collect())
    monkeypatch.setattr(decontam, "FILTER_BITS", 64)  # lets all pass
    assert sorted((r.doc_id, r.item_id, r.similarity) for r in decontam.contaminated(documents(texts), benchmark).collect()) == one


def test_windows_and_memory():
    r = np.random.default_rng(5)
    item = r.integers(0, 60, 12)
    for _ in range(30):
        part = r.integers(0, 60, 300)
        at = r.integers(0, 280)
        part[at : at + 12] = item[: len(part[at : at + 12])]
        got = decontam.similarity(item, part, 0.5)
        assert got and got[0] == decontam.align(item, part)[0] / 24
    import tracemalloc

    long = np.tile(np.arange(2000), 60)
    tracemalloc.start()
    assert decontam.similarity(np.arange(2000), long, 0.5) == (1.0, 0, 2000)
    assert tracemalloc.get_traced_memory()[1] < 20_000_000
    tracemalloc.stop()


def test_repeated_and_missing_ids(spark, documents):
    item = " ".join(WORDS(20))
    benchmark = spark.createDataFrame([(None, item), (3, item), (3, item), (4, "two words"), (None, None)], "item_id long, text string")
    docs = documents([item, item, "clean text", item], [None, 5, 5, 5])
    got = sorted(((r.doc_id, r.item_id) for r in decontam.contaminated(docs, benchmark).collect()), key=repr)
    assert got == sorted([(d, i) for d in (None, 5, 5) for i in (None, 3)], key=repr)
    assert [r.text for r in decontam.keep_clean(docs, benchmark).collect()] == ["clean text"]


def test_scripts_without_spaces(spark, documents):
    item = "東京の天気は明日も晴れるでしょうと彼は言った"
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = decontam.contaminated(documents(["前の文章。" + item + "。次の文章", "別の話です"]), benchmark).collect()
    assert [(r.doc_id, r.item_id, r.similarity) for r in rows] == [(0, 1, 1.0)]


def test_empty_tables(spark, documents):
    items, texts = corpus()
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert decontam.contaminated(documents([]), benchmark).count() == 0
    assert decontam.contaminated(documents(texts), benchmark.limit(0)).count() == 0
    assert decontam.keep_clean(documents(texts), benchmark.limit(0)).count() == len(texts)


def test_query_matches_brute_force(spark, small, folder):
    """All items against all texts, with edited copies planted: every pair that has a seed by definition is aligned whole."""
    from spalt.llm.queries import QUERIES

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    for k, (_, t) in enumerate(items[:30]):
        texts.append(" ".join([*WORDS(50), *edited(t.split(), 0.05 * (k % 8)), *WORDS(30)]))
    d = folder(documents=spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    counts, lists = {}, [decontam.words(t) for t in texts]
    for w in (w for x in lists for w in x):
        counts[w] = counts.get(w, 0) + 1
    total, want = sum(counts.values()), {}
    for i, t in items:
        own = decontam.words(t)
        grams = list(zip(own, own[1:], own[2:], strict=False))
        chance = [sum(np.log(max(counts.get(w, 0), 0.5) / total) for w in g) for g in grams]
        rare = {g for g, c in zip(grams, chance, strict=True) if c <= np.log(decontam.RARE)}
        if sum(c <= np.log(decontam.RARE) for c in chance) < decontam.LEAST:
            rare = {grams[k] for k in np.argsort(chance, kind="stable")[: decontam.LEAST]}
        for e, x in enumerate(lists):
            if rare & set(zip(x, x[1:], x[2:], strict=False)):
                best = slow_align(own, x) / (2 * len(own))
                if best >= decontam.THRESHOLD:
                    want[e, i] = best
    rows = QUERIES["op10_decontamination"](spark, d).collect()
    assert {(r.doc_id, r.item_id): r.similarity for r in rows} == want and len(rows) == len(want) > 25


def test_query_finds_verbatim_copies(spark):
    from spalt.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    got = {(r.doc_id, r.item_id): r.similarity for r in QUERIES["op10_decontamination"](spark, folder).collect()}
    items = [(r.item_id, b" ".join(decontam.words(r.text))) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        text = b" " + b" ".join(decontam.words(r.text)) + b" "
        for i, t in items:
            if b" " + t + b" " in text:
                assert got[(r.doc_id, i)] == 1.0
