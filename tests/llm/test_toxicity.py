import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from spalt.llm import toxicity
from tests.llm.conftest import LONG

BAD = ["scumbag", "moronic"]


def corpus(n=600, seed=4):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu") for b in ("ta", "ri", "so", "ve")]
    texts, labels = [], []
    for _ in range(n):
        toxic = r.random() < 0.2
        sentences = [r.choices(words, k=8) for _ in range(10)]
        if toxic:
            sentences[r.randrange(10)][3] = r.choice(BAD)
            sentences[r.randrange(10)][5] = r.choice(BAD)
        texts.append(". ".join(" ".join(s).capitalize() for s in sentences) + ".")
        labels.append(int(toxic))
    return texts, labels


def test_gradient_is_that_of_the_noisy_or():
    texts, labels = corpus(200)
    bags = [[[f for w in s for f in toxicity.numbers(w)] for s in toxicity.sentences(t)] for t in texts]
    model = toxicity.fit(bags, np.array(labels), np.ones(len(labels)))
    known = toxicity._Weights(model.weights)
    for t in texts[:20]:
        p, s = model.score(t, known)
        z = np.array([sum(float(model.weights[toxicity.numbers(w)].sum()) for w in x) + model.bias for x in toxicity.sentences(t)])
        some = [any(model.weights[toxicity.numbers(w)].sum() for w in x) for x in toxicity.sentences(t)]
        assert np.allclose(s, np.where(some, 1 / (1 + np.exp(-z)), 0)) and np.isclose(p, 1 - np.prod(1 - s))
    scores = np.array([model.score(t, known)[0] for t in texts])
    assert (scores >= 0.7).astype(int).tolist() == labels


def test_train_score_and_locate(spark, documents):
    texts, labels = corpus()
    ids = list(range(len(texts)))
    docs = documents(texts, ids).selectExpr("*", "1 AS toxic")
    rows = [(i, 1, y) for i, y in zip(ids, labels, strict=True)] + [(0, 1, labels[0]), (None, 1, 1), (5, 1, None), (10**6, 0, 1)]
    table = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, table, F.col("doc_id") % 3 != 1)
    out = toxicity.score(docs.drop("toxic"), model).collect()
    held = [r for r in out if r.doc_id % 3 == 1]
    assert np.mean([(r.score >= 0.7) == bool(labels[r.doc_id]) for r in held]) > 0.95
    for r in held:
        for s in r.offending:
            assert any(b in r.text[s.begin : s.end].lower() for b in BAD)
    probes = documents([None, "", "... !!\n\n", "you scumbag moronic scumbag", LONG, "kata lori"], [3, None, 3, 1, 2, 2])
    by = {r.text: r.score for r in toxicity.score(probes, model).collect()}
    assert by[None] == by[""] == by["... !!\n\n"] == 0.0 and by["you scumbag moronic scumbag"] > 0.7 and by[LONG] < 0.7
    assert all(0 <= s <= 1 for s in by.values())


def test_nothing_to_learn(spark, documents):
    docs = documents(["one two", "three"])
    for rows in ([], [(0, 1, 0), (1, 1, 0)], [(0, 1, 1)]):
        model = toxicity.train(docs, spark.createDataFrame(rows, "doc_id long, quality int, toxic int"), F.lit(True))
        assert [r.score for r in toxicity.score(docs, model).collect()] == [0.0, 0.0]
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_columns_with_the_same_names_and_bounds(spark, documents):
    texts, labels = corpus(300)
    docs = documents(texts).selectExpr("*", "7 AS score", "8 AS offending")
    table = spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)], "doc_id long, quality int, toxic int")
    out = toxicity.score(docs, toxicity.train(docs, table, F.lit(True)))
    assert out.columns == [*docs.columns, "score_", "offending_"] and np.mean([(r.score_ >= 0.7) == bool(labels[r.doc_id]) for r in out.collect()]) > 0.95
    few = toxicity.train(docs, table, F.lit(True), chars=sum(map(len, texts)) // 4)
    assert np.mean([(r.score_ >= 0.7) == bool(labels[r.doc_id]) for r in toxicity.score(docs, few).collect()]) > 0.9


def test_query_scores_are_those_of_the_formula(spark, small):
    """Each document's score, from the weights: noisy-or over sentences cut character by character."""
    from spalt.llm.queries import QUERIES

    docs, labels = (spark.read.parquet(f"{small}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.train(docs.select("doc_id", "text"), labels, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    rows = {r.doc_id: r for r in QUERIES["op9_toxicity"](spark, small).collect()}
    for r in docs.select("doc_id", "text").collect():
        rest, sentence = 1.0, []
        for c in [*(r.text or "").lower(), "\n"]:
            if c in ".!?\n":
                words = "".join(x if x.isalpha() else " " for x in sentence).split()
                w = [sum(float(model.weights[f]) for f in toxicity.numbers(x)) for x in words]
                if any(w):
                    rest *= 1 - 1 / (1 + np.exp(-(sum(w) + model.bias)))
                sentence = []
            else:
                sentence.append(c)
        assert np.isclose(rows[r.doc_id].score, 1 - rest, atol=1e-6)
        assert rows[r.doc_id].predicted == int(rows[r.doc_id].score >= 0.7)
    assert len(rows) == docs.count()


def test_query_on_held_out_texts(spark):
    from spalt.llm.queries import QUERIES

    folder = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in QUERIES["op9_toxicity"](spark, folder).collect()}
    true = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in rows.items())
    held = [d for d in true if rows[d].held_out]
    hit = sum(rows[d].predicted for d in held if true[d])
    assert hit / sum(true[d] for d in held) > 0.82 and hit / sum(rows[d].predicted for d in held) > 0.92
