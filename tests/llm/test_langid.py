import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from spalt.llm import langid
from tests.llm.conftest import LONG


def gram_counts(texts, order):
    """n-grams as tuples of characters, by the rules of the module, one character at a time."""
    out = Counter()
    for t in texts:
        s, last = [], " "
        for c in (t or "").lower():
            c = c if c.isalpha() else " "
            if not (c == " " and last == " "):
                s.append(c)
            last = c
        s = [" "] * (order - 1) + s
        out.update(tuple(s[i : i + order]) for i in range(len(s) - order + 1))
    return out


class Brute:
    """Interpolated Kneser-Ney, from the definitions."""

    def __init__(self, counts, order, symbols):
        self.order, self.symbols, self.levels = order, symbols, {order: counts}
        for k in range(order - 1, 0, -1):
            c = Counter()
            for g, n in self.levels[k + 1].items():
                c[g[1:]] += n > 0
            self.levels[k] = c
        self.discount, self.total, self.kinds = {}, {}, {}
        for k, c in self.levels.items():
            ones, twos = sum(n == 1 for n in c.values()), sum(n == 2 for n in c.values())
            self.discount[k] = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
            self.total[k], self.kinds[k] = defaultdict(int), defaultdict(int)
            for g, n in c.items():
                self.total[k][g[:-1]] += n
                self.kinds[k][g[:-1]] += 1

    def p(self, g):
        k = len(g)
        if k == 0:
            return 1 / (self.symbols + 1)
        h, d = g[:-1], self.discount[k]
        if not self.total[k][h]:
            return self.p(g[1:])
        return max(self.levels[k][g] - d, 0) / self.total[k][h] + d * self.kinds[k][h] / self.total[k][h] * self.p(g[1:])


def test_model_is_kneser_ney():
    order, texts = 3, {"a": ["Hello, world!", "hello there", "old  wörld"], "b": ["hola mundo", "hola, el mundo ñandú"]}
    keys, columns = [], []
    for t in texts.values():
        k, n = np.unique(langid.grams(t, order)[0], return_counts=True)
        keys.append(k)
        columns.append(dict(zip(k.tolist(), n.tolist(), strict=True)))
    union = np.unique(np.concatenate(keys))
    models = langid.Models(["a", "b"], union, np.array([[c.get(k, 0) for c in columns] for k in union.tolist()]), order)
    every = [gram_counts(t, order) for t in texts.values()]
    symbols = len({g[-1] for c in every for g in c})
    brutes = [Brute(c, order, symbols) for c in every]
    probe = "hello mundo, xyz ñ quite other old"
    entropies, letters = models.cross_entropies([probe, "", None, "123"])
    want = gram_counts([probe], order)
    for i, b in enumerate(brutes):
        assert np.isclose(entropies[0, i], -sum(n * np.log(b.p(g)) for g, n in want.items()) / sum(want.values()), rtol=1e-5)
    assert letters.tolist() == [sum(c.isalpha() for c in probe), 0, 0, 0]
    assert abs(sum(brutes[0].p(("h", "e", c)) for c in {g[-1] for g in every[0]}) - 1) < 0.1


def test_hash_array():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 60, 5000).astype(np.uint64))
    a = langid.HashArray(keys[::2].copy())
    at = a.find(keys)
    assert (at[1::2] == -1).all() and (keys[::2][a.order[at[::2]]] == keys[::2]).all()


def corpus(n=240, seed=1):
    r = random.Random(seed)
    syllables = {"xx": ["ka", "to", "mi", "ru"], "yy": ["bel", "gor", "zun", "pli"]}
    texts, langs = [], []
    for i in range(n):
        g = ("xx", "yy")[i % 2]
        texts.append(" ".join("".join(r.choices(syllables[g], k=r.randrange(1, 4))) for _ in range(30)))
        langs.append(g)
    return texts, langs


def test_prediction_and_edges(documents):
    texts, langs = corpus()
    models = langid.train(documents(texts, langs=langs))
    probes = [None, "", "123 !?", "katomiru ruka", "belgor zun", "katomiru ruka", "жщюъ " * 20, LONG]
    docs = documents(probes, [0, 1, 2, None, 4, 4, 6, 7]).selectExpr("*", "'no' AS cross_entropy_", "1 AS text__")
    rows = langid.predict(docs, models, keep=["text"]).collect()
    by = {r.text: r for r in rows}
    assert [by[t].lang_pred for t in probes[:5]] == ["und", "und", "und", "xx", "yy"]
    assert all(by[t].score == 0 for t in probes[:3]) and by["katomiru ruka"].score > 0.9
    assert by["жщюъ " * 20].rejected and not by["belgor zun"].rejected and len(rows) == len(probes)
    assert langid.train(documents([])) is None
    assert [r.lang_pred for r in langid.predict(docs, None, keep=[]).collect()] == ["und"] * len(probes)
    assert langid.train(documents(["a b", None], langs=[None, "en"])) is None


def test_shards_give_the_same_predictions(documents):
    texts, langs = corpus(120)
    docs, probes = documents(texts, langs=langs), documents([*texts[:40], None, "", LONG[:3000], "ka zzz bel"])
    whole, cut = langid.train(docs), langid.train(docs, cells=400)
    assert whole.shards == 1 and cut.shards > 3 and cut.order == whole.order == langid.ORDER and cut.temperature == whole.temperature
    one, many = ({r.doc_id: r for r in langid.predict(probes, m, keep=["doc_id"]).collect()} for m in (whole, cut))
    for i, r in one.items():
        assert (many[i].lang_pred, many[i].rejected) == (r.lang_pred, r.rejected)
        assert np.isclose(many[i].score, r.score) and (r.cross_entropy is None or np.isclose(many[i].cross_entropy, r.cross_entropy))


def test_all_texts_to_learn_from_count(documents):
    texts, langs = corpus(40)
    langs[0], texts[0] = "rare", "qu wu vu " * 10
    for i in range(0, 20):  # wherever the one text falls, left out of the first counts or not
        models = langid.train(documents(texts, [1000 * i + j for j in range(40)], langs))
        assert langid.predict(documents(["wu qu vu qu"]), models).first().lang_pred == "rare"


def test_columns_with_the_same_names(documents):
    texts, langs = corpus(40)
    docs = documents(texts, langs=langs).selectExpr("*", "7 AS score", "8 AS lang_pred", "9 AS letters", "9 AS entropies")
    out = langid.predict(docs, langid.train(documents(texts, langs=langs)))
    assert out.columns == [*docs.columns, "lang_pred_", "score_", "cross_entropy", "rejected"]
    assert {(r.score, r.lang_pred) for r in out.collect()} == {(7, 8)}


def test_query_matches_brute_force(spark, small):
    from spalt.llm.queries import QUERIES

    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang").collect()
    learned = [r for r in docs if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang and r.text is not None]
    every = {g: gram_counts([r.text for r in learned if r.lang == g], langid.ORDER) for g in sorted({r.lang for r in learned})}
    symbols = len({g[-1] for c in every.values() for g in c})
    brutes = {g: Brute(c, langid.ORDER, symbols) for g, c in every.items()}
    rows = {r.doc_id: r for r in QUERIES["op1_language_id"](spark, small).collect()}
    assert len(rows) == len(docs)
    for r in docs[::5]:
        counts = gram_counts([r.text], langid.ORDER)
        entropy = {g: -sum(n * np.log(b.p(x)) for x, n in counts.items()) / max(1, sum(counts.values())) for g, b in brutes.items()}
        got = rows[r.doc_id]
        if any(c.isalpha() for c in r.text or ""):
            assert np.isclose(got.cross_entropy, min(entropy.values()), rtol=1e-4) and np.isclose(entropy[got.lang_pred], min(entropy.values()), rtol=1e-6)
        else:
            assert (got.lang_pred, got.score) == ("und", 0.0)


def test_query_on_held_out_texts(spark):
    from spalt.llm.queries import QUERIES

    folder = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in QUERIES["op1_language_id"](spark, folder).collect()}
    true = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    held = [d for d in true if rows[d].held_out]
    assert len(rows) == len(true) and len(held) > 100
    assert sum(rows[d].lang_pred == true[d] for d in held) / len(held) > 0.99
