import public_tokenizers
import sentencepiece

import corpus_pipeline
from spalt.llm import decontam
from spalt.llm.quality import RULES, Features
from tests.llm.test_linededup import brute as cut_lines
from tests.llm.test_simhash import brute_similar

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def expected(rows, items):
    """The five stages by brute force: (doc_id, text) -> (doc_id, text)."""
    rows = [(d, t) for d, t in rows if not any(r.rejects(Features(t)) for r in RULES)]
    rows = [(d, t) for d, t, _, _ in cut_lines(rows)]
    groups = brute_similar(dict(rows))
    rows = [(d, t) for d, t in rows if groups[d] == d]
    items = [decontam.words(x) for x in items]
    counts = {}
    for _, t in rows:
        for w in decontam.words(t):
            counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values())

    def leaks(text):
        words = decontam.words(text)
        for item in items:
            here = {tuple(words[i : i + 3]) for i in range(len(words) - 2)}
            if here & {tuple(item[i : i + 3]) for i in range(len(item) - 2)}:
                number = {w: i for i, w in enumerate(set(item) | set(words))}
                if decontam.align(*(decontam.np.array([number[w] for w in x]) for x in (item, words)))[0] >= decontam.THRESHOLD * 2 * len(item):
                    return True
        return False

    assert total
    return [(d, t) for d, t in rows if not leaks(t)]


def test_stages_against_brute_force(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    out = corpus_pipeline.run(spark, small)
    assert out.columns[:5] == COLUMNS
    rows = {r.doc_id: r for r in out.collect()}
    want = dict(expected(docs, items))
    assert {d: r.text for d, r in rows.items()} == want and 0 < len(want) < len(docs)
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in rows.values():
        assert r.ids == model.encode(r.text) and r.decoded == model.decode(r.ids) and r.n_chars == len(r.text)


def test_stages_on_odd_tables(spark, small, documents):
    from spalt.llm.common import materialize

    clean = " ".join(f"word{i} thing{i}" for i in range(60))
    texts = [None, "", clean, clean, clean + " more", "\n".join([clean[:200], clean[200:400], clean[400:]])]
    for docs in (documents(texts, [None, 1, 2, 2, 3, 4]), documents([])):
        docs = docs.selectExpr("*", "1 AS kept", "2 AS n_removed", "3 AS fp", "4 AS ids", "5 AS m")
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            before, docs = docs, materialize(stage(spark, docs, small), f"s{i}")
            assert docs.columns[: len(before.columns)] == before.columns, name
            if i < 4:
                assert docs.columns == before.columns and docs.dtypes == before.dtypes
