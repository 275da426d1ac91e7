"""Toxicity by multiple-instance learning (operator 9).

A document is a bag of sentences, and only the bag is labelled. A sentence's score is a logistic function of its words
and their first letters (hashed to FEATURES weights), 0 if none of its words has a weight; the document's is their noisy-or, 1 minus the product
of (1 - sentence score): toxic if any sentence is. The weights are trained from document labels by the gradient of the
weighted log loss through the noisy-or, which sends a toxic label to the sentences that explain it; these are then
located by their scores. In training a leak, one more cause that every document has, takes the labels that no sentence
explains; it is left out of scores, and a long text doesn't score for its length.

The classifier is fitted on a bounded sample: at most SAMPLE labelled documents of either label and SAMPLE_CHARS characters
of these, those with the least hash of their doc_id, giants last, copies of a text once, weighted so that each label counts
as it does among all labelled rows. Tasks count in how many of these documents a feature is; all features that toxic ones
hold well beyond chance are learned, and what reaches the driver are their numbers, sentence by sentence. Scoring reads
every whole text, in place, with nothing shuffled.

Defined results: a null text or one without letters has no sentence and scores 0; several labels of one doc_id count as
toxic if one of them is; null labels and null doc_ids are not learned from; with no toxic or no other label, every
score is 0; repeated rows are scored one by one, a very long text as a whole; an empty table gives an empty result; other
columns stay, and a new column whose name is taken gets a _ behind it.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from spalt.llm.common import added, materialize, with_text_columns

FEATURES = 1 << 22
#: Labelled documents of either label that the classifier is fitted on, at most.
SAMPLE = 6000
#: And characters of these, at most; a document of more than a hundredth of them comes after all others.
SAMPLE_CHARS = 32_000_000
#: Documents of the sample that a word must be in to have a weight.
LEAST_DOCS = 5
#: And deviations at least by which more of these documents must be toxic than their number alone would have.
LEAST_Z = 5.0
STEPS, RATE, SHRINK = 160, 0.15, 2e-5
#: A lesser weight is none.
FAINT = 0.5
CUT = 0.7
_TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
_SENTENCE = re.compile(r"[^.!?\n]*[^.!?\n\s][^.!?\n]*")
_ENDS = ".!?\n"


def numbers(word: str) -> list[int]:
    """A word's features: itself, and its first four and five letters."""
    out = [zlib.crc32(word.encode()) % FEATURES]
    for n in (4, 5):
        if len(word) >= n:
            out.append(zlib.crc32(f"^{word[:n]}".encode()) % FEATURES)
    return out


def sentences(text: str | None) -> list[list[str]]:
    """Words of each sentence that has one."""
    out: list[list[str]] = [[]]
    for t in _TOKEN.findall((text or "").lower()):
        if t in _ENDS:
            out.append([])
        else:
            out[-1].append(t)
    return [s for s in out if s]


class _Weights(dict):
    """Word -> weight, filled as words come; a sentence's end is nan."""

    def __init__(self, weights: np.ndarray):
        super().__init__((e, np.nan) for e in _ENDS)
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > 500_000:
            self.clear()
            self.update((e, np.nan) for e in _ENDS)
        w = self[word] = float(self.weights[numbers(word)].sum())
        return w


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def sentence_scores(self, text: str | None, known: dict) -> np.ndarray:
        """Scores of the sentences that have a word, in order."""
        tokens = _TOKEN.findall((text or "").lower())
        v = np.fromiter(map(known.__getitem__, tokens), np.float64, len(tokens))
        end = np.isnan(v)
        sentence = np.cumsum(end)[~end]
        if not len(sentence):
            return np.zeros(0)
        first = np.flatnonzero(np.concatenate((np.ones(1, bool), sentence[1:] != sentence[:-1])))
        v = v[~end]
        z = np.add.reduceat(v, first) + self.bias
        return np.where(np.logical_or.reduceat(v != 0, first), 1 / (1 + np.exp(-np.clip(z, -40, 40))), 0.0)

    def score(self, text: str | None, known: dict) -> tuple[float, np.ndarray]:
        s = self.sentence_scores(text, known)
        return max(0.0, float(-np.expm1(np.log1p(-np.minimum(s, 1 - 1e-12)).sum()))), s


def fit(bags: list[list[list[int]]], labels: np.ndarray, weights: np.ndarray, steps: int = STEPS) -> Model:
    """bags: of each document the features of its sentences that have any; weights: of the documents."""
    features = np.array([f for b in bags for s in b for f in s], np.int64)
    return fit_flat(features, np.array([len(s) for b in bags for s in b], np.int64), np.array([len(b) for b in bags], np.int64), labels, weights, steps)


def fit_flat(features: np.ndarray, sizes: np.ndarray, sentences_of: np.ndarray, labels: np.ndarray, weights: np.ndarray, steps: int = STEPS) -> Model:
    """features one after the other, sizes: how many each sentence has, sentences_of: how many sentences each document has."""
    nothing = Model(np.zeros(FEATURES, np.float32), -60.0)
    y, n_docs = labels.astype(np.float64), len(sentences_of)
    if not len(sizes) or y.min() == y.max():
        return nothing
    used, word = np.unique(features, return_inverse=True)
    sentence = np.repeat(np.arange(len(sizes)), sizes)
    doc = np.repeat(np.arange(n_docs), sentences_of)
    w, total = np.zeros(len(used)), weights.sum()
    own = np.array([-2.0, -3.0])  # of every sentence; of the leak
    m, v = np.zeros(len(used) + 2), np.zeros(len(used) + 2)
    for step in range(1, steps + 1):
        z = np.clip(np.bincount(sentence, w[word], len(sizes)) + own[0], -30, 30)
        s, leak = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-own[1]))
        rest = np.log1p(-leak) - np.bincount(doc, np.logaddexp(0, z), n_docs)  # log of the chance that there is no cause
        p = np.maximum(-np.expm1(rest), 1e-9)
        blame = np.where(y > 0, -(1 - p) / p, 1.0) * weights / total
        g = blame[doc] * s  # of the loss, by each sentence's sum
        grad = np.concatenate((np.bincount(word, g[sentence], len(used)) + SHRINK * np.sign(w), [g.sum(), leak * blame.sum()]))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, own = w - move[:-2], own - move[-2:]
    out = np.zeros(FEATURES, np.float32)
    out[used] = np.where(np.abs(w) >= FAINT, w, 0)
    return Model(out, float(own[0]))


def select(sample: DataFrame) -> np.ndarray:
    """Features of the sample's texts that toxic ones hold beyond chance, in order."""
    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n = sum(totals.values())
    share = totals.get(1, 0) / max(1, n)
    if not 0 < share < 1:
        return np.zeros(0, np.int64)

    def run(batches):
        counts = np.zeros((2, FEATURES), np.int32)
        for b in batches:
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                here = np.array(list({f for w in {w for s in sentences(text) for w in s} for f in numbers(w)}), np.int64)
                counts[y, here] += 1
        some = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[:, some].sum(axis=0, dtype=np.int64)), pa.array(counts[1, some].astype(np.int64))], ["feature", "n", "toxic"])

    rows = sample.select("text", "toxic").mapInArrow(run, "feature long, n long, toxic long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    z = (F.col("toxic") - F.col("n") * share) / F.sqrt(F.col("n") * (share * (1 - share)))
    picked = rows.where(F.col("n") >= LEAST_DOCS).where(z >= LEAST_Z).select("feature").toArrow()  # of the sample's words
    return np.sort(picked["feature"].to_numpy())


def train(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Model:
    """Fit on labelled documents of which `learn`, a condition on doc_id, is true."""
    labelled = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labelled = labelled.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    picked = None
    for y in (0, 1):
        part = labelled.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        picked = part if picked is None else picked.unionByName(part)
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")  # 2 * sample rows at most
    found = found.select("toxic", "text", F.xxhash64("doc_id").alias("at"), F.xxhash64("text").alias("h"), F.coalesce(F.length("text"), F.lit(0)).alias("chars")).dropDuplicates(["toxic", "h"])
    found = materialize(found, "labelled")
    # a window over the sample's rows without their texts
    order = Window.partitionBy("toxic").orderBy(F.col("chars") > chars // 100, "at", "h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = found.select("toxic", "h", F.sum("chars").over(order).alias("upto")).where(F.col("upto") <= chars).select("toxic", "h")
    found = materialize(found.join(F.broadcast(fits), ["toxic", "h"], "left_semi").select("text", "toxic"), "sample")
    features = select(found)

    def make():
        known = set(features.tolist())

        def compute(texts: list) -> list:
            bags = []
            for t in texts:
                bag = [[f for w in s for f in numbers(w) if f in known] for s in sentences(t)]
                bags.append([s for s in bag if s])
            return [bags]

        return compute

    kind = T.ArrayType(T.ArrayType(T.IntegerType()))
    table = with_text_columns(found, [T.StructField("bag", kind)], make, keep=["toxic"]).toArrow()
    y, bags = table["toxic"].to_numpy(), table["bag"].combine_chunks()
    share = np.bincount(y, minlength=2)
    weight = np.array([totals.get(k, 0) / max(1, share[k]) for k in (0, 1)])
    inner = bags.flatten()
    return fit_flat(inner.flatten().to_numpy().astype(np.int64), inner.value_lengths().to_numpy().astype(np.int64), bags.value_lengths().to_numpy().astype(np.int64), y, weight[y])


def score(docs: DataFrame, model: Model, offending: float = 0.5, keep: list[str] | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """docs' columns (of `keep`) with score, and offending: the (begin, end) characters and score of each sentence at or
    above `offending`; names renames the two."""
    score, spots = added(docs if keep is None else docs.select(*keep), ["score", "offending"], names)
    held = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES weights

    def make():
        model = held.value
        known = _Weights(model.weights)

        def compute(texts: list) -> list:
            scores, found = [], []
            for t in texts:
                p, s = model.score(t, known)
                scores.append(p)
                bad = np.flatnonzero(s >= offending).tolist()
                if bad:
                    at = [m.span() for m in _SENTENCE.finditer(t) if re.search(r"[^\W\d_]", m.group())]
                    found.append([{"begin": at[i][0], "end": at[i][1], "score": float(s[i])} for i in bad if i < len(at)])
                else:
                    found.append([])
            return [pa.array(scores, pa.float64()), found]

        return compute

    spot = T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
    return with_text_columns(docs, [T.StructField(score, T.DoubleType()), T.StructField(spots, T.ArrayType(spot))], make, keep=keep)
