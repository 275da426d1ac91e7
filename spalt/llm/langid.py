"""Language identification by interpolated Kneser-Ney character models (operator 1).

One model for each language over n-grams of ORDER characters, lower-cased, every run of non-letters one space. Spark
counts the longest n-grams of all texts to learn from, for each language; from these, level by level, the shorter
n-grams' continuation counts (in how many longer ones they end) and the discounts, as groupings of written tables. A text
goes to the language of the least cross-entropy, the mean negative log probability of its characters.

N-grams of all languages are kept in hash arrays: their mixed keys in order, with the first place of each leading bits,
and beside them a column of log probabilities for each language. The arrays are cut into shards of about CELLS cells by
the two characters before an n-gram's last: all that a character's probability needs, at every level down to three, is in
one shard, and pairs and single characters are in each. A shard is what is collected and broadcast at a time; texts meet
the shards one after the other and their losses are summed, so the order of the model never depends on its size.

Calibration: one in CALIBRATE of the texts to learn from is left out of a first set of counts. On these, a temperature
for the softmax over cross-entropies is chosen by log loss, which makes `score` the chance that the prediction is right,
and each language's mean and deviation of cross-entropy give the limit beyond which `rejected` says that the text is like
no learned language. The models that predict count all texts to learn from.

Defined results: a null text or one without a letter is `und` with score 0; with nothing to learn from, all texts are;
equal cross-entropies go to the first language by name; repeated rows are predicted one by one, a very long text as a
whole; an empty table gives an empty result; other columns stay, and a new column whose name is taken gets a _ behind it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spalt.llm.common import added, fresh, materialize, slices, with_row_key, with_text_columns

ORDER = 5
BITS = 12
#: Log probabilities in a shard, about: what the driver and a worker hold at a time.
CELLS = 8_000_000
CALIBRATE = 16
DEVIATIONS = 6.0
TEMPERATURES = tuple(0.01 * 1.5**k for k in range(16))
NONE = "und"
_MIX = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """Code point -> 12-bit symbol: 32 for what is no letter; letters under 2048 are themselves, others share 2048 symbols."""
    points = np.arange(0x110000, dtype=np.uint64)
    table = np.where(points < 2048, points, 2048 + ((points * np.uint64(2654435761) & np.uint64(0xFFFFFFFF)) >> np.uint64(21)))
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return np.where(letter, table, 32).astype(np.uint16)


def grams(texts: list, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys of the n-grams that end at each symbol, the text each is of, letters of each text).

    A key packs the symbols in BITS bits each; before its first symbol a text has spaces.
    """
    joined = "\0" + "\0".join((t or "").lower().replace("\0", " ") for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    border = points == 0
    s = symbols()[points].astype(np.uint64)
    space = (s == 32) & ~border
    again = np.zeros(len(s), bool)
    again[1:] = space[1:] & (space[:-1] | border[:-1])  # spaces after a space, or at the start
    s, border = s[~again], border[~again]
    times = np.where(border, order - 1, 1) if order > 1 else np.where(border, 0, 1)
    text = np.repeat(np.cumsum(border) - 1, times)
    s, border = np.repeat(s, times), np.repeat(border, times)
    key, n = np.zeros(len(s) - order + 1, np.uint64), len(s) - order + 1
    for k in range(order):
        key = (key << np.uint64(BITS)) | s[k : k + n]
    real = ~border[order - 1 :]
    text = text[order - 1 :][real]
    letters = np.bincount(text, s[order - 1 :][real] != 32, len(texts)).astype(np.int64)
    return key[real], text, letters


class HashArray:
    """Keys in the order of their mixed values, and the place of the first for each value of their leading bits."""

    def __init__(self, keys: np.ndarray):
        mixed = keys * _MIX
        self.order = np.argsort(mixed)
        self.mixed = mixed[self.order]
        bits = max(1, int(len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.mixed >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places in the sorted arrays, -1 for keys that are not there."""
        mixed = keys * _MIX
        lead = (mixed >> self.shift).astype(np.int64)
        at, end = self.first[lead], self.first[lead + 1]
        out = np.full(len(keys), -1, np.int64)
        rest = np.flatnonzero(at < end)
        while len(rest):
            here = self.mixed[at[rest]]
            hit = here == mixed[rest]
            out[rest[hit]] = at[rest[hit]]
            rest = rest[here < mixed[rest]]
            at[rest] += 1
            rest = rest[at[rest] < end[rest]]
        return out


class Models:
    """Kneser-Ney models of several languages over shared hash arrays; of one shard, if low and discounts are given."""

    def __init__(self, languages: list[str], keys: np.ndarray, counts: np.ndarray, order: int, low: list | None = None, discounts: np.ndarray | None = None, shard: int = 0, shards: int = 1):
        """keys: distinct n-grams of `order` symbols; counts: theirs, a column for each language.

        low: (keys, counts) of the levels one and two of all shards; discounts: a row for each level, of all shards.
        """
        self.languages, self.order, self.shard, self.shards = languages, order, shard, shards
        self.grams: list[HashArray] = []
        self.logs: list[np.ndarray] = []
        self.contexts: list[HashArray] = []
        self.backoffs: list[np.ndarray] = []
        levels = [(keys, counts.astype(np.float64))]
        for k in range(order - 1, 0, -1):  # continuation counts: distinct longer n-grams that end in this one
            longer, c = levels[0]
            short, own = np.unique(longer & np.uint64((1 << BITS * k) - 1), return_inverse=True)
            n = np.zeros((len(short), c.shape[1]))
            np.add.at(n, own, c > 0)
            levels.insert(0, (short, n))
        if low is not None:
            levels[: len(low)] = low
        lower = np.full((1, len(languages)), 1 / (len(levels[0][0]) + 1))
        self.floor = np.log(lower[0])
        for k, (key, c) in enumerate(levels, 1):
            ones, twos = (c == 1).sum(axis=0), (c == 2).sum(axis=0)
            discount = discount_of(ones, twos) if discounts is None else discounts[k - 1]
            context, own = np.unique(key >> np.uint64(BITS), return_inverse=True)
            total, kinds = np.zeros((2, len(context), c.shape[1]))
            np.add.at(total, own, c)
            np.add.at(kinds, own, c > 0)
            backoff = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            below = lower if k == 1 else lower[np.searchsorted(levels[k - 2][0], key & np.uint64((1 << BITS * (k - 1)) - 1))]
            p = np.maximum(c - discount, 0) / np.maximum(total[own], 1) + backoff[own] * below
            found, h = HashArray(key), HashArray(context)
            self.grams.append(found)
            self.logs.append(np.log(p[found.order]).astype(np.float32))
            self.contexts.append(h)
            self.backoffs.append(np.log(backoff[h.order]).astype(np.float32))
            lower = p

    def log_probabilities(self, keys: np.ndarray, k: int | None = None) -> np.ndarray:
        """Of each n-gram's last symbol after the others, a column for each language."""
        k = self.order if k is None else k
        if k == 0:
            return np.broadcast_to(self.floor, (len(keys), len(self.floor)))
        at = self.grams[k - 1].find(keys)
        out = self.logs[k - 1][np.maximum(at, 0)]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            low = self.log_probabilities(keys[miss] & np.uint64((1 << BITS * (k - 1)) - 1), k - 1)
            h = self.contexts[k - 1].find(keys[miss] >> np.uint64(BITS))
            out[miss] = low + np.where(h[:, None] >= 0, self.backoffs[k - 1][np.maximum(h, 0)], 0)
        return out

    def losses(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(negative log probabilities of this shard's characters, a row for each text and a column for each language; symbols of each text; its letters)."""
        keys, text, letters = grams(texts, self.order)
        size = np.bincount(text, minlength=len(texts))
        if self.shards > 1:
            own = shard_of(keys, self.shards) == self.shard
            keys, text = keys[own], text[own]
        total = np.zeros((len(texts), len(self.languages)))
        step = max(1000, 4_000_000 // max(1, len(self.languages)))
        for i in range(0, len(keys), step):
            logs, of = self.log_probabilities(keys[i : i + step]), text[i : i + step]
            first = np.flatnonzero(np.concatenate((np.ones(1, bool), of[1:] != of[:-1])))
            total[of[first]] -= np.add.reduceat(logs, first, axis=0, dtype=np.float64)
        return total, size, letters

    def cross_entropies(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """(a row for each text and a column for each language, letters of each text), of a model with one shard."""
        total, size, letters = self.losses(texts)
        return total / np.maximum(1, size)[:, None], letters


def discount_of(ones: np.ndarray, twos: np.ndarray) -> np.ndarray:
    return np.clip(ones / np.maximum(1, ones + 2 * twos), 0.1, 0.95)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """By the two symbols before the last."""
    return ((keys >> np.uint64(BITS)) & np.uint64((1 << 2 * BITS) - 1)) % np.uint64(shards)


def count_grams(docs: DataFrame, languages: list[str], order: int = ORDER) -> DataFrame:
    """(lang, gram, n, first) over all of docs (text, lang, left_out): lang is the place in languages, first counts the
    rows that are not left out. Tasks sum their own counts before."""
    place = {x: i for i, x in enumerate(languages)}

    def run(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def rows():
            for i, (k, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), i, np.int32)), pa.array(k.view(np.int64)), pa.array(n)], ["code", "gram", "n"])
            held.clear()

        for whole in batches:
            for b in slices(whole, 0):
                keys, text, _ = grams(b.column(0).to_pylist(), order)
                code = np.array([2 * place[x] + y for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)], np.int32)
                code = code[text] if len(text) else np.zeros(0, np.int32)
                for i in np.unique(code).tolist():
                    k, n = np.unique(keys[code == i], return_counts=True)
                    if i in held:
                        both, own = np.unique(np.concatenate((held[i][0], k)), return_inverse=True)
                        k, n = both, np.bincount(own, np.concatenate((held[i][1], n))).astype(np.int64)
                    held[i] = (k, n.astype(np.int64))
                if sum(len(k) for k, _ in held.values()) > 2_000_000:
                    yield from rows()
        yield from rows()

    counted = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), "left_out").mapInArrow(run, "code int, gram long, n long")
    return counted.groupBy(F.shiftright("code", 1).alias("lang"), "gram").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("code") % 2 == 0, F.col("n")).otherwise(0)).alias("first"))


@dataclass
class Trained:
    """Models of all languages as tables in the shared folder, level k at tables[k]: (lang, gram, n, first)."""

    languages: list[str]
    tables: dict[int, DataFrame]
    discounts: dict[str, np.ndarray]
    shards: int
    temperature: float
    mean: np.ndarray
    deviation: np.ndarray

    @property
    def order(self) -> int:
        return max(self.tables)

    def _matrix(self, rows: DataFrame, count: str) -> tuple[np.ndarray, np.ndarray]:
        table = rows.where(F.col(count) > 0).select("lang", "gram", F.col(count).alias("n")).toArrow()
        keys, own = np.unique(table["gram"].to_numpy().view(np.uint64), return_inverse=True)
        matrix = np.zeros((len(keys), len(self.languages)))
        matrix[own, table["lang"].to_numpy()] = table["n"].to_numpy()
        return keys, matrix

    def shard(self, i: int, count: str = "n") -> Models:
        """Collects one shard, and the pairs and single symbols of the languages."""
        top, low = self.tables[self.order], [self._matrix(self.tables[k], count) for k in (1, 2) if k < self.order]
        if self.shards > 1:
            pair = F.shiftright("gram", BITS).bitwiseAND(F.lit((1 << 2 * BITS) - 1))
            top = top.where(pair % self.shards == i)
        return Models(self.languages, *self._matrix(top, count), self.order, low, self.discounts[count], i, self.shards)


def train(docs: DataFrame, order: int = ORDER, cells: int = CELLS) -> Trained | None:
    """Models of all languages of docs (doc_id, text, lang), calibrated; None where nothing can be learned."""
    left_out = F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATE)) == 0
    docs = docs.where("text IS NOT NULL AND lang IS NOT NULL").select(F.col("text"), F.col("lang").cast("string").alias("lang"), left_out.cast("int").alias("left_out"))
    languages = sorted(r[0] for r in docs.select("lang").distinct().collect())
    if not languages:
        return None
    tables = {order: materialize(count_grams(docs, languages, order), "grams")}
    for k in range(order - 1, 0, -1):
        short = F.col("gram").bitwiseAND(F.lit((1 << BITS * k) - 1)).alias("gram")
        tables[k] = materialize(tables[k + 1].groupBy("lang", short).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("first") > 0).alias("first")), f"grams{k}")
    if tables[order].isEmpty():
        return None
    # a row for each level and language
    every = reduce(DataFrame.unionByName, (t.withColumn("level", F.lit(k)) for k, t in tables.items()))
    facts = every.groupBy("level", "lang").agg(*(F.count_if(F.col(c) == i).alias(f"{c}{i}") for c in ("n", "first") for i in (1, 2))).collect()
    seen = {(c, i): np.zeros((order, len(languages))) for c in ("n", "first") for i in (1, 2)}
    for r in facts:
        for (c, i), x in seen.items():
            x[r["level"] - 1, r["lang"]] = r[f"{c}{i}"]
    size = every.where("level > 2").select("level", "gram").distinct().count() * len(languages)
    trained = Trained(languages, tables, {c: discount_of(seen[c, 1], seen[c, 2]) for c in ("n", "first")}, max(1, -(-size // cells)) if order > 2 else 1, 0.05, np.zeros(len(languages)), np.full(len(languages), np.inf))
    calibrate(trained, docs.where("left_out = 1"))
    return trained


def entropies(docs: DataFrame, trained: Trained, keep: list[str], names: list[str], count: str = "n") -> DataFrame:
    """docs' columns of `keep` and two more, named by names: cross-entropies in the order of languages, and letters."""
    spark = docs.sparkSession

    def losses(source: DataFrame, i: int, keep: list[str], names: list[str], mean: bool) -> DataFrame:
        held = spark.sparkContext.broadcast(trained.shard(i, count))  # CELLS cells, about

        def make():
            model = held.value

            def compute(texts: list) -> list:
                total, size, letters = model.losses(texts)
                if mean:
                    total = total / np.maximum(1, size)[:, None]
                return [total.tolist(), letters.tolist(), size.tolist()][: 2 if mean else 3]

            return compute

        kinds = [T.ArrayType(T.DoubleType()), T.LongType(), T.LongType()]
        return with_text_columns(source, [T.StructField(n, k) for n, k in zip(names, kinds, strict=False)], make, keep=keep)

    if trained.shards == 1:
        return losses(docs, 0, keep, names, True)
    row = fresh("row", docs)
    keyed = with_row_key(docs, row)
    source = keyed.select(F.col(row).alias("row"), F.col("text"))
    parts = [materialize(losses(source, i, ["row"], ["losses", "letters", "size"], False), f"losses{i}") for i in range(trained.shards)]
    columns = range(len(trained.languages))
    whole = reduce(DataFrame.unionByName, parts).groupBy("row").agg(*(F.sum(F.col("losses")[j]).alias(f"l{j}") for j in columns), F.max("letters").alias("letters"), F.max("size").alias("size"))
    entropy = F.array(*(F.col(f"l{j}") / F.greatest("size", F.lit(1)) for j in columns))
    whole = materialize(whole.select(F.col("row").alias(fresh("of", docs)), entropy.alias(names[0]), F.col("letters").alias(names[1])), "losses")
    return keyed.join(whole.hint("merge"), F.col(row) == F.col(whole.columns[0])).select(*(F.col(f"`{c}`") for c in keep), *names)


def weight(entropies: Column, temperature: float) -> Column:
    """The softmax's sum, in units of its greatest part: that of the least cross-entropy."""
    return F.aggregate(entropies, F.lit(0.0), lambda a, x: a + F.exp((F.array_min(entropies) - x) / temperature))


def calibrate(trained: Trained, docs: DataFrame) -> None:
    """Set the temperature and each language's usual cross-entropy from sums over docs (doc_id, text, lang), which the first counts leave out."""
    if trained.tables[trained.order].where("first > 0").isEmpty():
        return
    place = F.array_position(F.array(*map(F.lit, trained.languages)), F.col("lang")).cast("int")
    numbered = docs.select(F.xxhash64("text").alias("doc_id"), "text", (place - 1).alias("place"))
    scored = entropies(numbered, trained, ["place"], ["entropy", "letters"], "first").where("letters > 0")
    own = F.get("entropy", F.col("place"))
    # log loss of a temperature
    loss = [F.sum((own - F.array_min("entropy")) / t + F.log(weight(F.col("entropy"), t))).alias(f"t{i}") for i, t in enumerate(TEMPERATURES)]
    rows = scored.groupBy("place").agg(*loss, F.count(F.lit(1)).alias("n"), F.avg(own).alias("mean"), F.stddev_pop(own).alias("spread")).collect()  # one for each language
    if not rows:
        return
    total = [sum(r[f"t{i}"] for r in rows) for i in range(len(TEMPERATURES))]
    trained.temperature = TEMPERATURES[int(np.argmin(total))]
    for r in rows:
        if r["n"] > 1:
            trained.mean[r["place"]], trained.deviation[r["place"]] = r["mean"], max(r["spread"], 0.02)


def predict(docs: DataFrame, trained: Trained | None, keep: list[str] | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """docs' columns (of `keep`) with lang_pred, score, cross_entropy and rejected (renamed by names); only text is read."""
    keep = list(docs.columns if keep is None else keep)
    lang, score, entropy, rejected = added(docs.select(*keep), ["lang_pred", "score", "cross_entropy", "rejected"], names)
    if trained is None:
        nothing = [F.lit(NONE).alias(lang), F.lit(0.0).alias(score), F.lit(None).cast("double").alias(entropy), F.lit(True).alias(rejected)]
        return docs.select(*(F.col(f"`{c}`") for c in keep), *nothing)
    every, letters = fresh("entropies", docs), fresh("letters", docs)
    found = entropies(docs, trained, keep, [every, letters])
    e, some = F.col(every), F.col(letters) > 0
    least = F.array_min(e)
    best = F.array_position(e, least).cast("int")
    chance = 1 / weight(e, trained.temperature)
    limits = np.where(np.isinf(trained.deviation), np.inf, trained.mean + DEVIATIONS * np.where(np.isinf(trained.deviation), 0, trained.deviation))
    far = least > F.element_at(F.array(*map(F.lit, limits.tolist())), best)
    return found.select(
        *(F.col(f"`{c}`") for c in keep),
        F.when(some, F.element_at(F.array(*map(F.lit, trained.languages)), best)).otherwise(NONE).alias(lang),
        F.when(some, chance).otherwise(0.0).alias(score),
        F.when(some, least).alias(entropy),
        (far | ~some).alias(rejected),
    )
