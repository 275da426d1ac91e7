"""Quality rules as a short-circuit cascade (operator 8).

Each rule rejects or passes a text. The cascade first measures every rule on a sample that is drawn from all of the table,
in the tasks that hold it: seconds for a text, to a power of two, and which rules reject the same texts. It puts the rule of
most rejections per second first, then, of the texts that are left, the next, and so on, and applies the rules to all rows
in that order, stopping at the first that rejects. The order changes the work only: the verdict is that of all rules
together. Only a count for each set of rejecting rules and each rule's seconds reach the driver.

Defined results: a null text is like an empty one (no words, rejected by the length rule); ties in the order go by
rule name; repeated rows are judged one by one, a very long text as a whole; an empty table gives an empty result; other
columns stay, and a new column whose name is taken gets a _ behind it.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spalt.llm.common import added, fresh, with_text_columns

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER, LOWER = regex.compile(r"\p{Lu}+"), regex.compile(r"\p{Ll}+")


class Features:
    """What rules ask of one text, computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode().split()  # bytes.split() splits at exactly \x20 and \x09-\x0D

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, WHITE))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(WHITE)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words covered by a 3-word window that the text holds twice or more."""
        if self.n_words < 4:
            return 0
        seen: dict[bytes, int] = {}
        ids = np.fromiter((seen.setdefault(w, len(seen)) for w in self.words), np.int64, self.n_words)
        m = len(seen)
        pair = ids[:-1] * m + ids[1:]
        if m > 2_000_000:  # m ** 3 would not fit 63 bits
            pair = np.unique(pair, return_inverse=True)[1]
        window = pair[:-1] * m + ids[2:]
        order = np.argsort(window, kind="stable")
        same = window[order][1:] == window[order][:-1]
        twice = np.zeros(len(window), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(self.n_words, bool)
        for shift in range(3):
            covered[shift : shift + len(window)] |= twice
        return int(covered.sum())

    @cached_property
    def upper_share(self) -> float:
        """Upper-case letters (Lu) among these and lower-case ones (Ll)."""
        upper, lower = (sum(map(len, x.findall(self.text))) for x in (UPPER, LOWER))
        return upper / max(1, upper + lower)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Features], bool]


#: Base rules first by convention only; the cascade finds its own order.
RULES = (
    Rule("too_short", lambda f: f.n_words < 50),
    Rule("repetitive", lambda f: 100 * f.n_repeat_words > 50 * f.n_words),
    Rule("symbols", lambda f: 10 * f.n_symbols > f.n_words),
    Rule("duplicate_lines", lambda f: 2 * f.n_dup_lines > len(f.lines)),
    Rule("word_length", lambda f: not 2 * f.n_words <= f.word_chars <= 20 * f.n_words),
    Rule("shouting", lambda f: f.upper_share > 0.5),
)
BASE = ("too_short", "repetitive")
#: Rows of the sample that the order of rules comes from, on average.
SAMPLE_ROWS = 1000
#: Rejecting rules (a bit for each) -> texts, and seconds of each rule for a text.
Measured = tuple[dict[int, int], list[float]]


def measure(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> Measured:
    """The rules on a sample of all of docs, measured where the rows are."""
    n = docs.count()
    few = docs if n <= sample_rows else docs.sample(sample_rows / n, seed=7)

    def make():
        def compute(texts: list) -> list:
            masks, seconds = [], []
            for t in texts:
                mask, took = 0, []
                for i, r in enumerate(rules):
                    start = time.perf_counter()
                    mask |= r.rejects(Features(t)) << i
                    took.append(time.perf_counter() - start)
                masks.append(mask)
                seconds.append(took)
            return [masks, seconds]

        return compute

    kinds = [T.StructField("mask", T.LongType()), T.StructField("seconds", T.ArrayType(T.DoubleType()))]
    took = [F.sum(F.col("seconds")[i]).alias(f"s{i}") for i in range(len(rules))]
    rows = with_text_columns(few.select("text"), kinds, make, keep=[]).groupBy("mask").agg(F.count(F.lit(1)).alias("n"), *took).collect()
    total = sum(r["n"] for r in rows)
    return {r["mask"]: r["n"] for r in rows}, [sum(r[f"s{i}"] for r in rows) / max(1, total) for i in range(len(rules))]


def cascade_order(rules: Sequence[Rule], measured: Measured) -> list[Rule]:
    """Most rejections per second first, each rule's rejections being those of the texts that the rules before it pass."""
    left, seconds = measured
    cost = [2.0 ** round(math.log2(max(s, 1e-9))) for s in seconds]
    order: list[int] = []
    while len(order) < len(rules):
        hits = {i: sum(n for mask, n in left.items() if mask >> i & 1) for i in range(len(rules)) if i not in order}
        best = min(hits, key=lambda i: (-hits[i] / cost[i], cost[i], rules[i].name))
        order.append(best)
        left = {mask: n for mask, n in left.items() if not mask >> best & 1}
    return [rules[i] for i in order]


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, features: Sequence[str] = (), names: dict[str, str] | None = None) -> DataFrame:
    """docs with `kept` (no rule rejects), `rejected_by` (the first rule of the cascade that did) and the features asked for.

    names renames the added columns.
    """
    order = cascade_order(rules, measure(docs, rules))
    features = list(features)

    def make():
        def compute(texts: list) -> list:
            out = [[] for _ in range(2 + len(features))]
            for text in texts:
                f = Features(text)
                by = next((r.name for r in order if r.rejects(f)), None)
                for column, value in zip(out, [by is None, by, *(getattr(f, x) for x in features)], strict=True):
                    column.append(value)
            return out

        return compute

    kinds = [T.BooleanType(), T.StringType(), *[T.LongType()] * len(features)]
    fields = [T.StructField(x, k) for x, k in zip(added(docs, ["kept", "rejected_by", *features], names), kinds, strict=True)]
    return with_text_columns(docs, fields, make)


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of docs that no rule rejects, with the columns of docs."""
    kept, by = fresh("kept", docs), fresh("rejected_by", docs)
    return judge(docs, rules, names={"kept": kept, "rejected_by": by}).where(F.col(kept)).drop(kept, by)
