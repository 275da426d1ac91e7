"""SimHash near-dedup with a pigeonring filter (operator 6), and near-dedup by an exact similarity of shingles.

A text is lower-cased in A-Z and cut into words; every shingle of `words` words, repeats included, is hashed by XXH64
with seed 42; bit b of the fingerprint is set if more than half the hashes have it. Texts whose fingerprints differ in
at most `distance` bits are linked, and a component is what links reach (near_groups).

Candidates: the 64 bits form a ring of distance + 1 segments. If two fingerprints differ in at most d bits there is a
segment from which every chain of 1, 2, ... consecutive segments differs in at most floor(length * d / segments) bits;
its first segment is then equal. So fingerprints are joined on (segment number, segment value), and a pair goes on to
the full Hamming check only if the chain from that segment stays within every budget.

Equal fingerprints meet in one row before any of this. A segment value shared by more than BUCKET fingerprints is not
paired off, and nothing in it is skipped either: two fingerprints at distance 2 or less share a word within one bit of
both, so each emits the words within one bit of it (outside the equal segment) and is linked to the least fingerprint
of each word, a number of rows in proportion to the bucket. Links of both kinds lead to the same components.

A fingerprint estimates a similarity, and a stage that must find every pair of a Jaccard similarity of 0.8 and no other can't
decide by it alone. similar_rows() groups texts by their fingerprints as above, compares the sets of shingles of what these
link, and finds the pairs that the fingerprints don't reach by an exact prefix filter, bounded by bitmaps.

Defined results: a null text is like an empty one, fingerprint zero, linked like any other. A null doc_id counts as the
largest: it names a component only if no other does. Rows with equal doc_id each get a row, repeated rows one each. A very
long text is taken whole, its hashes counted in parts. An empty table gives an empty result. Other columns of the input stay
out of the way: results carry doc_id and the columns named here.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spalt.llm.common import fresh, materialize, run_hashes, with_row_key, with_text_columns, word_hashes

SEED = 42
#: Fingerprints with one segment value that are still compared pair by pair; beyond it, the exact way by shared words.
BUCKET = 64
#: Parts that a node's edges are dealt to, so that a hub is no single task.
SALTS = 64
_SPACE = [9, 10, 11, 12, 13, 32]
_WORD = ~np.isin(np.arange(256), _SPACE)


def fingerprint(text: str | None, words: int = 3) -> int:
    import xxhash

    tokens = (text or "").encode().lower().split()  # bytes: A-Z only, and white space is exactly \x20 and \x09-\x0D
    if not tokens:
        return 0
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), SEED)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-words] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are set in more than half of the hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[i : i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""

    def make():
        def compute(texts: list) -> list:
            return [pa.array(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))]

        return compute

    slot = fresh("fp", docs.select("doc_id"))
    return with_text_columns(docs.select("doc_id", "text"), [T.StructField(slot, T.LongType())], make, keep=["doc_id"])


def segments(n: int) -> list[tuple[int, int]]:
    """(first bit, bits) of n segments that cover 64 bits."""
    cuts = [round(64 * i / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def mask(first: int, bits: int) -> int:
    """The segment's bits as a signed number."""
    m = ((1 << bits) - 1) << first
    return m - (1 << 64) if m >= 1 << 63 else m


def within_chain(x: Column, y: Column, start: int, distance: int) -> Column:
    """All chains of consecutive segments from `start` stay within their proportional budgets."""
    parts = segments(distance + 1)
    n = len(parts)
    total, ok = F.lit(0), F.lit(True)
    for length in range(1, n + 1):
        total = total + F.bit_count(x.bitwiseXOR(y).bitwiseAND(F.lit(mask(*parts[(start + length - 1) % n]))))
        ok = ok & (total <= length * distance // n)
    return ok


def links(prints: DataFrame, distance: int = 2, bucket: int = BUCKET) -> DataFrame:
    """(a, b), a <> b: pairs of fingerprints at `distance` bits or fewer whose components are those of all such pairs.

    prints: distinct fingerprints in a column fp.
    """
    if distance > 2:
        raise ValueError("words within one bit of both exist for distances up to 2")
    parts = segments(distance + 1)
    keyed = prints.select("fp", F.explode(F.array(*(F.struct(F.lit(i).alias("seg"), F.col("fp").bitwiseAND(F.lit(mask(*p))).alias("val")) for i, p in enumerate(parts)))).alias("k")).select("fp", "k.seg", "k.val")
    sizes = keyed.groupBy("seg", "val").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    keyed = materialize(keyed.join(sizes, ["seg", "val"]), "segments")

    small = keyed.where(F.col("n") <= bucket)
    x, y = small.select("seg", "val", F.col("fp").alias("a")), small.select("seg", "val", F.col("fp").alias("b"))
    chained = F.lit(False)
    for i in range(len(parts)):
        chained = chained | ((F.col("seg") == i) & within_chain(F.col("a"), F.col("b"), i, distance))
    pairs = x.join(y, ["seg", "val"]).where(F.col("a") < F.col("b")).where(chained).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b")

    one_bit = F.array(F.lit(0).cast("long"), *(F.lit(mask(i, 1)) for i in range(64)))
    of_segment = F.lit(0).cast("long")
    for i, p in enumerate(parts):
        of_segment = F.when(F.col("seg") == i, F.lit(mask(*p))).otherwise(of_segment)
    near = keyed.where(F.col("n") > bucket).select("fp", F.explode(F.filter(one_bit, lambda m: m.bitwiseAND(of_segment) == 0)).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("word")).distinct()
    least = near.groupBy("word").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("word", "a")
    stars = near.join(least, "word").where(F.col("fp") != F.col("a")).select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def with_least(pairs: DataFrame) -> DataFrame:
    """(u, v, m) of pairs (u, v): m is the least v of u. A u that a large share of the rows has is SALTS keys."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    cells = salted.groupBy("u", "salt").agg(F.min("v").alias("cell"))
    low = cells.groupBy("u").agg(F.min("cell").alias("m"))
    return salted.join(cells.select("u", "salt").join(low, "u"), ["u", "salt"]).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each component with an edge, by alternating large-star and small-star steps.

    Each step is a group-by with partial minima and a join back, and is written to the shared folder; the steps end
    when the sum of what they wrote no longer changes. a, b: long columns without nulls.
    """
    edges = materialize(edges.select("a", "b").where("a <> b"), "edges")
    before = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = with_least(both).where("v > u").select(F.least("u", "m").alias("a"), F.col("v").alias("b")).distinct()
        large = materialize(large, "large")
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        small = with_least(down).select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b")).where("a <> b").distinct()
        edges = materialize(small, "small")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = now


def linked(prints: DataFrame, distance: int = 2, bucket: int = BUCKET) -> DataFrame:
    """prints and `root`, the least fingerprint of what links reach from fp; prints: distinct fingerprints in a column fp."""
    roots = components(links(prints.select("fp"), distance, bucket))
    return materialize(prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(*prints.columns, F.coalesce("root", "fp").alias("root")), "roots")


def near_groups(docs: DataFrame, words: int = 3, distance: int = 2, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id of what links reach from the row."""
    prints = materialize(fingerprints(docs, words), "prints")
    least = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    of_print = linked(least, distance, bucket)
    of_root = materialize(of_print.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    named = materialize(of_print.join(of_root, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def shingle_sets(texts: Sequence[str | None], words: int = 5) -> Iterator[np.ndarray]:
    """Of each text the distinct hashes of its shingles in order; a text of fewer words has one shingle, one without words none."""
    hashes, starts = word_hashes([(t or "").encode().lower() for t in texts], _WORD)
    every = run_hashes(hashes, words)
    for a, b in zip(starts.tolist(), starts[1:].tolist(), strict=False):
        found = every[a : b - words + 1] if b - a >= words else run_hashes(hashes[a:b], b - a)[: b - a]
        yield np.unique(found.view(np.int64))


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    return next(shingle_sets([text], words))


def set_number(found: np.ndarray) -> int:
    """A signed number that stands for a set of shingles."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).astype(np.int64))


#: Texts of the sample that finds common shingles, and in how many of them a shingle must be.
SAMPLE, COMMON = 8_000, 8
#: Words of 64 bits of a bitmap, and of the wide one that pairs meet before their sets.
BITMAP, WIDE = 4, 64


def bitmap(found: np.ndarray, size: int = BITMAP) -> np.ndarray:
    """Whether an odd number of the set's hashes falls on each of the bits: two sets differ in as many hashes as bits, or more."""
    odd = np.bincount((found.view(np.uint64) >> np.uint64(59 - size.bit_length())).astype(np.int64), minlength=64 * size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefix(found: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The set's first hashes, of which sets of that similarity share one: those of few texts before common ones."""
    if not len(found):
        return found
    keys, counts = common
    rank = np.zeros(len(found), np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
        rank = np.where(keys[at] == found, counts[at], 0)
    return found[np.lexsort((found, rank))[: len(found) - math.ceil(similarity * len(found) - 1e-9) + 1]]


def common_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, counts) of shingles that many texts of a sample hold. Results don't depend on it: any order of hashes is right."""
    few = docs.select("text").sample(False, min(1.0, SAMPLE / max(1, docs.count())), SEED)
    made = with_text_columns(few, [T.StructField("found", T.ArrayType(T.LongType()))], lambda: lambda texts: [pa.array(list(shingle_sets(texts, words)), pa.list_(pa.int64()))], keep=[])
    rows = made.select(F.explode("found").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON).orderBy("key").toArrow()
    return rows["key"].to_numpy(), rows["n"].to_numpy()


def alike(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, similarity: float, words: int) -> DataFrame:
    """(a, b) of the pairs of nodes whose sets of shingles have an exact Jaccard similarity of `similarity` or more.

    nodes: (node, row), a row of docs with that node's set. Sets are made again for the texts that are in a pair, and
    are never stored for the others.
    """
    pairs = materialize(pairs, "candidates")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()

    def make():
        def compute(texts: list) -> list:
            found = list(shingle_sets(texts, words))
            return [[set_number(x) for x in found], pa.array(found, pa.list_(pa.int64()))]

        return compute

    wanted = asked.join(nodes.hint("merge"), "node").select(F.col("row").alias("wanted"))
    texts = docs.join(wanted.hint("merge"), F.col("row") == F.col("wanted"), "left_semi").select("text")
    sets = with_text_columns(texts, [T.StructField("node", T.LongType()), T.StructField("found", T.ArrayType(T.LongType()))], make, keep=[])
    sets = materialize(sets, "sets")
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("found").alias(f"{side}_found")).hint("merge"), side)
    both = F.size(F.array_intersect("a_found", "b_found"))
    return pairs.where(both * (1 + similarity) >= (F.size("a_found") + F.size("b_found")) * similarity - 1e-9).select("a", "b")


def similar_rows(docs: DataFrame, words: int = 5, similarity: float = 0.8, distance: int = 2) -> DataFrame:
    """(row, least): the key of each row, and of the first row of its group; docs (row, text), with row from with_row_key().

    Groups are the components of all pairs whose sets of shingles have that Jaccard similarity or more. Sets in one
    order of all hashes that are so similar have a hash in common among the first of each (prefix()), so no pair is
    left out. Equal sets are one node. First the nodes' SimHash fingerprints are linked through the pigeonring filter, and
    each node's set is compared with that of the least node that its fingerprint reaches. Then each node meets the least one
    of each of its hashes that the fingerprints have not joined with it, and what all these links join is one component; then
    only nodes of different components meet, so that a large group of near copies is joined through its least members and
    never paired off. The sizes of two sets, the places of the hash and the sets' bitmaps
    bound the similarity from above, so that few pairs are left whose sets must be compared.
    """
    held = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, words))
    bits = [f"b{i}" for i in range(BITMAP)]

    def make():
        common = held.value

        def compute(texts: list) -> list:
            found = list(shingle_sets(texts, words))
            maps = np.array([bitmap(x) for x in found]).reshape(-1, BITMAP)
            prints = np.array([majority(x.view(np.uint64)) for x in found], np.uint64).view(np.int64)
            return [[set_number(x) for x in found], [len(x) for x in found], pa.array(prints), *(pa.array(maps[:, i]) for i in range(BITMAP)), pa.array([prefix(x, similarity, common) for x in found], pa.list_(pa.int64())), pa.array([bitmap(x, WIDE) for x in found], pa.list_(pa.int64()))]

        return compute

    fields = [T.StructField("node", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("fp", T.LongType()), *(T.StructField(b, T.LongType()) for b in bits), T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("wide", T.ArrayType(T.LongType()))]
    prints = materialize(with_text_columns(docs, fields, make, keep=["row"]), "prints")
    # a null doc_id comes after all others
    nodes = materialize(prints.groupBy("node").agg(F.min(F.struct(F.col("row.doc_id").isNull().alias("none"), "row")).alias("first"), *(F.min(c).alias(c) for c in ("size", "fp", *bits))), "nodes")
    rows_of = nodes.select("node", "first.row")
    wides = materialize(prints.groupBy("node").agg(F.first("size").alias("size"), F.first("wide").alias("wide")), "wides")

    def close(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b), each once, whose wide bitmaps leave the similarity open."""
        pairs = materialize(pairs.distinct(), "pairs")
        for side in "ab":
            pairs = pairs.join(wides.select(F.col("node").alias(side), F.col("size").alias(f"{side}_size"), F.col("wide").alias(f"{side}_wide")).hint("merge"), side)
        apart = F.aggregate(F.zip_with("a_wide", "b_wide", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
        return pairs.where(apart * (1 + similarity) <= (F.col("a_size") + F.col("b_size")) * (1 - similarity) + 1e-9).select("a", "b")

    of_print = linked(materialize(nodes.select("fp").distinct(), "distinct"), distance)
    reached = with_least(materialize(nodes.select("node", "fp").join(of_print.hint("merge"), "fp").select(F.col("root").alias("u"), F.col("node").alias("v")), "linked"))
    by_print = reached.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    by_print = materialize(alike(close(by_print), rows_of, docs, similarity, words), "by_print")
    joined = nodes.join(by_print.select(F.col("a").alias("node"), F.col("b").alias("joined")).hint("merge"), "node", "left")
    marks = materialize(joined.select("node", F.coalesce("joined", "node").alias("joined"), "size", *bits), "marks")

    keyed = prints.select("node", F.posexplode("prefix").alias("at", "key"))
    heads = keyed.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head <> last").select("key", "head")
    heads = materialize(heads, "heads")
    found = materialize(keyed.join(heads.hint("merge"), "key").distinct(), "found")

    def may_be(x: str, y: str) -> Column:
        """The bitmaps and sizes of two nodes leave the similarity open."""
        total = F.col(f"{x}size") + F.col(f"{y}size")
        apart = sum((F.bit_count(F.col(f"{x}{b}").bitwiseXOR(F.col(f"{y}{b}"))) for b in bits), F.lit(0))
        return (F.least(f"{x}size", f"{y}size") * (1 + similarity) >= total * similarity - 1e-9) & (apart * (1 + similarity) <= total * (1 - similarity) + 1e-9)

    def marked(rows: DataFrame, side: str) -> DataFrame:
        return rows.join(marks.select(F.col("node").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in ("joined", "size", *bits))).hint("merge"), side)

    first = found.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    first = marked(marked(first, "a"), "b").where("a_joined <> b_joined").where(may_be("a_", "b_")).select("a", "b")
    first = materialize(by_print.unionByName(alike(close(first), rows_of, docs, similarity, words)), "first")
    part_of = materialize(nodes.select("node").join(components(first).hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("part")), "parts")

    placed = materialize(found.join(part_of.hint("merge"), "node"), "placed")
    open_keys = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key")
    main = part_of.select(F.col("node").alias("head"), F.col("part").alias("main"))
    left = placed.join(materialize(open_keys, "open").hint("merge"), "key").join(main.hint("merge"), "head")

    def side(x: str, *more: str) -> DataFrame:
        return marked(left.select("key", F.col("node").alias(x), F.col("part").alias(f"{x}_part"), F.col("at").alias(f"{x}_at"), "main"), x).select("key", x, f"{x}_part", f"{x}_at", *(f"{x}_{c}" for c in ("size", *bits)), *more)

    # the main component of a hash never meets itself
    others, there = side("a", "main").where("a_part <> main"), side("b")
    ahead = F.least(F.col("a_size") - F.col("a_at"), F.col("b_size") - F.col("b_at")) * (1 + similarity) >= (F.col("a_size") + F.col("b_size")) * similarity - 1e-9
    met = (F.col("a_part") != F.col("b_part")) & ((F.col("b_part") == F.col("main")) | (F.col("a") < F.col("b"))) & ahead & may_be("a_", "b_")
    across = materialize(others, "others").alias("o").join(materialize(there, "there").hint("merge"), "key").where(met).select("a", "b")
    second = alike(close(across), rows_of, docs, similarity, words)
    named = nodes.join(components(first.unionByName(second)).hint("merge"), "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    named = materialize(named, "roots")
    least = materialize(named.groupBy("root").agg(F.min("first").alias("least")), "components")
    named = materialize(named.join(least.hint("merge"), "root").select("node", "least.row"), "named")
    return prints.select("node", F.col("row").alias("own")).join(named.hint("merge"), "node").select(F.col("own").alias("row"), F.col("row").alias("least"))


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id): the least doc_id of the row's group in similar_rows()."""
    groups = similar_rows(with_row_key(docs.select("doc_id", "text"), "row").select("row", "text"), words, similarity)
    return groups.select("row.doc_id", F.col("least.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of similar_rows(): that of the least doc_id, a row without one coming last."""
    row, out = fresh("row", docs), fresh("out", docs)
    keyed = with_row_key(docs, row)
    groups = similar_rows(keyed.select(F.col(row).alias("row"), "text"), words, similarity)
    gone = materialize(groups.where("row <> least").select(F.col("row").alias(out)), "copies")
    return keyed.join(gone.hint("merge"), F.col(row) == F.col(out), "left_anti").drop(row)
