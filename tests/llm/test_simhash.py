import random
import re

import xxhash

from spalt.llm import simhash
from tests.llm.conftest import LONG


def brute_print(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """doc_id -> least doc_id reached, of {doc_id: fingerprint}."""
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


TEXTS = [None, "", "  \n", "One", "one TWO", "a b c", "A B C", "É é b", "x y z w", LONG, "z z z z z z"]


def test_fingerprints_match_brute_force(documents):
    got = {r.doc_id: r.fp & (1 << 64) - 1 for r in simhash.fingerprints(documents(TEXTS)).collect()}
    assert got == {i: brute_print(t) for i, t in enumerate(TEXTS)}


def near(rng, n, clusters):
    out = []
    for _ in range(clusters):
        x = rng.getrandbits(64)
        for _ in range(n):
            out.append(x)
            for _ in range(rng.randrange(4)):
                x ^= 1 << rng.randrange(64)
    return out


def test_links_lead_to_all_components(spark):
    values = near(random.Random(1), 12, 30) + [0, 1, 3, 7, (1 << 64) - 1, (1 << 63)]
    signed = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    true = brute_components({v: v & (1 << 64) - 1 for v in signed})
    for bucket in (64, 3, 0):  # pairs alone, both ways, shared words alone
        links = [(r.a, r.b) for r in simhash.links(df, bucket=bucket).collect()]
        assert bucket or links
        got = {r.node: r.root for r in simhash.components(simhash.links(df, bucket=bucket)).collect()}
        assert {v: got.get(v, v) for v in signed} == true


def test_groups_and_copies(documents):
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join(base), " ".join(base), " ".join([*base[:-1], "new"]), "all other words are here", None, "", " ".join(base)]
    ids = [9, 5, 7, 3, 8, 6, 5]
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_groups(documents(texts, ids)).collect())
    prints = [brute_print(t) for t in texts]
    true = brute_components(dict(zip(range(len(ids)), prints, strict=True)))
    least = {}
    for i, root in true.items():
        least[root] = min(least.get(root, 99), ids[i])
    assert got == sorted((ids[i], least[root]) for i, root in true.items())


def brute_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_similar(texts):
    """{doc_id: text} -> least doc_id reached by links of a similarity of 0.8 or more, every two texts compared; equal sets are linked."""
    sets = {d: brute_shingles(t) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or (x and y and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) - 1e-9 and len(x & y) >= 0.8 * len(x | y) - 1e-9):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d: find(d) for d in ids}


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_similar_groups_match_brute_force_and_find_near_copies(documents):
    rng = random.Random(5)
    texts, family = [], []
    for f in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(120, 400))]
        for k in range(8):
            texts.append(edited(words, rng.randrange(len(words) // 60 + 1) if k else 0, rng))
            family.append(f)
    texts += ["", None, "one", "one two three four five", LONG[:3000]]
    family += [100, 100, 101, 102, 103]
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(documents(texts)).collect()}
    assert got == brute_similar(dict(enumerate(texts)))
    first = {f: family.index(f) for f in family}
    assert [got[i] for i in range(len(texts))] == [first[f] for f in family]


def test_every_planted_near_copy_is_found(spark, small):
    """Copies of the given texts with some words changed: those of 0.8 and more go, those of less stay, whatever their texts."""
    rng = random.Random(9)
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect() if r.text and 80 < len(r.text.split()) < 2000][:120]
    base = len(texts)
    for t in texts[:base]:
        texts.append(edited(t.split(" "), rng.randrange(1, max(2, len(t.split(" ")) // 30)), rng))
    want = brute_similar(dict(enumerate(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()} == want
    assert sum(want[base + i] == want[i] for i in range(base)) > 30


def test_one_stays_of_each_group(documents):
    text = " ".join(f"w{i}" for i in range(300))
    docs = documents([text, text, "another text with other words in it", None, ""], [4, 2, 3, 1, None]).selectExpr("*", "1 AS fp", "2 AS component_id", "3 AS f0", "4 AS node")
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 2, 3]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_rows_without_an_id_of_their_own_are_decided_one_by_one(documents):
    one, two = (" ".join(f"{c}{i}" for i in range(100)) for c in "vw")
    for ids, kept in (([1, None, None, None], [one, two]), ([5, 5, 5, 5], [one, two]), ([None] * 4, [one, two])):
        assert sorted(r.text for r in simhash.keep_one(documents([one, one, two, two], ids)).collect()) == kept


def test_query(spark, small):
    from spalt.llm.queries import QUERIES

    rows = QUERIES["op6_simhash_dedup"](spark, small).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    prints = {d: brute_print(t) for d, t in texts.items()}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {d: (f"{prints[d]:016x}", c) for d, c in brute_components(prints).items()}


def jaccard(a, b):
    a, b = (set(simhash.shingles(t).tolist()) for t in (a, b))
    return len(a & b) / len(a | b)


def test_texts_below_the_similarity_stay_apart(documents):
    rng = random.Random(8)
    texts = []
    for _ in range(20):  # pairs of a similarity of about 0.7
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        texts += [" ".join(words), " ".join([*words[:246], *(f"x{rng.randrange(10**6)}" for _ in range(54))])]
    for _ in range(10):  # nothing in common but a phrase that each repeats
        texts += [" ".join(["one phrase said once more"] * 10 + [f"w{rng.randrange(10**6)}" for _ in range(50)]) for _ in range(2)]
    assert all(jaccard(*texts[i : i + 2]) < 0.75 for i in range(0, len(texts), 2))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(documents(texts)).collect()}
    assert got == {i: i for i in range(len(texts))}


def test_no_pair_of_the_similarity_is_left_out(documents):
    rng = random.Random(2)
    texts = []
    while len(texts) < 400:  # isolated pairs just above the similarity
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        k = rng.randrange(24, 34)
        pair = [" ".join(words), " ".join([*words[: 300 - k], *(f"x{rng.randrange(10**6)}" for _ in range(k))])]
        if 0.8 <= jaccard(*pair) < 0.83:
            texts += pair
    texts += ["a b c d e f g h i", "a b c d e f g h", "b c d e f g h i"]  # 4 of 5 shingles: 0.8 exactly
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(documents(texts)).collect()}
    assert [got[i] for i in range(400)] == [i - i % 2 for i in range(400)]
    assert [got[i] for i in range(400, 403)] == [400] * 3


def test_common_shingles_and_chains(documents, monkeypatch):
    rng = random.Random(4)
    line = " ".join(f"c{i}" for i in range(40))
    texts = []
    for _ in range(6):  # a chain: each text is like the one before it alone
        words = [f"w{rng.randrange(10**6)}" for _ in range(160)]
        for k in range(10):
            words[16 * k : 16 * k + 16] = [f"x{rng.randrange(10**6)}" for _ in range(16)]
            texts.append(line + " " + " ".join(words))
    texts += [f"{line} {i}" for i in range(30)] + [line + " " + " ".join(f"y{rng.randrange(10**6)}" for _ in range(50)) for _ in range(30)]
    root = list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    for common in (8, 10**9):
        monkeypatch.setattr(simhash, "COMMON", common)
        got = {r.doc_id: r.component_id for r in simhash.similar_groups(documents(texts)).collect()}
        assert got == {i: find(i) for i in range(len(texts))}


def test_similar_groups_link_fingerprints_and_compare_sets(documents, monkeypatch):
    rng = random.Random(6)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(600)] for _ in range(30)]
    texts = [" ".join(w) for w in base] + [" ".join([*w[:-1], "new"]) for w in base] + ["a b c", "", None, "d e f"]
    want, calls, real = brute_similar(dict(enumerate(texts))), [], simhash.links

    def counted(prints, *args):
        found = real(prints, *args)
        calls.append(found.count())
        return found

    def wrong(prints, *args):  # all are linked
        return prints.crossJoin(prints.agg(simhash.F.min("fp").alias("a"))).where("fp <> a").selectExpr("a", "fp AS b")

    def none(prints, *args):  # the exact way finds the pairs that no fingerprint reaches
        return prints.selectExpr("fp AS a", "fp AS b").limit(0)

    for links in (counted, wrong, none):
        monkeypatch.setattr(simhash, "links", links)
        assert {r.doc_id: r.component_id for r in simhash.similar_groups(documents(texts)).collect()} == want
    assert len(calls) == 1 and calls[0] >= 10


def test_majority_of_a_set(spark):
    for text in (None, "", "one two", "a b c d e f g h", LONG[:2000]):
        found = simhash.shingles(text).view(simhash.np.uint64).tolist()
        assert simhash.majority(simhash.shingles(text).view(simhash.np.uint64)) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))
