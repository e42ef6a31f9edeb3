import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from seglume.llm import simhash
from seglume.llm.components import connected
from seglume.storage import stage

DOCS = "doc_id long, text string, fp string, rep int, label string"


def plain(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@given(st.text(alphabet="aAbZ é \n\t\x1c1", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint_is_the_plain_one(text):
    assert simhash.fingerprint(text.encode()) == plain(text)


def components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_components_equal_brute_force(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(60)) for _ in range(12)]
    texts = []
    for i in range(160):
        words = rng.choice(base).split()
        for _ in range(rng.choice((0, 0, 1, 1, 2, 4))):
            words[rng.randrange(len(words))] = rng.choice("xyz") * 3
        texts.append(" ".join(words).upper() if i % 3 == 0 else " ".join(words))
    texts += [None, "", " \n", "one", "ONE ", "two words", "a b"]
    data = [(1000 - i, t, "x", 1, "y") for i, t in enumerate(texts)]
    data.append(data[5])
    got = simhash.near_duplicates(spark.createDataFrame(data, DOCS)).collect()
    assert len(got) == len(data)
    fps = [plain(t) for _, t, *_ in data]
    roots = components(fps)
    least = {r: min(d[0] for d, x in zip(data, roots) if x == r) for r in set(roots)}
    want = sorted((d[0], f"{f:016x}", least[r]) for d, f, r in zip(data, fps, roots))
    assert sorted(map(tuple, got)) == want
    assert len(set(roots)) > 5


@pytest.mark.parametrize("parts", [False, True])
def test_every_pair_within_the_distance_meets(spark, parts):
    rng = random.Random(5)
    fps = {0}
    for _ in range(40):
        f = rng.getrandbits(64)
        fps.add(f)
        for _ in range(6):
            g = f
            for b in rng.sample(range(64), rng.randint(1, 6)):
                g ^= 1 << b
            fps.add(g)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f, f) for f in signed], "fp long, label long")
    got = {tuple(sorted(r)) for r in simhash.links(nodes, parts).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 4}
    assert got == want and want


def test_keep_one(spark):
    text = "a b c d e f g h"
    data = [(3, text, "", 0, ""), (2, text, "", 0, ""), (2, text, "", 0, ""), (9, "other words that stand alone here", "", 0, "")]
    got = simhash.keep_one(spark.createDataFrame(data, DOCS))
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(2, text), (9, "other words that stand alone here")]
    assert got.columns == ["doc_id", "text", "fp", "rep", "label"]
    assert simhash.keep_one(spark.createDataFrame([], DOCS)).count() == 0


def test_keep_one_with_null_and_repeated_ids(spark):
    texts = [" ".join(f"{w}{i}" for w in "kilo lima mike nova oscar papa quebec romeo".split()) for i in range(6)]
    ids = [None, None, None, 4, 4, 7]
    data = [(i, t, "", 0, "") for i, t in zip(ids, texts)] + [(None, texts[3], "", 0, ""), (None, texts[0], "", 0, ""), (3, texts[5], "", 0, "")]
    got = sorted(((r.doc_id, r.text) for r in simhash.keep_one(spark.createDataFrame(data, DOCS)).collect()), key=str)
    assert got == sorted([*zip(ids[:5], texts[:5]), (3, texts[5])], key=str)


def shingles(text, k=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def similar_groups(texts):
    """Components of texts with a Jaccard similarity of 0.8 or more, by brute force: the first index of each text's."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x == y or (min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y)):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def test_keep_one_of_near_copies(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    base = [[word() for _ in range(n)] for n in (30, 60, 120, 200, 200, 400)]
    texts = [None, "", "one", "ONE", "one two three four", "x " * 300]
    for words in base:
        for _ in range(25):  # dense groups, chains among them, and copies that are too far
            copy = list(words)
            for _ in range(rng.choice((0, 1, len(words) // 100, len(words) // 50, len(words) // 40, len(words) // 12))):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    order = list(range(len(texts)))
    rng.shuffle(order)
    data = [(i, texts[k], "", 0, "") for i, k in enumerate(order)]
    roots = similar_groups([d[1] for d in data])
    assert 12 < len(set(roots)) < len(data) / 2
    got = sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(data, DOCS)).collect())
    assert got == sorted(set(roots))


def test_a_class_with_many_partners_meets_them_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "_PARTNERS", 4)
    words = [f"w{i}" for i in range(300)]
    data = [(i, " ".join(words[:i] + [f"new{i}"] + words[i + 1 :]), "", 0, "") for i in range(30)] + [(99, " ".join(words), "", 0, "")]
    assert [r.doc_id for r in simhash.keep_one(spark.createDataFrame(data, DOCS)).collect()] == [0]


def test_sketches_keep_the_pairs_of_copies_and_drop_others(spark):
    """Of pairs between 0.80 and 0.85 at least 0.99 pass, of those under 0.5 none."""
    rng, p = random.Random(4), simhash.CopyParams()
    kept = []
    for i in range(600):
        words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        copy = list(words)
        for k in range(0, 120, 40 if i % 2 else 6):  # each change turns five shingles
            copy[k + rng.randrange(6 if i % 2 == 0 else 40)] = "x"
        sets = [np.unique(np.concatenate(list(simhash.shingle_hashes(" ".join(w).encode(), p.size)))) for w in (words, copy)]
        x, y = (simhash.minima(s, p).astype(np.uint8) for s in sets)
        common = len(np.intersect1d(*sets))
        kept.append((common / (len(sets[0]) + len(sets[1]) - common), (x == y).mean() >= p.estimate))
    near = [k for j, k in kept if 0.75 <= j <= 0.9]
    far = [k for j, k in kept if j < 0.5]
    assert len(near) > 100 and np.mean(near) >= 0.99 and len(far) > 100 and not any(far)


def test_copies_that_are_not_similar_make_no_pairs(spark, monkeypatch):
    """A large group of copies with changes of their own, each some 0.7 like the next: shared buckets alone made nearly all
    pairs of them, of which none is similar. What is similar among them is found all the same."""
    rng, seen = random.Random(3), []
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(150):
        copy = list(base)
        for k in range(3):
            copy[20 + 40 * k + rng.randrange(12)] = f"new{i}x{k}"
        texts.append(" ".join(copy))
        if i % 10 == 0:  # one word more at the end
            texts.append(" ".join([*copy, "more"]))
    alike = simhash._alike

    def counted(pairs, *rest):
        seen.append(pairs.distinct().count())
        return alike(pairs, *rest)

    monkeypatch.setattr(simhash, "_alike", counted)
    data = [(i, t, "", 0, "") for i, t in enumerate(texts)]
    got = sorted(r.doc_id for r in simhash.keep_one(spark.createDataFrame(data, DOCS)).collect())
    assert got == sorted(set(similar_groups(texts)))
    assert len(got) == 150 and seen[1] < 10 * len(texts)


def test_no_join_goes_through_the_driver(spark):
    """Whatever Spark thinks of the sizes, nothing that grows with the table is broadcast, and few links are one task."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(1 << 30))
    try:
        docs = spark.createDataFrame([(i, f"w{i // 3} a b c d") for i in range(60)], "doc_id long, text string")
        plan = simhash.near_duplicates(docs)
        assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()
        links = spark.createDataFrame([(i, i + 1) for i in range(50) if i % 10 < 9], "a long, b long")
        found = connected(spark.range(60).toDF("node"), links, "test-chain")
        assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
        assert {r.node: r.label for r in found.collect()} == {i: i // 10 * 10 if i < 50 else i for i in range(60)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("parts", [False, True])
def test_variants_are_not_broadcast(spark, parts):
    """Variants are some 35 rows of each fingerprint, but Spark takes them for as small as the fingerprints."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(1 << 30))
    try:
        nodes = stage(spark.range(100).selectExpr("id * 7 as fp", "id as label"), "test-labels")
        found = simhash.links(nodes, parts)
        assert found.count() > 0
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
