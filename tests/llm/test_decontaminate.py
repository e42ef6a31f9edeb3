import random

import numpy as np
import pyarrow as pa

from seglume.llm import decontaminate as leaks
from seglume.llm.textbytes import buffers, hash_words

DOCS = "doc_id long, text string, item_id long, block int, cosine double"


def made():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    common = ["the", "of", "and", "to"]
    prose = lambda n: [rng.choice(common) if rng.random() < 0.4 else word() for _ in range(n)]
    items = [prose(rng.choice((9, 15, 30, 60, 150))) for _ in range(30)]
    docs, want = [], set()
    for i in range(200):
        text = prose(rng.randint(5, 300))
        if i % 4 == 0:
            k = i % 30
            passage = items[k][:60]
            if i % 8 == 0:  # every sixth word replaced
                passage = [word() if j % 6 == 2 else w for j, w in enumerate(passage)]
            at = rng.randint(0, len(text))
            text[at:at] = [w.upper() + "," for w in passage]
            want.add((i, k))
        docs.append((i, " ".join(text)))
    return docs, items, want


def test_planted_passages_are_found_and_no_others(spark):
    docs, items, want = made()
    data = [(*d, 1, 2, 0.5) for d in docs]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(90, None), (91, "too short"), (None, "the of and to " * 5)], "item_id long, text string")
    small = leaks.LeakParams(block=8, broadcast_bytes=30_000)
    for p in (leaks.LeakParams(), small):
        got = {(r.doc_id, r.item_id) for r in leaks.matches(spark.createDataFrame(data, DOCS), bench, params=p).collect()}
        assert got == want
    kept = leaks.keep_clean(spark.createDataFrame(data, DOCS), bench)
    assert kept.columns == ["doc_id", "text", "item_id", "block", "cosine"]
    assert {r.doc_id for r in kept.collect()} == set(range(200)) - {d for d, _ in want}


def test_edges(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    bench = spark.createDataFrame([(1, item), (1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(5, None, 0, 0, 0.0), (5, item, 0, 0, 0.0), (5, item, 0, 0, 0.0), (None, "x " * 60_000 + item, 0, 0, 0.0), (7, "", 0, 0, 0.0)], DOCS)
    assert sorted(str((r.doc_id, r.item_id)) for r in leaks.matches(docs, bench).collect()) == ["(5, 1)", "(5, 1)", "(None, 1)"]
    assert [r.doc_id for r in leaks.keep_clean(docs, bench).collect()] == [7]
    assert leaks.matches(docs.limit(0), bench).count() == 0 and leaks.matches(docs, bench.limit(0)).count() == 0


def test_lcs():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(1, 70))] for _ in range(2))
        masks = {}
        for i, w in enumerate(a):
            masks[w] = masks.get(w, 0) | 1 << i
        assert leaks.lcs(masks, len(a), b) == plain(a, b)


def test_latent_space_is_that_of_a_whole_decomposition(spark):
    rng, p = np.random.default_rng(0), leaks.LeakParams(bins=200, rank=6, oversample=6)
    low = np.abs(rng.normal(size=(90, 6))) @ np.abs(rng.normal(size=(6, 200)))
    low *= rng.random(low.shape) < 0.9
    rows = [([int(j) for j in np.flatnonzero(r)], [float(x) for x in r[r > 0]]) for r in low] + [([], [])]
    space = leaks.latent_space(spark.createDataFrame(rows, "bins array<int>, weights array<float>").repartition(3), p)
    value, vector = np.linalg.svd(low)[1:]
    assert np.allclose(space.T @ space, np.eye(6), atol=1e-4)
    caught = np.linalg.norm(low @ space, axis=0)
    assert np.allclose(np.sort(caught)[::-1][:3], value[:3], rtol=0.02)
    assert abs(abs(space[:, 0] @ vector[0]) - 1) < 1e-3


def test_rows_of_the_fit_are_tf_idf_of_length_one():
    p = leaks.LeakParams(bins=1 << 15)
    idf = np.linspace(0.1, 3, p.bins).astype(np.float32)
    words = [f"w{i % 37}" for i in range(150)]
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(words), "", None, "w1 w1 w2"])], names=["text"])
    got = pa.table(next(leaks._fit_rows(idf, p)(iter([batch])))).to_pylist()
    want = []
    for part in (words[:64], words[64:128], words[128:], ["w1", "w1", "w2"]):
        row = {}
        for w in part:
            k = int(hash_words([w])[0] % np.uint64(p.bins))
            row[k] = row.get(k, 0) + float(idf[k])
        norm = sum(x * x for x in row.values()) ** 0.5
        want.append({k: x / norm for k, x in row.items()})
    assert len(got) == 4
    for g, w in zip(got, want):
        assert dict(zip(g["bins"], g["weights"])).keys() == w.keys() and all(abs(x - w[k]) < 1e-5 for k, x in zip(g["bins"], g["weights"]))


def test_paraphrases_by_other_words_are_found_in_the_latent_space(spark):
    """Items told with synonyms: under half of the words in order, so neither counts nor the plain cosine find them."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    concepts = [[word() for _ in range(4)] for _ in range(240)]
    topics = [concepts[12 * i : 12 * i + 12] for i in range(20)]
    say = lambda topic, n: [rng.choice(rng.choice(topic)) for _ in range(n)]
    docs, items, planted = [], [], set()
    for i in range(500):
        docs.append((i, " ".join(say(topics[i % 20], 150)), 0, 0, 0.0))
    for k in range(20):
        told, answer = [(c := rng.choice(topics[k]), rng.choice(c)) for _ in range(28)], [word() for _ in range(7)]
        item = [w for _, w in told] + answer
        items.append((k, " ".join(item)))
        same = set(rng.sample(range(28), 8))
        other = [w if j in same else rng.choice([x for x in c if x != w]) for j, (c, w) in enumerate(told)] + answer
        i = 25 * k + 25 - 1
        docs[i] = (i, " ".join(say(topics[k], 40) + other + say(topics[k], 30)), 0, 0, 0.0)
        planted.add((i, k))
        a, b = (np.array([v.count(w) for w in sorted({*item, *other})]) for v in (item, other))
        assert a @ b / (a @ a * (b @ b)) ** 0.5 < leaks.LeakParams().cosine  # by plain counts no candidate
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = leaks.matches(spark.createDataFrame(docs, DOCS), bench, params=leaks.LeakParams(rank=20)).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert len(got & planted) >= 0.9 * len(planted) and got <= planted
    assert sum(r.lcs_share < 0.5 for r in rows) >= 0.5 * len(planted)
    assert not leaks.matches(spark.createDataFrame(docs, DOCS), bench, params=leaks.LeakParams(rank=20, cosine=2.0)).where("lcs_share < 0.5").count()


def test_an_item_in_a_third_of_all_rows_and_short_items_are_found(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    hot, few, short = [word() for _ in range(20)], "so it is as it was so it is as it was so it is as it was".split(), ["zu", "zv", "zw"]
    docs, want = [], set()
    for i in range(300):
        text = [rng.choice(("so", "it", "is", "as", "was")) if rng.random() < 0.4 else word() for _ in range(rng.randint(5, 120))]
        put = []
        if i % 3 == 0:  # the item itself, and with every fifth word replaced
            put += [(1, hot if i % 2 else [word() if j % 5 == 2 else w for j, w in enumerate(hot)])]
        if i % 25 == 1:
            put += [(2, few)]
        if i % 25 == 2:
            put += [(3, short)]
        if i % 25 == 4:
            text += ["zu", "zw", "zv"]
        for k, passage in put:
            at = rng.randint(0, len(text))
            text[at:at] = passage
            want.add((i, k))
        docs.append((i, " ".join(text), 1, 2, 0.5))
    bench = spark.createDataFrame([(1, " ".join(hot)), (2, " ".join(few)), (3, " ".join(short))], "item_id long, text string")
    for p in (leaks.LeakParams(), leaks.LeakParams(bins=64)):  # with 64 bins each is in over 5 % of the rows
        got = {(r.doc_id, r.item_id) for r in leaks.matches(spark.createDataFrame(docs, DOCS), bench, params=p).collect()}
        assert got == want


def test_a_match_of_a_null_id_drops_only_its_own_text(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(None, item, 0, 0, 0.0), (None, "clean words", 0, 0, 0.0), (None, None, 0, 0, 0.0), (3, "more", 0, 0, 0.0)], DOCS)
    kept = leaks.keep_clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == ["(3, 'more')", "(None, 'clean words')", "(None, None)"]


def test_passages_at_the_thresholds_are_found_at_all_lengths_among_heavier_words():
    rng, p = random.Random(11), leaks.LeakParams()
    for n in range(8, 65):
        passage = [f"p{n}x{i}" for i in range(n)]
        tail = max(3, n // 5)
        for least in (p.near, p.loose):
            keep = set(range(n - tail, n)) if least == p.loose else set()  # the looser rule asks for the answer
            rest = sorted(set(range(n)) - keep)
            keep |= set(rng.sample(rest, max(0, int(np.ceil(least * n - 1e-9)) - len(keep))))
            planted = [w if i in keep else f"q{n}x{i}" for i, w in enumerate(passage)]
            text = [f"a{i}" for i in range(rng.randint(60, 99))] + planted + [f"b{i}" for i in range(80)]
            idf = np.full(p.bins, 2.4, np.float32)
            h = hash_words(passage)
            idf[(h % np.uint64(p.bins)).astype(np.int64)] = 1
            space = np.zeros((p.bins, 4), np.float32)
            search = leaks.Search(leaks.fit_block([7], [h], idf, space, p), idf, space, p)
            assert [r[1] for r in search.slice(*buffers(pa.array([" ".join(text)])))] == [7], (n, least)


def test_repeated_rows_match_each_whatever_the_blocks(spark):
    docs, items, _ = made()
    held = [d[1] for d in docs if d[0] % 8 == 4][:3]
    data = [(None, held[0], 1, 2, 0.5), (None, held[1], 1, 2, 0.5), (7, held[2], 1, 2, 0.5), (7, held[2], 1, 2, 0.5), (7, held[0] + " and more", 1, 2, 0.5), *[(*d, 1, 2, 0.5) for d in docs if d[0] % 4]]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(1, " ".join(items[1]))], "item_id long, text string")
    # cosines are of single precision
    ask = lambda p: sorted(str((*r[:2], round(r.cosine, 5), *r[3:])) for r in leaks.matches(spark.createDataFrame(data, DOCS).repartition(3), bench, params=p).collect())
    want = ask(leaks.LeakParams())
    assert len(want) == 5
    assert ask(leaks.LeakParams(block=4)) == want
    assert ask(leaks.LeakParams(block=4, broadcast_bytes=30_000)) == want


def test_the_latent_space_is_of_all_rows_whatever_begins_it(spark, monkeypatch):
    """Words that none of the rows have with which the fit begins make the leading directions all the same."""
    rng, p = random.Random(6), leaks.LeakParams(bins=512, rank=4, oversample=4, fit_passages=20)
    said = lambda t: " ".join(f"{t}{rng.randrange(12)}" for _ in range(64))
    texts = [said("abcd"[i % 4]) for i in range(400)]
    idf = np.ones(p.bins, np.float32)
    rows = [leaks._passage_rows(*buffers(pa.array([t])), idf, p)[:2] for t in texts]
    table = np.zeros((len(texts), p.bins))
    for i, (bins, weights) in enumerate(rows):
        table[i, bins] = weights
    vectors = np.linalg.svd(table, full_matrices=False)[2][:4]
    start = np.linalg.qr(np.random.default_rng(1).standard_normal((p.bins, 8)))[0].astype(np.float32)
    for _ in range(2):
        start = np.linalg.qr(leaks.whole_space(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), start, idf, leaks.LeakParams(bins=512, rank=8)))[0].astype(np.float32)
    space = leaks.whole_space(spark.createDataFrame([(t,) for t in texts], "text string"), start, idf, p)
    assert np.allclose(space.T @ space, np.eye(4), atol=1e-4)
    assert np.linalg.norm(vectors @ space, axis=1).min() > 0.99
    # the operator's own space: every text takes part in it
    seen = []
    monkeypatch.setattr(leaks, "whole_space", lambda t, *a: seen.append(t.count()) or np.eye(512, 4, dtype=np.float32))
    docs = spark.createDataFrame([(i, t, 0, 0, 0.0) for i, t in enumerate(texts)], DOCS)
    leaks.matches(docs, spark.createDataFrame([(1, texts[0])], "item_id long, text string"), params=p).count()
    assert seen == [401]


def test_the_fit_over_all_rows_has_no_more_tasks_than_it_needs(spark, monkeypatch):
    """Each task returns a whole product, so a table in many small partitions must not make one for each of them."""
    rng = np.random.default_rng(8)
    texts = spark.createDataFrame([(" ".join(f"w{k}" for k in rng.integers(0, 300, 40)),) for _ in range(90)], "text string")
    p = leaks.LeakParams(bins=256, rank=4)
    start = np.linalg.qr(rng.standard_normal((256, 8)))[0].astype(np.float32)
    seen, real = [], leaks._sum
    monkeypatch.setattr(leaks, "_sum", lambda parts, shape: seen.append(parts.rdd.getNumPartitions()) or real(parts, shape))
    many, one = (leaks.whole_space(texts.repartition(n), start, np.ones(256, np.float32), p) for n in (50, 1))
    assert seen == [spark.sparkContext.defaultParallelism, 1]
    assert np.allclose(many @ many.T, one @ one.T, atol=1e-4)


def test_frequencies_of_many_short_texts_take_little_memory():
    """Each text counts a bin once, and what tells its words apart does not grow with the texts of a slice."""
    import tracemalloc

    p = leaks.LeakParams()
    texts = [f"alpha w{i % 7} alpha W{i % 7} beta" for i in range(1000)] + ["", None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    tracemalloc.start()
    got = next(iter(leaks._frequencies(p)(iter([batch, batch]))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    counts = dict(zip(*(c.to_pylist() for c in got.columns)))
    bins = {w: int(hash_words([w])[0] % np.uint64(p.bins)) for w in ("alpha", "beta", *(f"w{k}" for k in range(7)))}
    assert counts.pop(-1) == 2004 and counts.pop(-2) == 2000 and len(set(bins.values())) == 9
    assert counts == {b: 2000 if w in ("alpha", "beta") else 2 * sum(i % 7 == int(w[1:]) for i in range(1000)) for w, b in bins.items()}
    assert peak < 24 << 20
