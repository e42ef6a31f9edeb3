import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from seglume.llm import quality, textbytes

DOCS = "doc_id long, text string, score string, _text int"


def made(n):
    rng, out = random.Random(4), []
    common = ["the", "of", "and", "to", "in", "it", "was"]
    for i in range(n):
        bad = i % 4 == 0
        words = [rng.choice(common) if rng.random() < 0.5 else "".join(rng.choice("aeioulnst") for _ in range(6)) for _ in range(rng.randint(20, 60))]
        out.append((i, " ".join(w.upper() + "!!" if bad else w for w in words), int(not bad)))
    return out


def test_held_out_accuracy_and_determinism(spark):
    rows = made(400)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, q, "z") for i, _, q in rows if i % 2] + [(0, None, "z"), (None, 1, "z")] + [(i, q, "z") for i, _, q in rows if i % 8 == 0], "doc_id long, quality int, text string")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == 400
    held = [i for i in got if got[i].held_out]
    assert held == [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    right = [got[i].predicted == rows[i][2] for i in held]
    assert sum(right) / len(right) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i].predicted}


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, "", 0), (1, None, "", 0), (2, "", "", 0), (None, "a b " * 50_000, "", 0)], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.classify(docs, none).collect()] == [0.5] * 4
    assert quality.classify(docs.limit(0), none).count() == 0


def test_pooled_vectors_equal_plain_ones():
    p = quality.QualityParams(bins=16, dims=4)
    texts = ["ab ab!! 12", "", "x", "éa  9\n9"]
    vectors = np.random.default_rng(0).normal(size=(16, 4)).astype(np.float32)
    (_, _, raw, offs), = textbytes.slices(pa.array(texts))
    got = quality.pool(raw, offs, vectors, p)
    split = [["ab", "ab", "!!", "12"], [], ["x"], ["éa", "9", "9"]]
    for row, units in zip(got, split):
        v = vectors[(textbytes.hash_words(units) % np.uint64(16)).astype(int)] if units else np.zeros((0, 4))
        n = len(units)
        want = np.zeros(13)
        if n:
            want[:4], want[4:8], want[8:12], want[12] = v.mean(0), (v * v).mean(0), (v[:-1] * v[1:]).sum(0) / n, np.log1p(n)
        assert np.allclose(row, want, atol=1e-5)


def test_every_labelled_row_teaches(spark):
    """What only rows beyond the first 8,000 (by a hash of the id) tell is learnt as well."""
    rng = random.Random(8)
    ids = [r.doc_id for r in spark.range(13_500).selectExpr("id as doc_id").orderBy(F.xxhash64("id"), "id").collect()]
    held = {i for i in ids if zlib.crc32(str(i).encode()) % 3 == 1}
    early = set([i for i in ids if i not in held][:8000])
    rows = []
    for i in ids:
        good = rng.random() < 0.5
        words = [rng.choice(["lo", "mi", "ra", "su"]) for _ in range(6)]
        rows.append((i, " ".join(words if i in early else [*words, *["yes" if good else "no"] * 3]), int(good)))
    docs = spark.createDataFrame([(i, t, "", 0) for i, t, _ in rows], DOCS)
    labels = spark.createDataFrame([(i, q) for i, _, q in rows], "doc_id long, quality int")
    got = {r.doc_id: r.predicted for r in quality.classify(docs, labels).collect()}
    assert sum(got[i] == q for i, _, q in rows if i in held) / len(held) > 0.95
