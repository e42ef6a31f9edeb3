import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from seglume.llm import repeats

DOCS = "doc_id long, text string, mark string, place int, core string, first string, ctx int, n_bytes long"


def brute(data, length, order):
    """Each 100-byte string by its first place; data is (doc_id, text), order a key of rows."""
    seen, out = set(), []
    for doc_id, text in sorted(data, key=order):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            w = raw[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(raw), sum(gone), spans, sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def run(spark, data, **more):
    # the order of rows with one id is by the mark, so the tests ask Spark for it
    marks = {r.text: r.m for r in spark.createDataFrame([(t or "",) for _, t in data], "text string").select("text", F.xxhash64("text").alias("m")).collect()}
    docs = spark.createDataFrame([(i, t, "m", 1, "c", "f", 2, 3) for i, t in data], DOCS).repartition(5)
    p = repeats.RepeatParams(**more)
    got = sorted(map(tuple, repeats.dedup(docs, params=p).collect()), key=str)
    assert got == brute(data, p.length, lambda r: (r[0] is not None, r[0] or 0, marks[r[1] or ""]))
    return got


def corpus(seed, n=60, letters="ab cé\n"):
    rng = random.Random(seed)
    some = lambda k: "".join(rng.choice(letters) for _ in range(k))
    shared = [some(rng.choice((50, 97, 98, 99, 100, 101, 130, 400))) for _ in range(8)]
    data = []
    for i in range(n):
        text = "".join(rng.choice((rng.choice(shared), rng.choice(shared)[rng.randrange(20) :], some(rng.randrange(60)))) for _ in range(rng.randrange(6)))
        data.append((rng.randrange(1000) * 7 + i * 7000, text))
        if rng.random() < 0.3 and text:
            k = rng.randrange(len(text))
            data.append((rng.randrange(1000) + i * 7000 + 500_000, text[:k] + rng.choice("ab") + text[k + 1 :]))
    return data


@pytest.mark.parametrize("seed", [1, 2])
def test_removed_bytes_are_those_of_brute_force(spark, seed):
    got = run(spark, corpus(seed))
    assert sum(r[2] for r in got) > 1000 and max(r[3] for r in got) > 1


def test_other_lengths_cells_and_chunks(spark):
    run(spark, corpus(3, 40), length=70, cells=(32, 4, 1), chunk=64)
    run(spark, corpus(4, 40), length=100, cells=(64, 1), chunk=150)


def test_runs_periods_ties_nulls_and_repeated_rows(spark):
    period = "abcabcab" * 40
    same = "The same text over and over, long enough to hold a window of a hundred bytes, and a little more than that."
    data = [(1, "a" * 500), (2, "a" * 99), (3, "a" * 100), (4, period), (5, "x" + period), (6, None), (7, ""), (None, same), (None, same), (None, same + "!"), (9, same), (9, same), (9, same[:50]), (9, "y" + same), (10, "é" * 300), (11, "é" * 49 + "è" + "é" * 80)]
    run(spark, data)
    assert repeats.dedup(spark.createDataFrame([], DOCS)).count() == 0
    run(spark, [(3, None)])
    run(spark, [(3, same)] * 5)


def test_a_long_document_and_a_large_group_of_copies(spark):
    rng = random.Random(8)
    word = [("%x" % rng.getrandbits(40)) for _ in range(4000)]
    long_ = " ".join(rng.choice(word) for _ in range(60_000))
    copies = [(100 + i, long_[2000:2600] + (f" {i} " if i % 3 else "") + long_[9000:9300]) for i in range(300)]
    run(spark, [(5, long_), (50, long_[: 1 << 18]), *copies], chunk=1 << 14)
