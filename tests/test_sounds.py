"""Sounds of characters with several readings against trying all readings."""

import itertools
import random

from pyspark.sql import functions as F

from seglume.functions import similarity
from seglume.operators import sounds

TABLE = {"长": ["chang", "zhang"], "张": ["zhang"], "藏": ["cang", "zang"], "行": ["xing", "hang"], "航": ["hang"], "林": ["lin"], "宁": ["ning"], "乐": ["le", "yue"], "月": ["yue"]}


def key(s):
    return similarity.sound_key(s)[0]


def readings_of(text):
    return list(itertools.product(*[sorted({key(s) for s in TABLE.get(c, [c])}) for c in text]))


def aligned(x, y):
    """The best alignment of two given readings."""
    best = [[0.0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x, 1):
        for j, b in enumerate(y, 1):
            w = 1.0 if a == b else sounds.INITIAL if a[:1] == b[:1] else 0.0
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + w)
    return 2 * best[-1][-1] / (len(x) + len(y))


def test_the_best_path_is_that_of_all_readings(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice([*TABLE, "x"]) for _ in range(rng.randint(1, 4))) for _ in range(60)]
    texts = list(dict.fromkeys(texts))
    table = spark.createDataFrame([(c, s) for c, ss in TABLE.items() for s in ss], "char string, syllable string")
    rows = spark.createDataFrame([*enumerate(texts), (900, ""), (901, None)], "id long, text string")
    own = sounds.sounded(rows, table)
    got = {r.id: r.sounds for r in own.collect()}
    assert {i: [sorted({key(s) for s in TABLE.get(c, [c])}) for c in t] for i, t in enumerate(texts)} == got
    pairs = own.select(F.col("id").alias("a"), F.col("sounds").alias("x")).crossJoin(own.select(F.col("id").alias("b"), F.col("sounds").alias("y"))).where("a < b")
    for r in pairs.select("a", "b", sounds.sound_likeness("x", "y").alias("v")).collect():
        want = max(aligned(x, y) for x in readings_of(texts[r.a]) for y in readings_of(texts[r.b]))
        assert abs(r.v - want) < 1e-9
    same = sorted((a, b) for a, b in itertools.combinations(range(len(texts)), 2) if set(readings_of(texts[a])) & set(readings_of(texts[b])))
    assert sorted((r.a, r.b) for r in sounds.homophones(own).collect()) == same and len(same) > 3
