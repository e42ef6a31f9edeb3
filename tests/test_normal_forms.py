"""Normal forms against the standard library, windows and pairs against plain loops."""

import random
import unicodedata
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import functions as F

from seglume.functions import text as t, unicode as u
from seglume.operators import forward, similar


def test_compatibility_forms_are_the_library_s(spark):
    texts = ["ＡＢＣ１２３", "ﬁﬂ ligature", "①②㈱", "ｶﾞ", "é", "", None, "這個", "x" * 5000 + "Ｚ"]
    rows = spark.createDataFrame([(x,) for x in texts], "x string")
    got = rows.select(u.nfkc("x").alias("n"), u.simplified("x").alias("s"), u.cjk_key("x").alias("k")).collect()
    assert [r.n for r in got] == [unicodedata.normalize("NFKC", x or "") for x in texts]
    assert got[7].s == "这个" and got[2].k == "" and got[0].k == ""
    assert len(u.TRADITIONAL) == len(u.SIMPLIFIED)
    keys = spark.createDataFrame([("［3］：ＡＢ第二十三個",), ("12. 三万二千馬",), (None,), ("一。二",)], "x string").select(u.source_key("x").alias("k")).collect()
    assert [r.k for r in keys] == ["ab第23个", "32000马", "", "12"]


def test_forward_windows_are_those_of_a_loop(spark):
    rng = random.Random(4)
    rows, starts, want = [], [], []
    for project in range(3):
        own = [(project, pos, rng.random() < 0.4, rng.random() < 0.3) for pos in range(rng.choice((0, 5, 9000)))]
        rows += own
        for item, start in enumerate(sorted({rng.randrange(len(own) + 3) for _ in range(25)})):
            starts.append((project, item, start))
            content = place = 0
            for _, pos, junk, taken in own[start:]:
                if content >= 8 or place >= 16:
                    break
                if not taken:
                    want.append((project, item, pos, place))
                    content, place = content + (not junk), place + 1
    got = forward.forward_window(spark.createDataFrame(starts, "project long, item long, start_pos long"), spark.createDataFrame(rows, "project long, pos long, junk boolean, taken boolean").repartition(5))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_like_pairs_are_those_of_all_comparisons(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz的了好天") for _ in range(rng.randint(1, 14))) for _ in range(25)]
    some = lambda: "".join(c if rng.random() < 0.75 else rng.choice("abcxyz") for c in rng.choice(base))
    left, right = ([(rng.randrange(2), i, rng.choice((some(), some(), base[i % 25], "", None))) for i in range(120)] for _ in range(2))
    a, b = (spark.createDataFrame(x, "key long, id long, text string") for x in (left, right))
    got = {(r.key, r.id_a, r.id_b): r.likeness for r in similar.similar(a, b, 0.6).collect()}
    want = {(k, i, j): SequenceMatcher(None, x, y, autojunk=False).ratio() for k, i, x in left for m, j, y in right if k == m and x and y}
    assert got.keys() == {p for p, v in want.items() if v >= 0.6 - 1e-12} and len(got) > 50
    assert all(abs(got[p] - want[p]) < 1e-9 for p in got)
    scored = similar.candidates(a, b, 0.6).count()
    assert len(got) <= scored < len(want) / 4


def test_texts_that_nearly_all_meet_are_no_joined_rows(spark, monkeypatch):
    """Names of a few kinds and a number: nearly every pair shares rare tokens, several times. Only the rows of both sides are
    dealt, in pieces; each pair comes once. Ids need not be of one type, and may be null."""
    monkeypatch.setattr(similar, "_PIECE", 50)
    rng = random.Random(7)
    name = lambda: f"{rng.choice(('building', 'furniture', 'household'))} {rng.randrange(10**6):06d}"
    left, right = ([(i % 2, i, name()) for i in range(300)] for _ in range(2))
    right = [(k, f"r{i}", t) for k, i, t in right] + [(1, None, left[1][2]), (None, "none", left[1][2])]
    a, b = spark.createDataFrame(left, "key long, id long, text string"), spark.createDataFrame(right, "key int, id string, text string")
    want = {(k, i, j, SequenceMatcher(None, x, y, autojunk=False).ratio()) for k, i, x in left for m, j, y in right if k == m}
    want = {r for r in want if r[3] >= 0.6}
    found = similar.similar(a, b, 0.6)
    # no row is a pair before it is scored
    assert "Join" not in "".join(found._jdf.queryExecution().executedPlan().toString().partition("MapInArrow")[0])
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 10_000
    met = similar._meetings(a, b, 0.6).groupBy("cell", "at_a", "at_b").count()
    assert max(r["count"] for r in met.collect()) <= 4 * similar._PIECE
    assert similar.similar(a, b.limit(0), 0.6).count() == 0


def test_pairs_are_counted_in_strips(monkeypatch):
    """Strips of a cell give the pairs of the whole cell, once each, at the first token that both have."""
    rng = random.Random(2)
    sets = [sorted(rng.sample(range(12), rng.randint(4, 8)) + [20]) for _ in range(30)]
    sides = [False] * 13 + [True] * 17
    for token in (20, 5):
        rows = [k for k in range(30) if token in sets[k]]
        m = sum(not sides[k] for k in rows)
        cell = pa.table({"set": pa.array([sets[k] for k in rows], pa.list_(pa.int64())), "right": [sides[k] for k in rows], "token": [token] * len(rows)})
        alike = lambda x, y: len(set(x) & set(y)) >= 0.3 * (len(x) + len(y)) and min(set(x) & set(y)) == token and 7 * min(len(x), len(y)) >= 3 * max(len(x), len(y))
        want = sorted((i, j) for i in range(m) for j in range(len(rows) - m) if alike(sets[rows[i]], sets[rows[m + j]]))
        for strip in (1, 40, 1 << 20):
            monkeypatch.setattr(similar, "_STRIP", strip)
            assert sorted((int(i), int(j)) for x, y in similar._alike(cell, 0.6) for i, j in zip(x, y)) == want
    assert want


def test_chapters_lose_their_boilerplate(spark):
    raw = "Chương 12 - 书名\r\n https://a.b/c \n笔趣阁\n(UU看书)\nps：求收藏\n看著天（求月票!）\n\n300字\n2024-05-06 07:08\n裏面，麼"
    got = spark.createDataFrame([(raw,), (None,), ("www.only.com",)], "x string").select(t.chapter("x").alias("c")).collect()
    assert [(r.c.title, r.c.body) for r in got] == [("书名", "看着天里面，么"), ("", ""), ("", "")]


def test_readings_that_names_tell(spark):
    names = spark.createDataFrame([("王飞", "Vương Phi"), ("李飞", "Lý Phi / x"), ("飞云", "Bay Vân"), ("一", "Nhất"), ("天地人间客", "a b c d e"), ("云山", "Vân")], "name string, reading string")
    known = spark.createDataFrame([("王", "vương")], "char string, reading string")
    assert {(r.char, r.reading) for r in t.fallback_readings(names, known).collect()} == {("飞", "phi"), ("李", "lý"), ("云", "vân")}
    row = spark.range(1).select(t.genre_by_weight(F.lit("a b b"), (("x", (("a", 2),)), ("y", (("b", 1),)), ("z", ()))).alias("g"), t.genre_by_weight(F.lit(None).cast("string"), (("x", (("a", 2),)),)).alias("d")).first()
    assert (row.g, row.d) == ("x", "xianxia")
