"""Dictionary matches against a scan of all phrases."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from seglume.operators import dictionary


def all_places(text, phrases):
    low = dictionary.folded(text)
    return sorted((i, i + len(p), k) for k, p in enumerate(phrases) for i in range(len(low)) if low.startswith(p, i))


def plain(text, phrases, safe):
    """From the left: the longest phrase at a place, unless a longer safe one covers it."""
    low, out, i = dictionary.folded(text), [], 0
    word = lambda k: 0 <= k < len(low) and low[k].isalnum() and low[k] < "⺀"
    fits = lambda a, b: not (word(a - 1) and word(a)) and not (word(b - 1) and word(b))
    while i < len(low):
        ends = [i + len(p) for p in phrases if low.startswith(p, i) and fits(i, i + len(p))]
        end = max(ends, default=0)
        covered = any(len(s) > end - i and low.startswith(s, k) and k + len(s) >= end for s in safe for k in range(max(0, end - len(s)), i + 1))
        if end and not covered:
            out.append((i, end, text[i:end], sorted(phrases[low[i:end]])))
            i = end
        else:
            i += 1
    return out


def test_an_automaton_finds_what_a_scan_of_all_phrases_finds():
    rng = random.Random(1)
    for _ in range(40):
        phrases = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 12))})
        texts = ["".join(rng.choice("abc") for _ in range(rng.choice((0, 1, 7, 600, 1500)))) for _ in range(4)]
        a = dictionary.Automaton(phrases)
        codes, bounds = dictionary._laid_out(texts)
        begin, end, phrase = a.find(codes, bounds)
        text = np.searchsorted(bounds, begin, "right") - 1
        for i, t in enumerate(texts):
            own = text == i
            got = sorted(zip((begin[own] - bounds[i]).tolist(), (end[own] - bounds[i]).tolist(), phrase[own].tolist()))
            assert got == all_places(t, phrases)
    assert [len(x) for x in dictionary.Automaton([]).find(np.zeros(0, np.int64), np.zeros(1, np.int64))] == [0, 0, 0]


def test_matches_are_those_of_a_plain_walk(spark):
    rng = random.Random(2)
    letters = "ab 操贞骨É"
    some = lambda n: "".join(rng.choice(letters) for _ in range(n))
    phrases = {p: {rng.choice("xyz")} for p in {dictionary.folded(some(rng.randint(1, 4))).strip() for _ in range(30)} if p}
    safe = sorted({dictionary.folded(some(rng.randint(2, 5))) for _ in range(12)} | set(list(phrases)[:2]))
    data = [(i, some(rng.choice((0, 3, 30, 700)))) for i in range(60)] + [(100, None), (101, "İstanbul ab"), (102, "ABA ab")]
    rows = spark.createDataFrame(data, "id long, text string")
    for most in (64 << 20, 400):
        got = {r.id: [tuple(m) for m in r.matches] for r in dictionary.matches(rows, "text", phrases, safe, most).collect()}
        assert got == {i: plain(t or "", phrases, safe) for i, t in data}
    assert len(dictionary.automata(list(phrases), 400)) > 1


def test_a_large_dictionary_takes_one_pass(spark):
    rng = random.Random(3)
    phrases = sorted({"".join(rng.choice("abcdefghij") for _ in range(rng.randint(5, 9))) for _ in range(100_000)})
    began = time.perf_counter()
    a = dictionary.Automaton(phrases)
    text = " ".join(rng.choice(phrases) if rng.random() < 0.5 else "zz" for _ in range(20_000))
    codes, bounds = dictionary._laid_out([text])
    begin, end, phrase = a.find(codes, bounds)
    assert time.perf_counter() - began < 60
    known = {p: k for k, p in enumerate(phrases)}
    want = sorted((i, i + n, known[text[i : i + n]]) for n in range(5, 10) for i in range(len(text) - n + 1) if text[i : i + n] in known)
    assert sorted(zip(begin.tolist(), end.tolist(), phrase.tolist())) == want
    rows = spark.createDataFrame([(1, text[:5000])], "id long, text string")
    assert dictionary.matches(rows, "text", {p: ["w"] for p in phrases}).select(F.size("matches")).first()[0] > 100
