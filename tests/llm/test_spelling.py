import random
import re
import zlib
from collections import Counter

from seglume.llm import spelling

DOCS = "doc_id long, text string, word string, n int, a string, b string, key long"
LETTERS = [chr(c) for c in (*range(97, 123), *range(0xC0, 0x100))]


def brute(data, p):
    seen = Counter()
    for doc_id, text in data:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            seen[run[: h % len(run)] + run[h % len(run) + 1 :] if p.spoil and h % p.spoil == 0 else run] += 1
    n = {w: c for w, c in seen.items() if len(w) >= p.min_length and c >= p.min_count}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    by = {w: [v for v in n if abs(len(v) - len(w)) <= 1 and near(v, w)] for w in n}
    form = {}
    for w, others in by.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= p.times * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(by[w]), form[w], n.get(form[w]), root))
    return sorted(out, key=str)


def test_variants_are_those_of_brute_force(spark):
    rng = random.Random(3)
    base = ["morgen", "sitting", "listen", "silent", "tinsel", "enlist", "ÀÉàéñ", "grande", "aaaaa", "aaaaaa", "aaaaaaa", "straße", "abcdefgh", "x" * 3000]
    data = []
    for i in range(260):
        words = []
        for _ in range(rng.randrange(1, 12)):
            w = rng.choice(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2))):
                k = rng.randrange(len(w[:9]))
                w = rng.choice((w[:k] + w[k + 1 :], w[:k] + rng.choice("aeÿz") + w[k:], w[:k] + rng.choice("aeÿz") + w[k + 1 :]))
            words.append(w if rng.random() < 0.7 else w.upper())
        data.append((i % 200, rng.choice((" ", ", ", "9", "×")).join(words)))
    data += [(None, "listen listen listem listem listem"), (7, None), (8, ""), *[(9, "grande grande")] * 12, (10, "Listen " * 20_000)]
    docs = spark.createDataFrame([(*d, "w", 1, "a", "b", 2) for d in data], DOCS).repartition(5)
    for p in (spelling.SpellingParams(), spelling.SpellingParams(spoil=3, min_count=1)):
        got = sorted((tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in spelling.variants(docs, params=p).collect()), key=str)
        assert got == brute(data, p)


def test_forms_chain_and_ties_take_the_first_in_code_points(spark):
    text = "abcdef " * 3 + "abcdeg " * 6 + "abcdéf " * 6 + "abxdeg " * 12 + "abxdegs " * 30
    got = {r.word: r for r in spelling.variants(spark.createDataFrame([(1, text, "", 0, "", "", 0)], DOCS), params=spelling.SpellingParams(spoil=0)).collect()}
    assert got["abcdef"].form == "abcdeg" and got["abcdef"].n_near == 2 and got["abcdef"].root == "abxdegs"
    assert got["abxdegs"].form is None and got["abxdegs"].root == "abxdegs"
    assert spelling.variants(spark.createDataFrame([], DOCS)).count() == 0
    assert spelling.variants(spark.createDataFrame([(None, None, None, None, None, None, None)], DOCS)).count() == 0


def test_no_two_exchanges_change_a_key_alike():
    values = [ord(c) ** 5 for c in LETTERS]
    moves = [a - b for a in values for b in values if a != b]
    assert len(set(moves)) == len(moves) and max(values) < 2**40 and not set(values) & set(moves)


def test_anagrams_meet_only_with_half_of_their_letters_in_place(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.sample("abcdefghi", 9)) for _ in range(400)})
    rows = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    assert spelling.near_pairs(rows).count() == 0  # one key, four hundred words, no exchange of one letter
    rests, _ = spelling._sides(rows, 5)
    assert rests.select("key").distinct().count() == 1
    most = spelling._halved(rests).groupBy("rest", "side", "half").count().agg({"count": "max"}).first()[0]
    assert most <= 20
