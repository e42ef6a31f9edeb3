"""Spelling variants by anagram hashing.

A word's key is the sum of a power of each of its letters, so words of the same letters share it whatever their order. A
word that has one letter more has the other's key plus that letter's value; one with a letter exchanged has it less one
value and plus another. So each word stands in an index once with its own key and once with the key less each of its
letters (a rest): whole keys that equal rests are additions and removals, equal rests are exchanges. One equality join
meets every pair; its condition verifies the letters' order. An edit leaves the first or the last half of the rest in
its place, so that half is part of the join's key, and a group of many anagrams does not become its pairs.

Words are counted over all documents with map-side sums. Forms lead from a word to its most frequent neighbour if that
is twice as frequent or more; counts double with each step, so chains are short and pointers settle by doubling.

Nulls: a null text has no words, a null id counts as empty text in the checksum. Repeated rows count again. Words of any
length are compared (letters' sums are taken modulo a prime). An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from seglume.storage import stage


@dataclass(frozen=True)
class SpellingParams:
    #: Of the runs with a checksum that this divides one letter goes (0: of none).
    spoil: int = 97
    min_length: int = 5
    min_count: int = 3
    #: How much more frequent a form is than its variant.
    times: int = 2
    power: int = 5


#: Sums are taken modulo this prime: no length overflows, and single values (under 2 ** 40) stay what they are.
PRIME = (1 << 61) - 1
_LETTERS = "[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spoil: int = 97) -> DataFrame:
    """``word``: each run of letters, A-Z in lower case, a few spoiled."""
    text = F.translate(F.col(text_col).cast("string"), _UPPER, _LOWER)
    rows = docs.select(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(_LETTERS), F.lit(0))).alias("run"))
    if not spoil:
        return rows.select(F.col("run").alias("word"))
    rows = rows.withColumn("h", F.crc32(F.concat("id", "run").cast("binary")))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    spoiled = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return rows.select(F.when(F.col("h") % spoil == 0, spoiled).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: SpellingParams = SpellingParams()) -> DataFrame:
    """word, n of the words that are long and frequent enough."""
    words = runs(docs, id_col, text_col, params.spoil).where(F.length("word") >= params.min_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= params.min_count)


def _value(letter: Column, power: int) -> Column:
    code = F.ascii(letter).cast("long")
    out = code
    for _ in range(power - 1):
        out = out * code
    return out


def key(word: Column, power: int) -> Column:
    """The sum of the letters' values, the same for all orders of the letters."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda total, c: (total + F.when(c == "", F.lit(0)).otherwise(_value(c, power))) % PRIME)


def _sides(words: DataFrame, power: int) -> tuple[DataFrame, DataFrame]:
    """Rests (key less a letter) and whole keys, each with the first and with the last half of what is left."""
    keyed = words.withColumn("key", key(F.col("word"), power)).withColumn("length", F.length("word"))
    letters = F.array_distinct(F.filter(F.split("word", ""), lambda c: c != ""))
    rests = keyed.select("word", "n", "key", (F.col("length") - 1).alias("size"), F.explode(letters).alias("c"))
    rests = rests.select("word", "n", "key", "size", F.pmod(F.col("key") - _value(F.col("c"), power), F.lit(PRIME)).alias("rest"))
    return rests, keyed.select("word", "n", "key", F.col("length").alias("size"), F.col("key").alias("rest"))


def _halved(rows: DataFrame) -> DataFrame:
    half = F.expr("size div 2")
    first, last = F.substr("word", F.lit(1), half), F.substr("word", F.length("word") - (F.col("size") - half) + 1)
    halves = F.array(F.struct(F.lit(0).alias("side"), first.alias("half")), F.struct(F.lit(1).alias("side"), last.alias("half")))
    return rows.withColumn("head", first).withColumn("h", F.explode(halves)).select("*", "h.side", "h.half").drop("h")


def near_pairs(words: DataFrame, power: int = 5) -> DataFrame:
    """(a, n_a, b, n_b): every pair of words that one letter inserted, deleted or replaced makes equal, both ways round."""
    rests, wholes = _sides(words, power)
    left = _halved(rests)
    right = _halved(rests.withColumn("whole", F.lit(False)).unionByName(wholes.withColumn("whole", F.lit(True))))
    right = right.select(*[F.col(c).alias(f"{c}_b") for c in ("word", "n", "key", "size", "rest", "head", "whole", "side", "half")])
    same = (F.col("rest") == F.col("rest_b")) & (F.col("size") == F.col("size_b")) & (F.col("side") == F.col("side_b")) & (F.col("half") == F.col("half_b"))
    # exchanges are met from both sides, and anagrams of each other are none
    kind = F.col("whole_b") | ((F.col("word") < F.col("word_b")) & (F.col("key") != F.col("key_b")))
    once = (F.col("side") == 0) | (F.col("head") != F.col("head_b"))
    near = F.levenshtein(F.col("word"), F.col("word_b"), 1) == 1
    found = left.join(right, same & kind & once & near).select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("word_b").alias("b"), F.col("n_b"))
    return found.select(F.explode(F.array(F.struct("a", "n_a", "b", "n_b"), F.struct(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))).alias("p")).select("p.*")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: each round looks up where the present root leads."""
    now = stage(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stage(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if moved.where("moved").isEmpty():
            return now
        now = moved.drop("moved")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: SpellingParams = SpellingParams()) -> DataFrame:
    """word, n, n_near, form, form_n, root; one row a word."""
    p = params
    words = stage(vocabulary(docs, id_col, text_col, p), "spelling-words")
    best = F.min(F.struct((-F.col("n_b")).alias("n"), F.col("b").alias("word")))
    near = near_pairs(words, p.power).groupBy("a", "n_a").agg(F.count("*").alias("n_near"), best.alias("best"))
    takes = -F.col("best.n") >= p.times * F.col("n_a")
    near = stage(near.select(F.col("a").alias("word"), "n_near", F.when(takes, F.col("best.word")).alias("form"), F.when(takes, -F.col("best.n")).alias("form_n")), "spelling-near")
    roots = _roots(near.where("form is not null"))
    out = words.join(near, "word", "left").join(roots, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def variants_sql(params: SpellingParams = SpellingParams()) -> str:
    """``variants`` over ``documents``: pairs through deletions of a letter at each place, roots by recursion."""
    p = params
    table = "SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab"
    # UTF-8 bytes of runs and ids: letters up to U+00FF have two at most
    codes = "flatten(list_transform(range(1, length(s) + 1), lambda k: CASE WHEN unicode(substr(s, k, 1)) < 128 THEN [CAST(unicode(substr(s, k, 1)) AS BIGINT)] ELSE [CAST(192 + (unicode(substr(s, k, 1)) >> 6) AS BIGINT), CAST(128 + (unicode(substr(s, k, 1)) & 63) AS BIGINT)] END))"
    return (
        f"WITH RECURSIVE crc AS ({table}), runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents), "
        "counted AS (SELECT id || ':' || run AS s, run, count(*) AS c FROM runs GROUP BY 1, 2), "
        f"hashed AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295, {codes}), lambda x, b: xor(x >> 8, tab[(xor(x, b) & 255) + 1])), 4294967295) AS h FROM counted, crc), "
        f"words AS (SELECT CASE WHEN h % {p.spoil} = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, CAST(sum(c) AS BIGINT) AS n FROM hashed GROUP BY 1), "
        f"kept AS (SELECT word, n FROM words WHERE length(word) >= {p.min_length} AND n >= {p.min_count}), "
        "cut AS (SELECT word, n, i, substr(word, 1, CAST(i AS INT)) || substr(word, CAST(i AS INT) + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM kept)), "
        "pairs AS (SELECT a.word AS a, a.n AS n_a, b.word AS b, b.n AS n_b FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word "
        "UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN kept b ON a.rest = b.word UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN kept b ON a.rest = b.word), "
        "best AS (SELECT a, n_a, b, n_b, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n_b DESC, b) AS k FROM pairs), "
        f"forms AS (SELECT k.word, k.n, coalesce(n_near, 0) AS n_near, CASE WHEN n_b >= {p.times} * k.n THEN b END AS form, CASE WHEN n_b >= {p.times} * k.n THEN n_b END AS form_n FROM kept k LEFT JOIN best ON best.a = k.word AND best.k = 1), "
        "steps AS (SELECT word, word AS root, 0 AS d FROM forms UNION ALL SELECT s.word, f.form, d + 1 FROM steps s JOIN forms f ON f.word = s.root WHERE f.form IS NOT NULL), "
        "last AS (SELECT word, arg_max(root, d) AS root FROM steps GROUP BY 1) "
        "SELECT f.word, f.n, f.n_near, f.form, f.form_n, l.root FROM forms f JOIN last l ON l.word = f.word"
    )
