"""Queries of the text functions over conversations, documents, pages and parts, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seglume.functions import text as t
from seglume.operators import fusion
from seglume.plans import surrogate as s
from seglume.session import table


def turns(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, turn, text, line (the text numbered, tagged and spaced as scripts are)."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return rows.withColumn("line", F.concat(F.lit("["), F.col("turn").cast("string"), F.lit("]. (music)  "), "text", F.lit(" ")))


_L = "WITH turns AS (SELECT conv_id, turn, role, text, '[' || turn || ']. (music)  ' || text || ' ' AS line FROM conversations)"
_CORE = "CAST(floor(x / 3600000) AS BIGINT)"


def _of(make) -> object:
    return lambda spark, d: turns(spark, d).select("conv_id", "turn", make().alias("out"))


def _times(make) -> object:
    return lambda spark, d: s.timed(spark, d).select("seg_id", make(F.col("start_ms") * 37 + F.col("seg_id")).alias("out"))


def _seconds(how: str) -> object:
    return lambda spark, d: s.timed(spark, d).select("seg_id", t.clock_from_seconds((F.col("start_ms") * 37 + F.col("seg_id")) / F.lit(1000.0), how).alias("out"))


def _clock_sql(ms: str) -> str:
    return f"printf('%02d:%02d:%02d,%03d', ({ms}) // 3600000, ({ms}) // 60000 % 60, ({ms}) // 1000 % 60, ({ms}) % 1000)"


_MS = "start_ms * 37 + seg_id"
_WORDS = r"regexp_extract_all(text, '[^\s]+')"
_NUM = r"trim(regexp_replace(regexp_replace(trim(line), '^(?:\[\s*\d+\s*\])\s*[.:\-–—\s]*', ''), '^[^\pL\pN_\s(\[{]+', ''))"
_TAGS = r"'<[^<>]{1,40}>|\((?i:lock|dur|duration|max|limit)[^)]*\)|\[(?i:lock|khóa|dur|duration|max|limit|id|idx)[^\]]*\]'"
_SQUEEZED = rf"trim(regexp_replace(regexp_replace(line, {_TAGS}, ' ', 'g'), '\s+', ' ', 'g'))"

QUERIES = {
    "t4_clean_speech": (
        _of(lambda: t.clean_speech("line")),
        rf"{_L} SELECT conv_id, turn, trim(regexp_replace(regexp_replace(line, '(?i)\[music\]|\(music\)', '', 'g'), '\s+', ' ', 'g')) AS out FROM turns",
    ),
    "t4_clean_speech_without_spaces": (
        _of(lambda: t.clean_speech("line", False)),
        rf"{_L} SELECT conv_id, turn, regexp_replace(regexp_replace(line, '(?i)\[music\]|\(music\)', '', 'g'), '\s+', '', 'g') AS out FROM turns",
    ),
    "t7_strip_numbering": (_of(lambda: t.strip_numbering("line")), f"{_L} SELECT conv_id, turn, {_NUM} AS out FROM turns"),
    "t6_strip_marks_of_han": (
        lambda spark, d: turns(spark, d).withColumn("mixed", F.concat(F.lit("你好 "), "text")).select("conv_id", "turn", t.has_han("mixed").alias("han"), t.strip_han("mixed").alias("out")),
        f"{_L} SELECT conv_id, turn, true AS han, trim(text) AS out FROM turns",
    ),
    "t10_end_mark": (
        _of(lambda: t.end_mark("text")),
        rf"{_L} SELECT conv_id, turn, CASE WHEN regexp_matches(trim(text), '[.!?,:;…—\-]$') THEN trim(text) ELSE trim(text) || '.' END AS out FROM turns",
    ),
    "t1_key_text": (
        _of(lambda: t.key_text("line")),
        rf"{_L} SELECT conv_id, turn, lower(regexp_replace(regexp_replace(line, '^\s*\[\d+\][.:\s]*', ''), '[^一-鿿A-Za-z0-9]', '', 'g')) AS out FROM turns",
    ),
    "t14_role": (
        lambda spark, d: turns(spark, d).select("conv_id", "turn", t.role(F.when(F.col("turn") % 3 == 0, "narrator").when(F.col("turn") % 3 == 1, "b").otherwise(F.col("role"))).alias("out")),
        f"{_L} SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'NARRATOR' WHEN 1 THEN 'Vai B' ELSE role END AS out FROM turns",
    ),
    "t16_clauses": (
        lambda spark, d: turns(spark, d).select("conv_id", "turn", F.posexplode(t.clauses("text")).alias("place", "clause")),
        r"""SELECT conv_id, turn, CAST(n - 1 AS INT) AS place, c[n] AS clause FROM (SELECT conv_id, turn, c, unnest(range(1, len(c) + 1)) AS n FROM
        (SELECT conv_id, turn, list_filter(list_transform(regexp_extract_all(text, '[^,;:.!?…—–]+(?:[,;:.!?…—–]+|$)'), lambda x: trim(x)), lambda x: x <> '') AS c FROM conversations))""",
    ),
    "t5_drop_boilerplate": (
        lambda spark, d: table(spark, d, "documents").select("doc_id", t.drop_boilerplate("text", (r".*license.*", r".*all rights reserved.*")).alias("out")),
        r"""SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\r?\n'), lambda x: trim(x)), lambda x: x <> '' AND NOT contains(lower(x), 'license') AND NOT contains(lower(x), 'all rights reserved')), chr(10)) AS out FROM documents""",
    ),
    "tl7_hallucinations": (
        lambda spark, d: turns(spark, d).withColumn("said", F.when(F.col("turn") % 4 == 0, F.lit("ha ha ha ha ha ")).when(F.col("turn") % 4 == 1, "♪ ♫ ...").otherwise(F.col("text"))).select("conv_id", "turn", t.is_hallucination("said", F.col("turn") / 10, -F.col("conv_id") / 20).alias("out")),
        f"{_L} SELECT conv_id, turn, turn % 4 = 1 OR trim(text) = '' AND turn % 4 > 1 OR (turn / 10 > 0.85 AND -conv_id / 20 < -1.0) AS out FROM turns",
    ),
    "t37_word_counts": (
        lambda spark, d: turns(spark, d).select("conv_id", "turn", t.word_count("text").cast("long").alias("words"), t.token_count("text").cast("long").alias("tokens")),
        rf"SELECT conv_id, turn, len({_WORDS}) AS words, len(regexp_extract_all(text, '[\pL\pM\pN_]+')) AS tokens FROM conversations",
    ),
    "t31_numbered_lines": (
        lambda spark, d: turns(spark, d).withColumn("row", F.concat((F.col("turn") + 1).cast("string"), F.lit(") "), "text")).select("conv_id", "turn", t.numbered_line("row")[0].alias("number"), t.numbered_line("row")[1].alias("rest")),
        f"{_L} SELECT conv_id, turn, CAST(turn + 1 AS INT) AS number, trim(text) AS rest FROM turns",
    ),
    "t22_placeholders": (
        lambda spark, d: turns(spark, d).withColumn("p", t.placeholders("text", F.array(*[F.lit(w) for w in ("a_", "the", "zzzz", "qqqq", "xx_yy")]))).select("conv_id", "turn", "p.found", "p.missing", "p.valid"),
        r"""WITH f AS (SELECT conv_id, turn, lower(regexp_replace(text, '[\s_\-]+', '', 'g')) AS x FROM conversations),
        n AS (SELECT conv_id, turn, (contains(x, 'a')::INT + contains(x, 'the')::INT + contains(x, 'zzzz')::INT + contains(x, 'qqqq')::INT + contains(x, 'xxyy')::INT) AS found FROM f)
        SELECT conv_id, turn, found, 5 - found AS missing, found >= 1 OR 5 - found <= 4 AS valid FROM n""",
    ),
    "t39_mask_secret": (
        lambda spark, d: table(spark, d, "customer").select("c_custkey", t.mask_secret("c_name").alias("out")),
        "SELECT c_custkey, left(c_name, 4) || '...' || right(c_name, 4) AS out FROM customer",
    ),
    "t40_hash_token": (
        lambda spark, d: table(spark, d, "customer").select("c_custkey", t.hash_token("c_name").alias("out")),
        "SELECT c_custkey, upper(left(md5(c_name), 4)) AS out FROM customer",
    ),
    "t38_safe_title": (
        lambda spark, d: table(spark, d, "part").select("p_partkey", t.safe_title("p_type").alias("out")),
        r"SELECT p_partkey, trim(regexp_replace(p_type, '[^\pL\pM\pN_ \-]', '', 'g')) AS out FROM part",
    ),
    "t23_transliterate": (
        lambda spark, d: table(spark, d, "nation").select("n_nationkey", t.transliterate("n_name", F.create_map(F.lit("A"), F.lit("alpha"), F.lit("B"), F.lit("beta"))).alias("out")),
        "SELECT n_nationkey, array_to_string(list_transform(string_split(n_name, ''), lambda c: CASE c WHEN 'A' THEN 'Alpha' WHEN 'B' THEN 'Beta' ELSE upper(c) END), ' ') AS out FROM nation",
    ),
    "src13_video_url": (
        lambda spark, d: table(spark, d, "orders").select("o_orderkey", t.video_url(F.concat(F.lit("https://www.bilibili.com/vi/video/av"), F.col("o_orderkey").cast("string"), F.lit("/?spm=1&p=2"))).alias("out")),
        "SELECT o_orderkey, 'https://www.bilibili.com/video/av' || o_orderkey || '?p=2' AS out FROM orders",
    ),
    "t33_clock": (_times(t.clock), f"WITH {s.TIMED_SQL} SELECT seg_id, {_clock_sql(_MS)} AS out FROM timed"),
    "t33_clock_rounding": (_seconds("round"), f"WITH {s.TIMED_SQL} SELECT seg_id, {_clock_sql(_MS)} AS out FROM timed"),
    "t34_clock_truncating": (_seconds("truncate"), f"WITH {s.TIMED_SQL}, v AS (SELECT seg_id, ({_MS}) / 1000.0::DOUBLE AS v FROM timed), m AS (SELECT seg_id, CAST(floor(v) AS BIGINT) * 1000 + CAST(floor((v - floor(v)) * 1000) AS BIGINT) AS ms FROM v) SELECT seg_id, {_clock_sql('ms')} AS out FROM m"),
    "t35_clock_clamped": (_seconds("clamp"), f"WITH {s.TIMED_SQL} SELECT seg_id, {_clock_sql(_MS)} AS out FROM timed"),
    "t36_clock_centi": (
        _times(t.clock_centi),
        f"WITH {s.TIMED_SQL}, m AS (SELECT seg_id, {_MS} AS ms FROM timed) SELECT seg_id, printf('%d:%02d:%02d.%02d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, least(99, (ms % 1000 + 5) // 10)) AS out FROM m",
    ),
    "t36_ms_of_clock": (_times(lambda ms: t.ms_of_clock(t.clock(ms))), f"WITH {s.TIMED_SQL} SELECT seg_id, {_MS} AS out FROM timed"),
    "t43_crop": (
        lambda spark, d: table(spark, d, "part").select("p_partkey", t.crop(F.col("p_size") * 40 + 320, F.col("p_size") * 20 + 240, F.lit(5), F.lit(10), 16, 9).alias("c")).select("p_partkey", "c.*"),
        """WITH a AS (SELECT p_partkey, p_size * 40 + 320 AS w0, p_size * 20 + 240 AS h0 FROM part), b AS (SELECT *, CAST(floor(h0 * 5 / 100 / 2) * 2 AS INT) AS top, CAST(floor(h0 * 10 / 100 / 2) * 2 AS INT) AS bot FROM a),
        c AS (SELECT *, h0 - top - bot AS rest FROM b), d AS (SELECT *, CAST(floor(least(w0, rest * 16 / 9) / 2) * 2 AS INT) AS w FROM c), e AS (SELECT *, CAST(floor(least(rest, w * 9 / 16) / 2) * 2 AS INT) AS h FROM d)
        SELECT p_partkey, CAST(floor((w0 - w) / 2 / 2) * 2 AS INT) AS x, CAST(top + floor((rest - h) / 2 / 2) * 2 AS INT) AS y, w, h FROM e""",
    ),
    "s3_shared_characters": (
        lambda spark, d: table(spark, d, "nation").alias("a").join(F.broadcast(table(spark, d, "region").alias("b")), F.expr("a.n_regionkey = b.r_regionkey")).select("n_nationkey", F.size(F.array_intersect(F.split("n_name", ""), F.split("r_name", ""))).alias("shared")),
        "SELECT n_nationkey, CAST(len(list_intersect(list_distinct(string_split(n_name, '')), list_distinct(string_split(r_name, '')))) AS INT) AS shared FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "t45_ordered_distinct": (
        lambda spark, d: s.talk(spark, d).groupBy("project").agg(F.sort_array(F.collect_list(F.struct("seq", "speaker"))).alias("r")).select("project", F.array_join(F.array_distinct(F.transform("r", lambda x: x["speaker"])), ",").alias("speakers")),
        f"WITH {s.TALK_SQL}, f AS (SELECT project, speaker, min(seq) AS at FROM talk GROUP BY 1, 2) SELECT project, string_agg(speaker, ',' ORDER BY at) AS speakers FROM f GROUP BY 1".replace("AS at", "AS first").replace("ORDER BY at", "ORDER BY first"),
    ),
    "a9_character_ngrams": (
        lambda spark, d: fusion.ngrams(table(spark, d, "benchmark").select(F.replace("text", F.lit(" "), F.lit("")).alias("x")), "x").select(F.length("gram").alias("n"), "gram", F.col("n").alias("count")),
        "WITH a AS (SELECT n, replace(text, ' ', '') AS x FROM benchmark, (VALUES (2), (3)) v(n)) SELECT n, substring(x, CAST(i AS INT), n) AS gram, count(*) AS count FROM (SELECT n, x, unnest(range(1, length(x) - n + 2)) AS i FROM a) GROUP BY 1, 2",
    ),
    "tl16_karaoke": (
        _of(lambda: t.karaoke("text", F.lit(500))),
        rf"""{_L}, a AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '') AS w FROM turns),
        b AS (SELECT *, greatest(500, len(w) * 10) AS total, list_sum(list_transform(w, lambda x: length(x))) AS chars FROM a),
        c AS (SELECT *, list_transform(w[1:-2], lambda x: CAST(greatest(10, round_even(total * (length(x) / chars), 0)) AS INT)) AS cs FROM b),
        d AS (SELECT *, list_append(cs, CAST(greatest(10, total - coalesce(list_sum(cs), 0)) AS INT)) AS tags FROM c)
        SELECT conv_id, turn, CASE WHEN len(w) = 0 THEN '' ELSE array_to_string(list_transform(range(1, len(w) + 1), lambda i: '{{\kf' || tags[i] || '}}' || w[i]), ' ') END AS out FROM d""",
    ),
    "t12_sentence": (
        _of(lambda: t.sentence("line", "text")),
        rf"""{_L}, a AS (SELECT *, {_NUM.replace("line", _SQUEEZED)} AS bare, regexp_extract(trim(text), '([.!?…。！？])$', 1) AS m FROM turns),
        b AS (SELECT *, CASE WHEN regexp_matches(bare, '[.!?…]$') THEN bare ELSE regexp_replace(bare, '[,;:\s]+$', '') || translate(CASE m WHEN '' THEN '.' ELSE m END, '。！？', '.!?') END AS filled FROM a)
        SELECT conv_id, turn, CASE bare WHEN '' THEN bare ELSE upper(substring(filled, 1, 1)) || substring(filled, 2) END AS out FROM b""",
    ),
    "t13_strip_system_tags": (
        _of(lambda: t.strip_system_tags(F.concat(F.lit("[LOCK 3] "), "text", F.lit(" <i>")))),
        f"{_L} SELECT conv_id, turn, {_SQUEEZED.replace('line', 'text')} AS out FROM turns",
    ),
    "t9_clean_for_voice": (
        _of(lambda: t.clean_for_voice("line")),
        rf"""{_L}, a AS (SELECT *, regexp_replace(regexp_replace({_NUM}, '\s+', ' ', 'g'), ',[,.\s]*,', ',', 'g') AS x FROM turns),
        b AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(x, ',\.+', '.', 'g'), '\.,+', ',', 'g'), '\.{{4,}}', '...', 'g') AS y FROM a)
        SELECT conv_id, turn, regexp_replace(regexp_replace(y, '(^|[^.])\.\.($|[^.])', '\1.\2', 'g'), '(^|[^.])\.\.($|[^.])', '\1.\2', 'g') AS out FROM b""",
    ),
    "t17_best_split": (
        lambda spark, d: turns(spark, d).withColumn("w", F.split("text", " ")).select("conv_id", "turn", t.best_split("w", F.expr("size(w) div 2")).alias("cut")),
        f"""{_L}, a AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM turns), b AS (SELECT *, unnest(range(1, len(w))) AS i FROM a),
        c AS (SELECT conv_id, turn, i, CASE WHEN regexp_matches(w[i], '[,;:]$') THEN 3 ELSE 0 END + CASE WHEN lower(w[i + 1]) IN ('và', 'nhưng', 'thì', 'mà', 'nên', 'vì', 'and', 'but') THEN 2 ELSE 0 END - abs(i - len(w) // 2) AS worth FROM b),
        d AS (SELECT conv_id, turn, arg_min(i, struct_pack(less := -worth, i := i)) AS cut FROM c GROUP BY ALL)
        SELECT conv_id, turn, CAST(coalesce(cut, 0) AS INT) AS cut FROM a LEFT JOIN d USING (conv_id, turn)""",
    ),
}
