"""Queries of normal forms, forward windows, like texts and the smaller text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seglume.functions import parsing, similarity, text as t, unicode as u
from seglume.operators import forward, fusion, similar, sounds
from seglume.plans import surrogate as s
from seglume.plans.sequences import _broken_json
from seglume.session import table
from seglume.sources import files, project_files
from seglume.storage import shared_file

_T = f"WITH {s.TIMED_SQL}"
_TALK = f"WITH {s.TALK_SQL}"


def _window(spark: SparkSession, d: str) -> DataFrame:
    rows = s.timed(spark, d).select("project", (F.col("seq") - 1).alias("pos"), (F.col("seg_id") % 3 == 0).alias("junk"), (F.col("seg_id") % 5 == 0).alias("taken"))
    starts = rows.where("pos % 4 = 0").select("project", F.col("pos").alias("item"), F.col("pos").alias("start_pos"))
    return forward.forward_window(starts, rows)


def _names(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Short names of one region, and the same with a word changed."""
    base = table(spark, d, "customer").select((F.col("c_nationkey") % 5).alias("key"), F.col("c_custkey").alias("id"), F.concat_ws(" ", F.lower("c_mktsegment"), F.substring("c_name", -6, 6)).alias("text")).where("id % 3 = 0")
    return base.where("id % 2 = 0"), base.where("id % 2 = 1")


def _voices(spark: SparkSession, d: str) -> DataFrame:
    """Catalogues of voices, a list a nation, written and read again."""
    path = shared_file(spark, "voices")
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_nationkey") % 2 == 0, "VI").otherwise("en").alias("lan"), F.col("c_nationkey").alias("nation"))
    project_files.write(rows, F.to_json(F.struct("id", "name", "lan")), path, "json", key="nation", order=("id",), head="[", joint=",", tail="]")
    return files.voices(spark, path, "vi").select("id", "name", "lan")


def _chapters(spark: SparkSession, d: str) -> DataFrame:
    lines = F.concat_ws("\n", F.lit("Chương 7: 第一章 看著"), F.lit("www.site.com"), F.col("n_name"), F.lit("1200 字"), F.lit("（求月票！）这麼"), F.lit("2024-01-02 10:11"), F.lit("本章完"), F.lit("ＰＳ"), F.lit("end"))
    return table(spark, d, "nation").select("n_nationkey", t.chapter(lines).alias("c")).select("n_nationkey", "c.title", "c.body")


def _sounds(spark: SparkSession, d: str) -> DataFrame:
    """Short words spelled by letters, some of which have two sounds."""
    table_ = spark.createDataFrame([("c", "ka"), ("c", "sa"), ("k", "ka"), ("s", "sa"), ("g", "ga"), ("g", "ja"), ("j", "ja"), ("i", "i"), ("y", "i"), ("y", "ya"), ("d", "ta"), ("t", "ta"), ("e", "e"), ("a", "e")], "char string, syllable string")
    names = table(spark, d, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("text")).where("length(text) between 3 and 5")
    return sounds.sounded(names.distinct().select(F.xxhash64("text").alias("id"), "text"), table_)


def _sound_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Each name against the one after it in order."""
    rows = _sounds(spark, d).selectExpr("text as a", "sounds as x", "lead(text) over (partition by length(text) order by text) as b", "lead(sounds) over (partition by length(text) order by text) as y")
    return rows.where("b is not null").select("a", "b", sounds.sound_likeness("x", "y").alias("likeness"))


QUERIES = {
    "t25_homophones": (lambda spark, d: sounds.homophones(_sounds(spark, d)), None),
    "t25_sound_likeness": (_sound_pairs, None),
    "j15_forward_window": (
        _window,
        f"""{_T}, r AS (SELECT project, seq - 1 AS pos, seg_id % 3 = 0 AS junk, seg_id % 5 = 0 AS taken FROM timed),
        k AS (SELECT a.project, a.pos AS item, b.pos, row_number() OVER w - 1 AS place, count(*) FILTER (NOT b.junk) OVER (PARTITION BY a.project, a.pos ORDER BY b.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS content
          FROM r a JOIN r b ON a.project = b.project AND b.pos >= a.pos AND NOT b.taken WHERE a.pos % 4 = 0 WINDOW w AS (PARTITION BY a.project, a.pos ORDER BY b.pos))
        SELECT project, item, pos, place FROM k WHERE place < 16 AND content < 8""",
    ),
    "t1_source_key": (
        lambda spark, d: table(spark, d, "part").select("p_partkey", u.source_key(F.concat(F.lit("［12］. "), F.lit("ＡＢ第二十"), F.element_at(F.array(*map(F.lit, "一二三")), (F.col("p_partkey") % 3 + 1).cast("int")), F.lit("個ﬁ "), "p_brand")).alias("out")),
        "SELECT p_partkey, 'ab第2' || (p_partkey % 3 + 1) || '个fi' || lower(replace(p_brand, '#', '')) AS out FROM part",
    ),
    "t3_cjk_key": (
        lambda spark, d: table(spark, d, "nation").select("n_nationkey", u.cjk_key(F.concat(F.lit("這、個 "), "n_name", F.lit("!車"))).alias("out")),
        "SELECT n_nationkey, '这个' || replace(replace(n_name, ' ', ''), '_', '') || '车' AS out FROM nation",
    ),
    "t5_chapter": (
        _chapters,
        "SELECT n_nationkey, '第一章 看着' AS title, n_name || '这么' || 'ＰＳ' || 'end' AS body FROM nation",
    ),
    "t42_similar_pairs": (
        lambda spark, d: similar.similar(*_names(spark, d)),
        None,
    ),
    "a20_weighted_genre": (
        lambda spark, d: s.talk(spark, d).where("seq <= 35").groupBy("project").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ").alias("x")).select("project", t.genre_by_weight("x", (("e", (("ea", 2), ("er", 1))), ("o", (("ou", 3), ("or", 1))))).alias("genre")),
        f"""{_TALK}, x AS (SELECT project, lower(string_agg(text, ' ' ORDER BY seq)) AS x FROM talk WHERE seq <= 35 GROUP BY 1),
        w AS (SELECT project, 2 * len(regexp_extract_all(x, 'ea')) + len(regexp_extract_all(x, 'er')) AS e, 3 * len(regexp_extract_all(x, 'ou')) + len(regexp_extract_all(x, 'or')) AS o FROM x)
        SELECT project, CASE WHEN e = 0 AND o = 0 THEN 'xianxia' WHEN e >= o THEN 'e' ELSE 'o' END AS genre FROM w""",
    ),
    "t23_names": (
        lambda spark, d: table(spark, d, "nation").select("n_nationkey", t.reading_of_name(F.when(F.col("n_nationkey") % 3 == 0, "黑王").otherwise(F.concat(F.lit("王-"), "n_name", F.lit("李x"))), F.create_map(F.lit("王"), F.lit("vương"), F.lit("李"), F.lit("lý")), F.create_map(F.lit("黑王"), F.lit("Vua Đen"))).alias("out")),
        "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'Vua Đen' ELSE 'Vương -' || n_name || ' Lý x' END AS out FROM nation",
    ),
    "src7_voices": (_voices, "SELECT c_custkey AS id, c_name AS name, 'VI' AS lan FROM customer WHERE c_nationkey % 2 = 0"),
    "al3_shared": (
        lambda spark, d: s.talk(spark, d).selectExpr("project", "seq", "substring(text, 1, 60) as a", "substring(lead(text) over (partition by project order by seq), 1, 60) as b").select("project", "seq", similarity.of_columns(similarity.subsequence)(F.col("a"), F.col("b")).cast("long").alias("in_order"), similarity.of_columns(similarity.stretch)(F.col("a"), F.col("b")).cast("long").alias("in_a_row")),
        None,
    ),
    "al4_short_matches": (
        lambda spark, d: s.timed(spark, d).selectExpr("project", "seq", "speaker as a", "lead(speaker) over (partition by project order by seq) as b").select("project", "seq", similarity.of_columns(similarity.short_match)(F.substring("a", 1, 4), F.col("b")).cast("boolean").alias("fits")),
        f"{_T} SELECT project, seq, coalesce(b = speaker AND length(b) <= 7, false) AS fits FROM (SELECT *, lead(speaker) OVER (PARTITION BY project ORDER BY seq) AS b FROM timed)",
    ),
    "t28_near_in_text": (
        lambda spark, d: fusion.near_in_text(s.talk(spark, d).select("project", "seq", F.substring("text", 3, 20).alias("heard"), F.substring("text", 1, 40).alias("seen")), "heard", "seen").select("project", "seq", "likeness"),
        f"{_TALK} SELECT project, seq, 1.0::DOUBLE AS likeness FROM talk WHERE length(text) >= 3",
    ),
    "t30_loaded_json": (
        lambda spark, d: _broken_json(spark, d).select("project", F.explode(F.from_json(parsing.texts(parsing.json_text)("raw"), "array<struct<src:long,role:string,vi:string>>")).alias("r")).select("project", "r.src", "r.role", "r.vi"),
        "SELECT conv_id AS project, turn + 1 AS src, role, text AS vi FROM conversations",
    ),
}
