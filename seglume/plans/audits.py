"""Queries of audits, rescue, voice lines and what is left of the inventory, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seglume.functions import parsing
from seglume.functions import text as t
from seglume.operators import audit as au
from seglume.operators import relational as r
from seglume.operators import timeline as tl
from seglume.plans import lineages, relations, surrogate as s
from seglume.plans.texts import turns
from seglume.session import table

_T = f"WITH {s.TIMED_SQL}"
_I = f"{_T}, {lineages.ITEMS_SQL}"


def batches(spark: SparkSession, d: str) -> DataFrame:
    """Timed segments in batches of eight with a text each; some batches break off."""
    text = F.when((F.expr("(seq - 1) div 8 % 3") == 1) & (F.expr("(seq - 1) % 8") >= 4), "").otherwise(F.concat_ws(" ", "speaker", F.repeat(F.lit("word "), (F.col("seg_id") % 13).cast("int"))))
    return s.timed(spark, d).withColumn("batch", F.expr("(seq - 1) div 8")).withColumn("translated_text", text)


_B = """b AS (SELECT *, (seq - 1) // 8 AS batch, CASE WHEN (seq - 1) // 8 % 3 = 1 AND (seq - 1) % 8 >= 4 THEN '' ELSE speaker || ' ' || repeat('word ', CAST(seg_id % 13 AS INT)) END AS translated_text FROM timed)"""


def _windows(spark: SparkSession, d: str) -> DataFrame:
    from seglume.operators.lineage import retry_windows

    return retry_windows(lineages.items(spark, d), F.col("bad")).withColumn("retry_count", (F.col("lo") % 4).cast("int"))


def _attempts(spark: SparkSession, d: str) -> DataFrame:
    return s.timed(spark, d).select("project", F.expr("(seq - 1) div 3").alias("batch"), F.col("seq").alias("attempt"), (F.col("seg_id") % 3).alias("coverage"), (F.col("seg_id") % 2).alias("errors"))


QUERIES = {
    "t8_for_voice": (lambda spark, d: turns(spark, d).select("conv_id", "turn", t.for_voice("line").alias("out")), None),
    "t11_value_of_json": (
        lambda spark, d: turns(spark, d).select("conv_id", "turn", t.value_of_json(F.concat(F.lit('{"i": 3, "vi": "'), "role", F.lit('"}'))).alias("out")),
        "SELECT conv_id, turn, role AS out FROM conversations",
    ),
    "a20_genre": (
        lambda spark, d: s.talk(spark, d).where("seq <= 35").groupBy("project").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ").alias("x")).select("project", t.genre("x", (("water", ("river", "sea")), ("time", ("year", "day")))).alias("genre")),
        f"""WITH {s.TALK_SQL}, x AS (SELECT project, lower(string_agg(text, ' ' ORDER BY seq)) AS x FROM talk WHERE seq <= 35 GROUP BY 1)
        SELECT project, CASE WHEN regexp_matches(x, 'river|sea') THEN 'water' WHEN regexp_matches(x, 'year|day') THEN 'time' ELSE 'xianxia' END AS genre FROM x""",
    ),
    "t41_profile": (
        lambda spark, d: table(spark, d, "orders").select("o_orderkey", F.coalesce(F.element_at(F.create_map(F.lit("F"), F.lit("final"), F.lit("O"), F.lit("open")), F.col("o_orderstatus")), F.lit("default")).alias("profile")),
        "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'default' END AS profile FROM orders",
    ),
    "t24_clean_name": (
        lambda spark, d: table(spark, d, "nation").select("n_nationkey", t.clean_name(F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("tên: 王 "), "n_name")).otherwise("王"), F.lit("王"), F.create_map(F.lit("王"), F.lit("vương"))).alias("out")),
        "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'Vương' END AS out FROM nation",
    ),
    "t21_rough_translation": (
        lambda spark, d: table(spark, d, "part").select("p_partkey", parsing.texts(lambda x: parsing.Matcher.of({"STEEL": "thép", "STANDARD": "chuẩn"}).replace(x))("p_type").alias("out")),
        "SELECT p_partkey, regexp_replace(regexp_replace(p_type, '\\bSTEEL\\b', 'thép', 'gi'), '\\bSTANDARD\\b', 'chuẩn', 'gi') AS out FROM part",
    ),
    "tl14_demerge_by_duration": (
        lambda spark, d: tl.allocate(s.timed(spark, d).withColumn("item", F.expr("(seq - 1) div 3")).withColumn("dur", F.expr("end_ms - start_ms")).withColumn("words", F.lit(20)).withColumn("zero", F.lit(0)), "dur", "words", "zero", ["project", "item"], "seq").select("project", "seq", F.expr("part_end - part_start").cast("long").alias("words")),
        f"""{_T}, a AS (SELECT project, seq, (seq - 1) // 3 AS item, end_ms - start_ms AS w FROM timed), b AS (SELECT *, sum(w) OVER (PARTITION BY project, item) AS total FROM a),
        c AS (SELECT *, CAST((20 * w * 2 + total) // (total * 2) AS BIGINT) AS share, lead(seq) OVER (PARTITION BY project, item ORDER BY seq) AS nx FROM b)
        SELECT project, seq, CAST(CASE WHEN nx IS NULL THEN 20 - coalesce(sum(share) OVER (PARTITION BY project, item ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE share END AS BIGINT) AS words FROM c""",
    ),
    "tl23_shared_source_split": (
        lambda spark, d: tl.allocate(s.timed(spark, d).select("project", "seq", "start_ms", F.expr("end_ms - start_ms").alias("span"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("part")), "part", "span", "start_ms", ["project", "seq"], "part").select("project", "seq", "part", "part_start", "part_end"),
        f"""{_T}, a AS (SELECT project, seq, start_ms, end_ms - start_ms AS span, k AS part, (2 * (end_ms - start_ms) * k + 6) // 12 AS share FROM timed, (VALUES (1), (2), (3)) v(k)),
        b AS (SELECT *, start_ms + coalesce(sum(share) OVER (PARTITION BY project, seq ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ps FROM a)
        SELECT project, seq, part, CAST(ps AS BIGINT) AS part_start, CAST(CASE WHEN part = 3 THEN start_ms + span ELSE ps + share END AS BIGINT) AS part_end FROM b""",
    ),
    "tl28_truncated_tails": (
        lambda spark, d: au.truncated_tails(batches(spark, d)),
        f"""{_T}, {_B}, k AS (SELECT project, batch, count(*) AS n, max(seq) AS top, max(seq) FILTER (trim(translated_text) <> '') AS last_seq, arg_max(end_ms, seq) AS e, arg_max(end_ms, seq) FILTER (trim(translated_text) <> '') AS reach FROM b GROUP BY 1, 2)
        SELECT project, batch, last_seq FROM k WHERE n >= 5 AND top - last_seq >= 4 AND (top - last_seq) * 4 >= n AND reach < e - 250""",
    ),
    "tl28_too_fast": (
        lambda spark, d: au.too_fast(batches(spark, d).withColumn("end_ms", F.expr("start_ms + 1600"))).select("project", "seq"),
        rf"{_T}, {_B} SELECT project, seq FROM b WHERE len(regexp_extract_all(translated_text, '[^\s]+')) > 6.4",
    ),
    "tl28_audit": (lambda spark, d: au.audit(batches(spark, d), "translated_text", "seg_id"), None),
    "tl29_big_gaps": (
        lambda spark, d: au.big_gaps(lineages.items(spark, d), s.timed(spark, d)),
        f"""{_I}, g AS (SELECT e.project, e.item, e.seq, lead(start_ms) OVER (PARTITION BY e.project, e.item ORDER BY e.seq) - end_ms AS gap FROM edges e JOIN timed t ON t.project = e.project AND t.seq = e.seq)
        SELECT project, item, min(seq) AS seq, arg_min(gap, seq) AS gap FROM g WHERE gap >= 850 GROUP BY 1, 2""",
    ),
    "tl33_child_times": (
        lambda spark, d: au.child_times(s.timed(spark, d).select("project", F.col("seq").alias("piece"), F.expr("end_ms - start_ms").alias("len_ms")), s.timed(spark, d).select("project", F.col("seq").alias("piece"), F.lit(10).alias("start_ms"), F.lit(40).alias("end_ms"))),
        f"""{_T}, a AS (SELECT project, seq AS piece, coalesce(sum(end_ms - start_ms) OVER (PARTITION BY project ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_ms FROM timed)
        SELECT project, piece, CAST(at_ms + 10 AS BIGINT) AS start_ms, CAST(at_ms + 40 AS BIGINT) AS end_ms FROM a""",
    ),
    "al9_one_to_one": (lambda spark, d: au.one_to_one(s.talk(spark, d).select("project", "seq", F.col("text").alias("line")), s.talk(spark, d).select("project", "seq", F.expr("substring(text, 2) as text"))), None),
    "al12_quarantine": (
        lambda spark, d: au.quarantine(lineages.items(spark, d), _windows(spark, d)).groupBy("project").agg(F.count_if("quarantined").alias("apart"), F.count("*").alias("items")).select("project", "items", (F.col("apart") <= F.col("items")).alias("sane")),
        f"{_I} SELECT project, count(*) AS items, true AS sane FROM items GROUP BY 1",
    ),
    "l2_sorted": (
        lambda spark, d: s.timed(spark, d).selectExpr("project", "seg_id", "row_number() over (partition by project order by start_ms, end_ms, seg_id) as place"),
        f"{_T} SELECT project, seg_id, CAST(row_number() OVER (PARTITION BY project ORDER BY start_ms, end_ms, seg_id) AS INT) AS place FROM timed",
    ),
    "l5_best_attempt": (
        lambda spark, d: au.best_attempt(_attempts(spark, d)),
        f"""{_T} SELECT project, batch, attempt, coverage, errors FROM (SELECT project, (seq - 1) // 3 AS batch, seq AS attempt, seg_id % 3 AS coverage, seg_id % 2 AS errors,
        row_number() OVER (PARTITION BY project, (seq - 1) // 3 ORDER BY seg_id % 3 DESC, seg_id % 2, seq) AS n FROM timed) WHERE n = 1""",
    ),
    "l6_work_order": (
        lambda spark, d: s.timed(spark, d).withColumn("priority", F.col("start_ms") - F.when(F.col("seg_id") % 10 == 0, 100_000_000).otherwise(0)).selectExpr("project", "seg_id", "row_number() over (partition by project order by priority, seg_id) as place"),
        f"{_T} SELECT project, seg_id, CAST(row_number() OVER (PARTITION BY project ORDER BY start_ms - CASE WHEN seg_id % 10 = 0 THEN 100000000 ELSE 0 END, seg_id) AS INT) AS place FROM timed",
    ),
    "l7_longest_first": (
        lambda spark, d: r.clean_fixes(table(spark, d, "part").select(F.col("p_type").alias("old"), F.col("p_brand").alias("new"), F.col("p_partkey").alias("pos"))).selectExpr("old", "length(old) as size"),
        "SELECT DISTINCT trim(p_type) AS old, length(trim(p_type)) AS size FROM part",
    ),
    "j17_drop_entities": (
        lambda spark, d: relations.entities(spark, d).join(relations.entities(spark, d).where("batch = 2").select("raw", "gender").distinct(), ["raw", "gender"], "left_anti").select("raw", "gender", "pos"),
        f"WITH {relations.ENT_SQL} SELECT raw, gender, pos FROM ent WHERE (raw, gender) NOT IN (SELECT (raw, gender) FROM ent WHERE batch = 2)",
    ),
    "e5_propagate": (
        lambda spark, d: r.replace_texts(relations.segs(spark, d), "status", [("raw", "Source")]).groupBy("new_text", "changed").agg(F.count("*").alias("n")),
        f"WITH {relations.SEGS_SQL} SELECT CASE status WHEN 'RAW' THEN 'Source' ELSE status END AS new_text, status = 'RAW' AS changed, count(*) AS n FROM segs GROUP BY 1, 2",
    ),
    "e6_locked_entities": (
        lambda spark, d: au.locked(relations.entities(spark, d).select("raw", "batch", "pos"), relations.entities(spark, d).where("raw = 'BUILDING' and batch = 5").select("raw", "batch", "pos")).select("raw", "pos", "is_locked"),
        f"""WITH {relations.ENT_SQL}, u AS (SELECT raw, batch, pos, false AS is_locked FROM ent UNION ALL SELECT raw, batch, pos, true FROM ent WHERE raw = 'BUILDING' AND batch = 5)
        SELECT raw, pos, is_locked FROM (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY is_locked DESC, batch, pos) AS n FROM u) WHERE n = 1""",
    ),
    "m6_restore": (
        lambda spark, d: au.restore_from(relations.segs(spark, d).where("stage = 'TTS_AUDIO' and not (project % 5 = 0 and seq = 1)").select("project", "seq"), relations.segs(spark, d).where("stage = 'TTS_AUDIO'").select("project", "seq")).groupBy("project").agg(F.count("*").alias("n")),
        f"WITH {relations.SEGS_SQL} SELECT project, count(*) AS n FROM segs WHERE stage = 'TTS_AUDIO' GROUP BY 1",
    ),
    "a22_partial_sums": (
        lambda spark, d: au.column_counts(s.timed(spark, d), "project", views=F.col("speaker") == "view", clicks=F.col("speaker") == "click"),
        f"{_T} SELECT project, count(*) FILTER (speaker = 'view') AS views, count(*) FILTER (speaker = 'click') AS clicks FROM timed GROUP BY 1",
    ),
}
