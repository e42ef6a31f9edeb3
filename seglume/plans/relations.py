"""Queries of filters, paging, lookups, edits and entities, with their SQL.

Projects are orders, their segments line items; entities are customers (name of a segment as the raw name), dictionaries
come from parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seglume.operators import relational as r
from seglume.plans import progress, surrogate as s
from seglume.session import table

PROJECTS_SQL = "projects AS (SELECT o_orderkey AS project, o_orderpriority AS title, o_orderstatus AS status, CAST(o_orderdate AS TIMESTAMP) AS created_at FROM orders)"
SEGS_SQL = """segs AS (SELECT l_orderkey AS project, CAST(l_linenumber AS BIGINT) AS seq, CASE l_returnflag WHEN 'A' THEN 'TRANSLATED' WHEN 'R' THEN 'RAW' ELSE 'MERGED_CHILD' END AS status,
  CASE WHEN l_linestatus = 'F' THEN '' WHEN l_quantity < 10 THEN NULL ELSE l_linestatus END AS translated_text, CASE WHEN l_linenumber % 3 = 0 THEN 'RAW_ASR' ELSE 'TTS_AUDIO' END AS stage FROM lineitem)"""
ENT_SQL = """ent AS (SELECT c_mktsegment AS raw, CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 5 = 0 THEN NULL ELSE c_name END AS viet, CASE WHEN c_custkey % 4 = 0 THEN '-' ELSE 'g' || (c_custkey % 7) END AS gender,
  c_nationkey AS batch, c_custkey AS pos FROM customer)"""
_P, _S, _E = f"WITH {PROJECTS_SQL}", f"WITH {SEGS_SQL}", f"WITH {ENT_SQL}"
_A = "(status IN ('TRANSLATED','DUBBED','SILENT_VALID') OR coalesce(translated_text, '') <> '')"


def projects(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("project"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("timestamp").alias("created_at"))


def segs(spark: SparkSession, d: str) -> DataFrame:
    flag, line = F.col("l_returnflag"), F.col("l_linestatus")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("project"), F.col("l_linenumber").cast("long").alias("seq"), F.when(flag == "A", "TRANSLATED").when(flag == "R", "RAW").otherwise("MERGED_CHILD").alias("status"),
        F.when(line == "F", "").when(F.col("l_quantity") < 10, None).otherwise(line).alias("translated_text"), F.when(F.col("l_linenumber") % 3 == 0, "RAW_ASR").otherwise("TTS_AUDIO").alias("stage"),
    )


def entities(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        F.col("c_mktsegment").alias("raw"), F.when(k % 3 == 0, "").when(k % 5 == 0, None).otherwise(F.col("c_name")).alias("viet"),
        F.when(k % 4 == 0, "-").otherwise(F.concat(F.lit("g"), (k % 7).cast("string"))).alias("gender"), F.col("c_nationkey").alias("batch"), k.alias("pos"),
    )


def _page_of_projects(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """The page is cut first, so counts are made for its projects only."""
    one = r.page(rows, [F.col("created_at").desc(), "project"], 2, 50).withColumnRenamed("total", "projects")
    return r.with_counts(one, lines.join(F.broadcast(one.select("project")), "project", "left_semi"), progress.translated_a()).select("project", "title", "total", "done", "projects", "pages", r.iso_or_empty("created_at").alias("created_at"))


def _lookup(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part")
    keys = parts.select("p_brand").distinct().unionByName(spark.sql("SELECT 'none' AS p_brand"))
    small = parts.where("p_size < 3").select("p_brand", "p_type")
    return r.lookup_chain(keys, "p_brand", (small, "p_brand", "p_type"), (parts.where("p_size > 40"), "p_brand", "p_name"), (spark.sql("SELECT 'none' AS k, 'default' AS v"), "k", "v"))


def _as_of(spark: SparkSession, d: str) -> DataFrame:
    rows = s.timed(spark, d)
    return r.as_of(rows.where("speaker = 'click'").select("project", "seq", "start_ms"), rows.where("speaker = 'view'").select("project", F.col("seg_id").alias("view_id"), F.col("start_ms").alias("at")), "project", "start_ms", "view_id", "at")


QUERIES = {
    "p1_only": (
        lambda spark, d: r.only(projects(spark, d), "status", "F").select("project", "status"),
        f"{_P} SELECT project, status FROM projects WHERE status = 'F'",
    ),
    "p1_only_all": (
        lambda spark, d: r.only(projects(spark, d), "status", "ALL").agg(F.count("*").alias("n")),
        "SELECT count(*) AS n FROM orders",
    ),
    "p2_search": (
        lambda spark, d: r.search(projects(spark, d), ["title", "status"], "high").select("project", "title"),
        f"{_P} SELECT project, title FROM projects WHERE title ILIKE '%high%' OR status ILIKE '%high%'",
    ),
    "p3_p6_translated_counts": (
        lambda spark, d: s.work(spark, d).groupBy("project").agg(
            F.count_if(progress.translated_a()).alias("a"), F.count_if(progress.translated_b()).alias("b"), F.count_if(progress.translated_c()).alias("c"), F.count_if(progress.translated_d()).alias("d")
        ),
        f"""WITH {s.WORK_SQL} SELECT project, count(*) FILTER (status IN ('TRANSLATED','DUBBED','SILENT_VALID') OR coalesce(translated_text,'') <> '') AS a,
        count(*) FILTER (status IN ('TRANSLATED','DUBBED','SILENT_VALID','MERGED_CHILD') OR coalesce(translated_text,'') <> '') AS b,
        count(*) FILTER (status IN ('TRANSLATED','DUBBED','SILENT_VALID') OR translated_text IS NOT NULL) AS c,
        count(*) FILTER (trim(coalesce(translated_text,'')) <> '' OR status IN ('TRANSLATED','DUBBED','SILENT_VALID','MERGED_CHILD')) AS d FROM work GROUP BY 1""",
    ),
    "p7_display_columns": (
        lambda spark, d: projects(spark, d).select("project", (F.col("status") == "F").alias("has_final"), r.iso_or_empty("created_at").alias("created_at")),
        f"{_P} SELECT project, status = 'F' AS has_final, coalesce(strftime(created_at, '%Y-%m-%dT%H:%M:%S'), '') AS created_at FROM projects",
    ),
    "p8_first_text": (
        lambda spark, d: segs(spark, d).select("project", "seq", r.first_text("translated_text", "status").alias("text")),
        f"{_S} SELECT project, seq, coalesce(nullif(translated_text, ''), nullif(status, ''), '') AS text FROM segs",
    ),
    "p9_batch_of_page": (
        lambda spark, d: r.batch_of_page(s.work(spark, d), 1, 50).select("project", "seq", "status"),
        f"WITH {s.WORK_SQL} SELECT project, seq, status FROM work WHERE seq BETWEEN 51 AND 100",
    ),
    "p10_end_or_default": (
        lambda spark, d: s.timed(spark, d).withColumn("end_ms", F.when(F.col("seg_id") % 7 == 0, None).when(F.col("seg_id") % 5 == 0, F.col("start_ms")).otherwise(F.col("end_ms"))).select("project", "seq", r.end_or_default("start_ms", "end_ms").alias("end_ms")),
        f"WITH {s.TIMED_SQL} SELECT project, seq, CASE WHEN seg_id % 7 = 0 OR seg_id % 5 = 0 OR end_ms <= start_ms THEN start_ms + 1000 ELSE end_ms END AS end_ms FROM timed",
    ),
    "p11_contains_with_facet": (
        lambda spark, d: r.contains(entities(spark, d), ["raw", "viet", "gender"], "00001", "gender", "g1").select("raw", "viet", "pos"),
        f"{_E} SELECT raw, viet, pos FROM ent WHERE contains(lower(concat_ws('\x01', raw, viet, gender)), '00001') AND gender = 'g1'",
    ),
    "p12_gallery_facets": (
        lambda spark, d: r.facets(r.with_counts(projects(spark, d), segs(spark, d), progress.translated_a()), raw=F.col("done") == 0, translated=(F.col("done") > 0) & (F.col("status") != "F"), completed=F.col("status") == "F"),
        f"""{_P}, {SEGS_SQL}, n AS (SELECT p.project, any_value(p.status) AS status, count(g.project) FILTER ({_A.replace('status IN', 'g.status IN')}) AS done FROM projects p LEFT JOIN segs g ON g.project = p.project GROUP BY 1)
        SELECT count(*) FILTER (done = 0) AS raw, count(*) FILTER (done > 0 AND status <> 'F') AS translated, count(*) FILTER (status = 'F') AS completed, count(*) AS every FROM n""",
    ),
    "p13_facet_counts": (
        lambda spark, d: entities(spark, d).groupBy("gender").agg(F.count("*").alias("n")),
        f"{_E} SELECT gender, count(*) AS n FROM ent GROUP BY 1",
    ),
    "p14_split_by_type": (
        lambda spark, d: r.facets(entities(spark, d), names=F.col("gender") == "g1", others=F.col("gender") != "g1"),
        f"{_E} SELECT count(*) FILTER (gender = 'g1') AS names, count(*) FILTER (gender <> 'g1') AS others, count(*) AS every FROM ent",
    ),
    "l1_list_projects": (
        lambda spark, d: _page_of_projects(r.search(r.only(projects(spark, d), "status", "O"), ["title"], "urgent"), segs(spark, d)),
        f"""{_P}, {SEGS_SQL}, f AS (SELECT * FROM projects WHERE status = 'O' AND title ILIKE '%urgent%'),
        one AS (SELECT *, (SELECT count(*) FROM f) AS projects FROM f ORDER BY created_at DESC, project LIMIT 50 OFFSET 50),
        n AS (SELECT project, count(*) AS total, count(*) FILTER ({_A}) AS done FROM segs GROUP BY 1)
        SELECT one.project, title, coalesce(total, 0) AS total, coalesce(done, 0) AS done, projects, greatest(1, (projects + 49) // 50) AS pages, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at FROM one LEFT JOIN n ON n.project = one.project""",
    ),
    "l3_top_one": (
        lambda spark, d: r.pick(s.timed(spark, d).withColumn("score", F.expr("end_ms - start_ms")), ["project"], -F.col("score"), "seg_id").select("project", "seg_id", "score"),
        f"WITH {s.TIMED_SQL} SELECT project, seg_id, score FROM (SELECT *, end_ms - start_ms AS score, row_number() OVER (PARTITION BY project ORDER BY end_ms - start_ms DESC, seg_id) AS n FROM timed) WHERE n = 1",
    ),
    "l4_best_two": (
        lambda spark, d: r.best_two(s.timed(spark, d).withColumn("score", F.expr("end_ms - start_ms")), ["project", "speaker"], "score", "seg_id"),
        f"""WITH {s.TIMED_SQL}, m AS (SELECT project, speaker, end_ms - start_ms AS score, row_number() OVER (PARTITION BY project, speaker ORDER BY end_ms - start_ms DESC, seg_id) AS n FROM timed)
        SELECT project, speaker, max(score) FILTER (n = 1) AS best, max(score) FILTER (n = 2) AS second, max(score) FILTER (n = 1) - max(score) FILTER (n = 2) AS margin FROM m GROUP BY 1, 2""",
    ),
    "j2_project_counts": (
        lambda spark, d: r.with_counts(projects(spark, d).select("project"), segs(spark, d), progress.translated_a()),
        f"{_P}, {SEGS_SQL}, n AS (SELECT project, count(*) AS total, count(*) FILTER ({_A}) AS done FROM segs GROUP BY 1) SELECT p.project, coalesce(total, 0) AS total, coalesce(done, 0) AS done FROM projects p LEFT JOIN n ON n.project = p.project",
    ),
    "j11_lookup_chain": (
        _lookup,
        """WITH k AS (SELECT DISTINCT p_brand FROM part UNION ALL SELECT 'none') SELECT p_brand, coalesce((SELECT min(p_type) FROM part x WHERE x.p_brand = k.p_brand AND p_size < 3),
        (SELECT min(p_name) FROM part x WHERE x.p_brand = k.p_brand AND p_size > 40), CASE WHEN p_brand = 'none' THEN 'default' END) AS found FROM k""",
    ),
    "j12_zip_rows": (
        lambda spark, d: r.zip_rows(s.timed(spark, d).where("speaker = 'click'").select("project", "seq"), s.timed(spark, d).where("speaker = 'view'").select("project", "seq")),
        f"""WITH {s.TIMED_SQL}, a AS (SELECT project, seq, row_number() OVER (PARTITION BY project ORDER BY seq) AS place FROM timed WHERE speaker = 'click'),
        b AS (SELECT project, seq AS right_seq, row_number() OVER (PARTITION BY project ORDER BY seq) AS place FROM timed WHERE speaker = 'view') SELECT a.project, CAST(a.place AS INT) AS place, seq, right_seq FROM a JOIN b ON a.project = b.project AND a.place = b.place""",
    ),
    "j14_as_of": (
        _as_of,
        f"""WITH {s.TIMED_SQL}, a AS (SELECT project, seq, start_ms FROM timed WHERE speaker = 'click'), b AS (SELECT project, start_ms, max(seg_id) AS view_id FROM timed WHERE speaker = 'view' GROUP BY 1, 2)
        SELECT a.project, a.seq, a.start_ms, b.view_id FROM a ASOF LEFT JOIN b ON a.project = b.project AND a.start_ms >= b.start_ms""",
    ),
    "j16_missing": (
        lambda spark, d: projects(spark, d).join(segs(spark, d).where("status = 'TRANSLATED'"), "project", "left_anti").select("project"),
        f"{_P}, {SEGS_SQL} SELECT project FROM projects WHERE project NOT IN (SELECT project FROM segs WHERE status = 'TRANSLATED')",
    ),
    "j5_projects_with_voice": (
        lambda spark, d: projects(spark, d).join(segs(spark, d).where("stage = 'TTS_AUDIO' and status = 'RAW'"), "project", "left_semi").select("project"),
        f"{_P}, {SEGS_SQL} SELECT project FROM projects p WHERE EXISTS (SELECT 1 FROM segs g WHERE g.project = p.project AND stage = 'TTS_AUDIO' AND status = 'RAW')",
    ),
    "j20_resolve_voice": (
        lambda spark, d: r.lookup_chain(table(spark, d, "nation").select("n_name"), "n_name", (table(spark, d, "nation").where("n_regionkey = 1"), "n_name", "n_nationkey"), (table(spark, d, "nation").where("n_regionkey = 2"), "n_name", "n_regionkey")).select("n_name", F.coalesce("found", F.lit(-1)).alias("voice")),
        "SELECT n_name, CASE n_regionkey WHEN 1 THEN n_nationkey WHEN 2 THEN n_regionkey ELSE -1 END AS voice FROM nation",
    ),
    "a8_batch_completion": (
        lambda spark, d: progress.batch_progress(s.work(spark, d), 50).select("project", "batch", (F.col("done") * 100 >= F.col("total") * 95).alias("complete"), (F.col("done") * 100 >= F.col("total") * 98).alias("resumable")),
        f"""WITH {s.WORK_SQL}, n AS (SELECT project, (seq-1)//50 AS batch, count(*) AS total, count(*) FILTER (status IN ('TRANSLATED','DUBBED','SILENT_VALID','MERGED_CHILD') OR coalesce(translated_text,'') <> '') AS done FROM work GROUP BY 1, 2)
        SELECT project, batch, done * 100 >= total * 95 AS complete, done * 100 >= total * 98 AS resumable FROM n""",
    ),
    "a4_continue_numbers": (
        lambda spark, d: r.continue_numbers(segs(spark, d).where("stage = 'TTS_AUDIO'"), segs(spark, d).where("stage = 'RAW_ASR'").withColumn("old", F.col("seq"))).select("project", "old", "seq"),
        f"""{_S}, m AS (SELECT project, max(seq) AS top FROM segs WHERE stage = 'TTS_AUDIO' GROUP BY 1)
        SELECT g.project, seq AS old, coalesce(top, 0) + row_number() OVER (PARTITION BY g.project ORDER BY seq) AS seq FROM segs g LEFT JOIN m ON m.project = g.project WHERE stage = 'RAW_ASR'""",
    ),
    "a15_rows_by_batch": (
        lambda spark, d: s.work(spark, d).groupBy("project", F.expr("(seq - 1) div 50").alias("batch")).agg(F.sort_array(F.collect_list("seq")).alias("rows")).select("project", "batch", F.array_join("rows", ",").alias("rows")),
        f"WITH {s.WORK_SQL} SELECT project, (seq-1)//50 AS batch, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) AS rows FROM work GROUP BY 1, 2",
    ),
    "a19_distinct": (
        lambda spark, d: s.timed(spark, d).groupBy("project").agg(F.count_distinct("speaker").alias("speakers")),
        f"WITH {s.TIMED_SQL} SELECT project, count(DISTINCT speaker) AS speakers FROM timed GROUP BY 1",
    ),
    "a17_median_and_percentile": (
        lambda spark, d: s.timed(spark, d).groupBy("speaker").agg(F.median(F.expr("end_ms - start_ms")).alias("middle"), F.percentile(F.expr("end_ms - start_ms"), 0.9).alias("p90")),
        f"WITH {s.TIMED_SQL} SELECT speaker, median(end_ms - start_ms) AS middle, quantile_cont(end_ms - start_ms, 0.9) AS p90 FROM timed GROUP BY 1",
    ),
    "m1_clear_translations": (
        lambda spark, d: r.clear_translations(segs(spark, d), F.col("seq") % 2 == 0).select("project", "seq", "status", "translated_text"),
        f"{_S} SELECT project, seq, CASE WHEN seq % 2 = 0 THEN 'RAW' ELSE status END AS status, CASE WHEN seq % 2 = 0 THEN NULL ELSE translated_text END AS translated_text FROM segs",
    ),
    "m3_status_after_reset": (
        lambda spark, d: r.status_after_reset(projects(spark, d).select("project"), segs(spark, d).where("project % 5 <> 0"), progress.translated_a()).select("project", "state"),
        f"""{_P}, {SEGS_SQL}, n AS (SELECT project, count(*) AS total, count(*) FILTER ({_A}) AS done FROM segs WHERE project % 5 <> 0 GROUP BY 1)
        SELECT p.project, CASE WHEN coalesce(done, 0) > 0 THEN 'TRANSLATED' WHEN coalesce(total, 0) > 0 THEN 'TRANSCRIBED' ELSE 'DOWNLOADED' END AS state FROM projects p LEFT JOIN n ON n.project = p.project""",
    ),
    "m4_drop_projects": (
        lambda spark, d: r.drop_projects({"segs": segs(spark, d)}, projects(spark, d).where("status = 'O'"))["segs"].groupBy("status").agg(F.count("*").alias("n")),
        f"{_P}, {SEGS_SQL} SELECT status, count(*) AS n FROM segs WHERE project NOT IN (SELECT project FROM projects WHERE status = 'O') GROUP BY 1",
    ),
    "snk2_drop_from_batch": (
        lambda spark, d: r.drop_from_batch(segs(spark, d), ["TTS_AUDIO"], 1, 3).select("project", "seq", "stage"),
        f"{_S} SELECT project, seq, stage FROM segs WHERE NOT (stage = 'TTS_AUDIO' AND (seq - 1) // 3 >= 1)",
    ),
    "src3_dictionary_head": (
        lambda spark, d: table(spark, d, "part").orderBy("p_partkey").limit(5000).agg(F.count("*").alias("n"), F.max("p_partkey").alias("last")),
        "SELECT count(*) AS n, max(p_partkey) AS last FROM (SELECT p_partkey FROM part ORDER BY 1 LIMIT 5000)",
    ),
    "src4_scoped_dictionary": (
        lambda spark, d: r.scoped(table(spark, d, "customer").withColumn("scope", F.when(F.col("c_nationkey") > 4, F.col("c_nationkey"))), "scope", 7).select("c_custkey", "scope"),
        "SELECT c_custkey, CASE WHEN c_nationkey > 4 THEN c_nationkey END AS scope FROM customer WHERE c_nationkey <= 4 OR c_nationkey = 7",
    ),
    "t19_replace_texts": (
        lambda spark, d: r.replace_texts(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", [("standard", "Plain"), ("STEEL", "Iron"), ("plain", "Simple")]).select("p_partkey", "new_text", "changed"),
        "SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(p_type, 'standard', 'Plain', 'gi'), 'STEEL', 'Iron', 'gi'), 'plain', 'Simple', 'gi') AS new_text, p_type <> new_text AS changed FROM part",
    ),
    "e1_clean_entities": (
        lambda spark, d: r.clean_entities(entities(spark, d), spark.sql("SELECT 'BUILDING' AS raw, 'held' AS viet")).select("raw", "viet", "pos"),
        f"{_E} SELECT raw, CASE WHEN raw = 'BUILDING' THEN 'held' ELSE viet END AS viet, pos FROM (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY batch, pos) AS n FROM ent) WHERE n = 1",
    ),
    "e2_clean_fixes": (
        lambda spark, d: r.clean_fixes(table(spark, d, "part").select(F.col("p_brand").alias("old"), F.col("p_type").alias("new"), F.col("p_partkey").alias("pos"))).select("old", "new"),
        "SELECT old, new FROM (SELECT trim(p_brand) AS old, trim(p_type) AS new, row_number() OVER (PARTITION BY trim(p_brand) ORDER BY p_partkey) AS n FROM part WHERE length(trim(p_brand)) >= 2 AND trim(p_brand) <> trim(p_type)) WHERE n = 1",
    ),
    "e3_accumulate": (
        lambda spark, d: r.accumulate(entities(spark, d), ["gender"]),
        f"""{_E} SELECT raw, arg_min(viet, batch * 1000000 + pos) FILTER (viet <> '') AS viet, arg_min(gender, batch * 1000000 + pos) FILTER (trim(gender) NOT IN ('', '-')) AS gender FROM ent GROUP BY 1""",
    ),
    "e4_context_table": (
        lambda spark, d: r.accumulate(entities(spark, d), ["gender"]).groupBy("gender").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(" | ", "raw", "viet"))), "\n").alias("lines")),
        f"""{_E}, a AS (SELECT raw, arg_min(viet, batch * 1000000 + pos) FILTER (viet <> '') AS viet, arg_min(gender, batch * 1000000 + pos) FILTER (trim(gender) NOT IN ('', '-')) AS gender FROM ent GROUP BY 1)
        SELECT gender, string_agg(concat_ws(' | ', raw, viet), chr(10) ORDER BY concat_ws(' | ', raw, viet)) AS lines FROM a GROUP BY 1""",
    ),
    "s1_union_with_priority": (
        lambda spark, d: r.union_with_priority(entities(spark, d).where("batch = 3").select("raw", "pos"), entities(spark, d).select("raw", "pos"), keys=["raw"]),
        f"{_E}, u AS (SELECT raw, pos, CASE WHEN batch = 3 THEN 0 ELSE 1 END AS k FROM ent) SELECT raw, pos FROM (SELECT *, row_number() OVER (PARTITION BY raw ORDER BY k, pos) AS n FROM u) WHERE n = 1",
    ),
    "s2_uncovered": (
        lambda spark, d: s.timed(spark, d).select("project", "seq").exceptAll(s.timed(spark, d).where("seg_id % 4 <> 0").select("project", "seq")),
        f"WITH {s.TIMED_SQL} SELECT project, seq FROM timed WHERE seg_id % 4 = 0",
    ),
}
