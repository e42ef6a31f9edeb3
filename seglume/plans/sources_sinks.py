"""Queries of readers, writers' lines and task events, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seglume.plans import surrogate as s
from seglume.plans.relations import SEGS_SQL, segs
from seglume.sources import files, project_files
from seglume.storage import shared_file
from seglume.streaming import events as ev
from seglume.session import table


def tasks(spark: SparkSession, d: str) -> DataFrame:
    """Events as task events: the status from the type of event."""
    status = F.when(F.col("event_type") == "view", "running").when(F.col("event_type") == "click", "completed").otherwise("failed")
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("task"), F.col("ts").cast("timestamp").alias("at"), status.alias("status"), "event_id", "value", (F.col("user_id") % 9).alias("project"))


_TASKS = """tasks AS (SELECT CAST(user_id AS VARCHAR) AS task, CAST(ts AS TIMESTAMP) AS at_ts, CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'completed' ELSE 'failed' END AS status, event_id, value, user_id % 9 AS project FROM events)"""


def entity_files(spark: SparkSession, d: str) -> DataFrame:
    """A JSON text for each nation, in one of the three shapes."""
    rows = table(spark, d, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_list(F.struct(F.col("c_name").alias("raw"), F.col("c_mktsegment").alias("viet"), F.lit("r").alias("role")))).alias("e"))
    shape = F.col("c_nationkey") % 3
    value = F.when(shape == 0, F.to_json("e")).when(shape == 1, F.to_json(F.struct(F.col("e").alias("entities")))).otherwise(F.to_json(F.struct(F.col("e").alias("characters"), F.lit(None).cast("string").alias("none"))))
    return rows.select("c_nationkey", value.alias("value"))


def payloads(spark: SparkSession, d: str) -> DataFrame:
    rows = s.timed(spark, d).groupBy("project").agg(F.sort_array(F.collect_list(F.struct("seq", "speaker", "start_ms", "end_ms"))).alias("r"))
    part = F.transform("r", lambda x: F.struct(x["speaker"].alias("text"), x["start_ms"].alias("start_time"), x["end_ms"].alias("end_time"), F.array(F.struct(x["speaker"].alias("text"), x["start_ms"].alias("start_time"), x["end_ms"].alias("end_time"))).alias("words")))
    return rows.select("project", F.to_json(F.struct(part.alias("utterances"))).alias("value"))


def _clock(x: str) -> str:
    return f"printf('%02d:%02d:%02d,%03d', {x} // 3600000, {x} // 60000 % 60, {x} // 1000 % 60, {x} % 1000)"


def _srt(spark: SparkSession, d: str) -> DataFrame:
    rows = s.timed(spark, d).withColumn("block", files.srt_text(text="speaker"))
    whole = rows.groupBy("project").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "block"))), lambda x: x["block"]), "\n").alias("value"))
    return files.srt_blocks(whole)


def _at_ms(spark: SparkSession, d: str) -> DataFrame:
    return tasks(spark, d).select("task", F.unix_millis("at").alias("at_ms"), "event_id", "status")


def _mail(spark: SparkSession, d: str) -> DataFrame:
    """Events of nine topics for two subscribers each; every 97th event of a topic is a poll of its subscribers."""
    rows = tasks(spark, d).select(F.col("project").alias("topic"), "at", "event_id", F.col("status").alias("payload"))
    subscribers = rows.select("topic").distinct().select("topic", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("s")).select("topic", F.concat("s", F.col("topic").cast("string")).alias("subscriber"))
    return ev.subscriptions(rows, subscribers).withColumn("poll", F.col("event_id") % F.when(F.col("subscriber").startswith("a"), 97).otherwise(31) == 0)


def _mail_sql(order: str) -> str:
    return f"""WITH {_TASKS}, m AS (SELECT s || project AS subscriber, at_ts, event_id, event_id % CASE s WHEN 'a' THEN 97 ELSE 31 END = 0 AS poll FROM tasks, (VALUES ('a'), ('b')) v(s)),
    t AS (SELECT *, count(*) FILTER (poll) OVER (PARTITION BY subscriber ORDER BY at_ts, event_id) - CAST(poll AS INT) AS turn FROM m),
    k AS (SELECT *, row_number() OVER (PARTITION BY subscriber, turn, poll ORDER BY at_ts {order}, event_id {order}) AS place FROM t)
    SELECT subscriber, max(event_id) FILTER (poll) AS poll_id, coalesce(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY at_ts, event_id) FILTER (NOT poll AND place <= 20), '') AS events, greatest(0, count(*) FILTER (NOT poll) - 20) AS dropped
    FROM k GROUP BY subscriber, turn HAVING count(*) FILTER (poll) > 0"""


_T = f"WITH {s.TIMED_SQL}"


def _tenths(x: str) -> str:
    """Milliseconds as hundredths of a second keep them."""
    return f"({x}) // 1000 * 1000 + least(99, (({x}) % 1000 + 5) // 10) * 10"


def _centi(x: str) -> str:
    return f"printf('%d:%02d:%02d.%02d', ({x}) // 3600000, ({x}) // 60000 % 60, ({x}) // 1000 % 60, least(99, (({x}) % 1000 + 5) // 10))"


def _seconds(x: str) -> str:
    return f"printf('%d.%02d', ({x} + 5) // 1000, ({x} + 5) // 10 % 100)"


def _captions(spark: SparkSession, d: str) -> DataFrame:
    """Translated lines with numbers and stray characters before and in them; every fifth has none."""
    text = F.when(F.col("seq") % 5 != 0, F.concat(F.lit("[3] "), "speaker", F.lit("水 one. 火 two")))
    return s.timed(spark, d).withColumn("translated_text", text)


def _karaoke_back(spark: SparkSession, d: str) -> DataFrame:
    """Written as subtitle files and read again, in a folder of this call."""
    path = shared_file(spark, "karaoke")
    files.write_karaoke(_captions(spark, d), path, tags=False)
    return project_files.read(spark, path, "ass").select("project", "seq", "start_ms", "end_ms", "text")


def _audited(spark: SparkSession, d: str) -> DataFrame:
    length = F.expr("end_ms - start_ms")
    cut = F.expr("seg_id % 3 * 40")
    return s.timed(spark, d).select(
        "project", "seq", "start_ms", "end_ms", length.alias("target_ms"), (length * 2).alias("raw_ms"), (length * 2 - cut).alias("trimmed_ms"), length.alias("voice_ms"), (F.col("seg_id") % 60 + 100).alias("speed_pct"), cut.alias("cut_head_ms"), F.lit(0).alias("cut_tail_ms")
    )


def _audit_back(spark: SparkSession, d: str) -> DataFrame:
    path = shared_file(spark, "audit")
    files.write_audit(_audited(spark, d), path)
    return project_files.read(spark, path, "lines", "json").groupBy("project").agg(F.count("*").alias("lines"))

QUERIES = {
    "src1_stage_scan": (
        lambda spark, d: segs(spark, d).where("stage = 'RAW_ASR'").orderBy("project", "seq").select("project", "seq", "status"),
        f"WITH {SEGS_SQL} SELECT project, seq, status FROM segs WHERE stage = 'RAW_ASR'",
    ),
    "src2_point_lookup": (
        lambda spark, d: table(spark, d, "nation").where("n_nationkey = 7").limit(1).select("n_nationkey", "n_name"),
        "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey = 7 LIMIT 1",
    ),
    "src5_fallback_rows": (
        lambda spark, d: files.with_fallback(segs(spark, d).where("stage = 'RAW_ASR'").select("project", "seq"), segs(spark, d).select("project", "seq")).groupBy("project").agg(F.count("*").alias("n")),
        f"WITH {SEGS_SQL} SELECT project, CASE WHEN count(*) FILTER (stage = 'RAW_ASR') > 0 THEN count(*) FILTER (stage = 'RAW_ASR') ELSE count(*) END AS n FROM segs GROUP BY 1",
    ),
    "src6_entity_files": (
        lambda spark, d: files.entities(entity_files(spark, d)).select("c_nationkey", "raw", "viet", "type", "role"),
        "SELECT c_nationkey, c_name AS raw, c_mktsegment AS viet, 'NAME' AS type, 'r' AS role FROM customer",
    ),
    "src9_ass_dialogues": (
        lambda spark, d: files.ass_dialogues(s.timed(spark, d).select("project", files.ass_text(text="speaker").alias("value"))).select("project", "start_ms", "end_ms", "speaker", "text"),
        f"{_T} SELECT project, start_ms // 1000 * 1000 + least(99, (start_ms % 1000 + 5) // 10) * 10 AS start_ms, end_ms // 1000 * 1000 + least(99, (end_ms % 1000 + 5) // 10) * 10 AS end_ms, speaker, speaker AS text FROM timed",
    ),
    "src10_utterances": (
        lambda spark, d: files.utterances(payloads(spark, d)).select("project", F.col("seq").cast("long").alias("seq"), "text", "start_ms", "end_ms", F.size("words").cast("long").alias("words")),
        f"{_T} SELECT project, seq, speaker AS text, start_ms, end_ms, 1::BIGINT AS words FROM timed",
    ),
    "a5_mean_confidence": (
        lambda spark, d: s.timed(spark, d).groupBy("project").agg(F.collect_list(F.when(F.col("seg_id") % 3 > 0, (F.col("seg_id") % 8) / 8)).alias("w")).select("project", files.mean_confidence(F.col("w")).alias("confidence")),
        f"{_T} SELECT project, coalesce(round(avg((seg_id % 8) / 8) FILTER (seg_id % 3 > 0), 4), -1) AS confidence FROM timed GROUP BY 1",
    ),
    "src12_byte_ranges": (
        lambda spark, d: table(spark, d, "orders").select("o_orderkey", files.byte_range(F.concat(F.lit("bytes="), F.col("o_orderkey").cast("string"), F.lit("-")), F.lit(5000)).alias("r")).select("o_orderkey", "r.first", "r.last"),
        "SELECT o_orderkey, CASE WHEN o_orderkey < 5000 THEN o_orderkey END AS first, CASE WHEN o_orderkey < 5000 THEN 4999 END AS last FROM orders",
    ),
    "snk1_replace_stage": (
        lambda spark, d: files.replace_stage(segs(spark, d).select("project", "seq", "stage"), segs(spark, d).where("project % 4 = 0 and stage = 'RAW_ASR'").select("project", "seq"), "TTS_AUDIO").groupBy("project", "stage").agg(F.count("*").alias("n"), F.max("seq").alias("top")),
        f"""WITH {SEGS_SQL}, r AS (SELECT project, row_number() OVER (PARTITION BY project ORDER BY seq) AS seq, 'TTS_AUDIO' AS stage FROM segs WHERE project % 4 = 0 AND stage = 'RAW_ASR'),
        u AS (SELECT project, seq, stage FROM segs WHERE NOT (stage = 'TTS_AUDIO' AND project IN (SELECT project FROM r)) UNION ALL SELECT * FROM r) SELECT project, stage, count(*) AS n, max(seq) AS top FROM u GROUP BY 1, 2""",
    ),
    "snk3_srt_lines": (
        lambda spark, d: s.timed(spark, d).select("project", "seq", files.srt_text(text="speaker").alias("line")),
        f"{_T} SELECT project, seq, seq || chr(10) || {_clock('start_ms')} || ' --> ' || {_clock('end_ms')} || chr(10) || speaker || chr(10) AS line FROM timed",
    ),
    "snk3_srt_read_back": (_srt, f"{_T} SELECT project, seq, start_ms, end_ms, speaker AS text FROM timed"),
    "snk4_script_lines": (
        lambda spark, d: s.timed(spark, d).select("project", "seq", files.script_text(text="speaker").alias("line")),
        f"{_T} SELECT project, seq, '[' || speaker || '] (' || printf('%d.%02d', (start_ms + 5) // 1000, (start_ms + 5) // 10 % 100) || ' - ' || printf('%d.%02d', (end_ms + 5) // 1000, (end_ms + 5) // 10 % 100) || '): ' || speaker AS line FROM timed",
    ),
    "snk5_json_rows": (
        lambda spark, d: s.timed(spark, d).groupBy("project").agg(F.to_json(F.sort_array(F.collect_list(F.struct("seq", "speaker")))).alias("rows")),
        f"{_T} SELECT project, CAST(to_json(list({{'seq': seq, 'speaker': speaker}} ORDER BY seq)) AS VARCHAR) AS rows FROM timed GROUP BY 1",
    ),
    "snk6_ass_lines": (
        lambda spark, d: s.timed(spark, d).select("project", "seq", files.ass_text(text="speaker").alias("line"), files.mask_text("speaker").alias("mask")),
        f"""{_T}, m AS (SELECT *, greatest(end_ms, start_ms + 200) AS mask_end, least(1920, length(speaker) * 96 + 72) AS wide FROM timed), b AS (SELECT *, (1920 - wide) // 2 AS x FROM m)
        SELECT project, seq, 'Dialogue: 0,' || {_centi('start_ms')} || ',' || {_centi('end_ms')} || ',Main,' || speaker || ',0,0,0,,' || speaker AS line,
          'Dialogue: 0,' || {_centi('start_ms')} || ',' || {_centi('mask_end')} || ',Main,,0,0,0,,{{\\p1}}m ' || x || ' 826 l ' || (x + wide) || ' 826 l ' || (x + wide) || ' 994 l ' || x || ' 994{{\\p0}}' AS mask FROM b""",
    ),
    "snk6_karaoke_lines": (
        lambda spark, d: _captions(spark, d).select("project", "seq", files.karaoke_line(tags=False).alias("line")).where("line is not null"),
        f"""{_T} SELECT project, seq, 'Dialogue: 0,' || {_centi('start_ms')} || ',' || {_centi('greatest(end_ms, start_ms + 300)')} || ',Main,,0,0,0,,' || speaker || ' one. two' AS line FROM timed WHERE seq % 5 <> 0""",
    ),
    "snk6_karaoke_read_back": (_karaoke_back, f"{_T} SELECT CAST(project AS VARCHAR) AS project, row_number() OVER (PARTITION BY project ORDER BY seq) AS seq, {_tenths('start_ms')} AS start_ms, {_tenths('greatest(end_ms, start_ms + 300)')} AS end_ms, speaker || ' one. two' AS text FROM timed WHERE seq % 5 <> 0"),
    "snk9_audit_records": (
        lambda spark, d: _audited(spark, d).select("project", "seq", files.audit_record().alias("record")),
        f"""{_T} SELECT project, seq, '{{"tts_index": ' || seq || ', "start": ' || {_seconds('start_ms')} || ', "end": ' || {_seconds('end_ms')} || ', "target": ' || {_seconds('end_ms - start_ms')} || ', "raw": ' || {_seconds('(end_ms - start_ms) * 2')}
          || ', "trimmed": ' || {_seconds('(end_ms - start_ms) * 2 - seg_id % 3 * 40')} || ', "voice": ' || {_seconds('end_ms - start_ms')} || ', "speed": ' || printf('%d.%02d', (100 + seg_id % 60) // 100, (100 + seg_id % 60) % 100)
          || ', "trimmed_voice": ' || CASE WHEN seg_id % 3 > 0 THEN 'true' ELSE 'false' END || ', "cut_head_ms": ' || seg_id % 3 * 40 || ', "cut_tail_ms": 0}}' AS record FROM timed""",
    ),
    "snk9_audit_read_back": (_audit_back, f"{_T} SELECT CAST(project AS VARCHAR) AS project, count(*) + 2 AS lines FROM timed GROUP BY 1"),
    "snk7_finished_only": (
        lambda spark, d: files.finished_only(segs(spark, d), F.col("status") == "TRANSLATED").select("project", "seq"),
        f"WITH {SEGS_SQL} SELECT project, seq FROM segs WHERE status = 'TRANSLATED'",
    ),
    "snk10_migrate": (
        lambda spark, d: files.migrate(segs(spark, d).drop("status"), segs(spark, d).withColumn("extra", F.lit(1))).select("project", "seq", "status", "extra"),
        f"WITH {SEGS_SQL} SELECT project, seq, NULL::VARCHAR AS status, NULL::INT AS extra FROM segs",
    ),
    "st3_bounded_log": (
        lambda spark, d: ev.bounded_log(tasks(spark, d).select(F.col("project").cast("string").alias("task"), "at", F.col("event_id").alias("line_id"))).groupBy("task").agg(F.count("*").alias("lines"), F.min("line_id").alias("first")),
        f"""WITH {_TASKS}, k AS (SELECT CAST(project AS VARCHAR) AS task, event_id, row_number() OVER (PARTITION BY project ORDER BY at_ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY project) AS n FROM tasks)
        SELECT task, count(*) AS lines, min(event_id) AS first FROM k WHERE k <= CASE WHEN n <= 150 THEN n ELSE 121 + (n - 151) % 30 END GROUP BY 1""",
    ),
    "st4_latest": (
        lambda spark, d: ev.latest(tasks(spark, d)).select("task", "status", "event_id"),
        f"WITH {_TASKS} SELECT task, status, event_id FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY at_ts DESC, event_id DESC) AS k FROM tasks) WHERE k = 1",
    ),
    "st5_prune": (
        lambda spark, d: ev.prune(ev.latest(tasks(spark, d)), F.lit("2024-06-30 00:00:00").cast("timestamp"), 40 * 365 * 86_400, 10).select("task", "status"),
        f"""WITH {_TASKS}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY at_ts DESC, event_id DESC) AS k FROM tasks) WHERE k = 1),
        f AS (SELECT *, row_number() OVER (ORDER BY at_ts DESC, task) AS p FROM l WHERE status <> 'running') SELECT task, status FROM l WHERE status = 'running' UNION ALL SELECT task, status FROM f WHERE p <= 10""",
    ),
    "st6_active_of_project": (
        lambda spark, d: ev.active_of_project(ev.latest(tasks(spark, d))).select("project", "task"),
        f"""WITH {_TASKS}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY at_ts DESC, event_id DESC) AS k FROM tasks) WHERE k = 1)
        SELECT project, task FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY date_trunc('second', at_ts) DESC, task) AS p FROM l WHERE status = 'running') WHERE p = 1""",
    ),
    "a21_active": (
        lambda spark, d: ev.active(ev.latest(tasks(spark, d)), exclude="1"),
        f"""WITH {_TASKS} SELECT count(*) AS active FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY at_ts DESC, event_id DESC) AS k FROM tasks) WHERE k = 1 AND status = 'running' AND task <> '1'""",
    ),
    "st7_paced": (
        lambda spark, d: ev.paced(s.timed(spark, d)).select("project", "seq", "run_ms"),
        f"""WITH RECURSIVE {s.TIMED_SQL}, r AS (SELECT project, seq, start_ms AS run_ms FROM timed WHERE seq = 1 UNION ALL SELECT t.project, t.seq, greatest(t.start_ms, run_ms + 4100) FROM r JOIN timed t ON t.project = r.project AND t.seq = r.seq + 1) SELECT * FROM r""",
    ),
    "st8_gate": (
        lambda spark, d: ev.gate(_at_ms(spark, d), 2, 3_600_000).select("task", "event_id", "failures", "until_ms", "blocked"),
        f"""WITH {_TASKS}, e AS (SELECT task, epoch_us(at_ts) // 1000 AS at_ms, event_id, status FROM tasks), i AS (SELECT *, count(*) FILTER (status = 'completed') OVER w AS island FROM e WINDOW w AS (PARTITION BY task ORDER BY at_ms, event_id)),
        f AS (SELECT *, count(*) FILTER (status = 'failed') OVER (PARTITION BY task, island ORDER BY at_ms, event_id) AS failures FROM i),
        u AS (SELECT *, coalesce(max(CASE WHEN status = 'failed' AND failures >= 2 THEN at_ms + 3600000 END) OVER (PARTITION BY task, island ORDER BY at_ms, event_id), 0) AS until_ms FROM f)
        SELECT task, event_id, failures, until_ms, coalesce(at_ms < lag(until_ms) OVER (PARTITION BY task ORDER BY at_ms, event_id), false) AS blocked FROM u""",
    ),
    "st1_deliveries": (
        lambda spark, d: ev.deliveries(_mail(spark, d), 20).select("subscriber", "poll_id", F.array_join("event_ids", ",").alias("events"), "dropped"),
        _mail_sql("DESC"),
    ),
    "st1_deliveries_when_full": (
        lambda spark, d: ev.deliveries(_mail(spark, d), 20, "oldest").select("subscriber", "poll_id", F.array_join("event_ids", ",").alias("events"), "dropped"),
        _mail_sql("ASC"),
    ),
    "st9_progress": (
        lambda spark, d: s.timed(spark, d).select("seg_id", ev.progress(F.col("seg_id") % 101, 20, 60).alias("pct")),
        f"{_T} SELECT seg_id, least(60.0, greatest(20.0, 20 + seg_id % 101 * 40 / 100)) AS pct FROM timed",
    ),
    "st10_poll_delay": (
        lambda spark, d: s.timed(spark, d).select("seg_id", ev.poll_delay(F.col("seg_id") % 7, 1000).alias("delay")),
        f"{_T} SELECT seg_id, CASE WHEN seg_id % 7 >= 5 THEN 8000 ELSE least(10000, CAST(round(1000 * pow(1.8, seg_id % 7)) AS BIGINT)) END AS delay FROM timed",
    ),
}
