"""Queries of the timeline operators over events read as timed segments, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seglume.operators import timeline as t
from seglume.plans import surrogate as s

TOTAL_MS = 300_000
PACED = "*, 3 + seg_id % 17 AS words, (end_ms - start_ms) * (8 + seg_id % 9) // 10 + 40 AS raw_ms"


def paced(spark: SparkSession, d: str) -> DataFrame:
    """Timed segments with a number of words and the length of a recorded voice."""
    return s.timed(spark, d).withColumn("words", F.col("seg_id") % 17 + 3).withColumn("raw_ms", F.expr("(end_ms - start_ms) * (8 + seg_id % 9) div 10 + 40"))


def lengths(spark: SparkSession, d: str) -> DataFrame:
    return s.timed(spark, d).groupBy("project").agg(F.max("end_ms").alias("duration"))


_T = f"WITH {s.TIMED_SQL}"
_W = "(PARTITION BY project ORDER BY seq)"
_B = "(PARTITION BY project ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_LEN = f"{_T}, p AS (SELECT project, max(end_ms) AS duration FROM timed GROUP BY 1)"

_FIT = f"""{_T}, a AS (SELECT {PACED}, coalesce(lead(start_ms) OVER {_W}, {TOTAL_MS}) AS next_start, greatest(100, end_ms - start_ms) AS base_ms FROM timed),
b AS (SELECT *, base_ms + CASE WHEN raw_ms * 100 > base_ms * 110 AND next_start - end_ms > 1 THEN least(greatest(0, raw_ms * 100 // 110 - base_ms), next_start - end_ms) ELSE 0 END AS target_ms FROM a),
c AS (SELECT *, CASE WHEN raw_ms * 100 > target_ms * 120 THEN (raw_ms * 10 - target_ms * 12 + 5) // 10 ELSE 0 END AS need FROM b),
e AS (SELECT *, least(140, (need * 2 + 3) // 6) AS cut_head, least(140, need - (need * 2 + 3) // 6) AS cut_tail FROM c),
f AS (SELECT *, greatest(50, raw_ms - cut_head - cut_tail) AS trimmed_ms FROM e),
g AS (SELECT *, greatest(110, (trimmed_ms * 200 + target_ms) // (target_ms * 2)) AS speed_pct FROM f)"""

QUERIES = {
    "w1_renumber": (
        lambda spark, d: t.renumber(s.timed(spark, d).where("speaker <> 'view'")).select("project", "seg_id", "seq"),
        f"{_T} SELECT project, seg_id, row_number() OVER {_W} AS seq FROM timed WHERE speaker <> 'view'",
    ),
    "w2_gap_after": (
        lambda spark, d: t.gap_after(s.timed(spark, d), TOTAL_MS).select("project", "seq", "gap_ms"),
        f"{_T} SELECT project, seq, coalesce(lead(start_ms) OVER {_W}, {TOTAL_MS}) - end_ms AS gap_ms FROM timed",
    ),
    "w3_drop_repeats": (
        lambda spark, d: t.drop_repeats(s.timed(spark, d), "speaker", 1).select("project", "seq", "speaker"),
        f"""{_T}, m AS (SELECT *, lag(lower(trim(speaker))) OVER {_W} AS was FROM timed)
        SELECT project, seq, speaker FROM m WHERE was IS NULL OR was <> lower(trim(speaker))""",
    ),
    "w4_repeated_neighbours": (
        lambda spark, d: t.repeated_neighbours(s.timed(spark, d), "speaker", "seg_id").select("project", "seq", "next_source"),
        f"""{_T}, m AS (SELECT *, lead(speaker) OVER {_W} AS nt, lead(seg_id) OVER {_W} AS next_source FROM timed)
        SELECT project, seq, next_source FROM m WHERE nt = speaker AND next_source <> seg_id""",
    ),
    "w5_clamp_monotone": (
        lambda spark, d: t.clamp_monotone(s.timed(spark, d)).select("project", "seq", "clamped_start", "clamped_end"),
        f"""{_T}, m AS (SELECT *, max(greatest(start_ms, end_ms)) OVER {_W} AS clamped_end FROM timed)
        SELECT project, seq, greatest(start_ms, coalesce(lag(clamped_end) OVER {_W}, start_ms)) AS clamped_start, clamped_end FROM m""",
    ),
    "w6_clamp_with_least": (
        lambda spark, d: t.clamp_with_least(s.timed(spark, d), 100).select("project", "seq", "clamped_start", "clamped_end"),
        f"""WITH RECURSIVE {s.TIMED_SQL}, r AS (SELECT project, seq, start_ms AS clamped_start, greatest(end_ms, start_ms + 100) AS clamped_end FROM timed WHERE seq = 1
          UNION ALL SELECT t.project, t.seq, greatest(t.start_ms, r.clamped_end), greatest(t.end_ms, greatest(t.start_ms, r.clamped_end) + 100)
          FROM r JOIN timed t ON t.project = r.project AND t.seq = r.seq + 1) SELECT * FROM r""",
    ),
    "w7_offsets": (
        lambda spark, d: t.offsets(s.talk(spark, d), "dur_ms").select("project", "seq", "offset_ms"),
        f"WITH {s.TALK_SQL} SELECT project, seq, CAST(coalesce(sum(dur_ms) OVER {_B}, 0) AS BIGINT) AS offset_ms FROM talk",
    ),
    "w7_offsets_in_chunks": (
        lambda spark, d: t.chunked_prefix(s.timed(spark, d).withColumn("len", F.expr("end_ms - start_ms")), "project", "seq", "len", "sum", 16).select("project", "seq", "prefix"),
        f"{_T} SELECT project, seq, CAST(sum(end_ms - start_ms) OVER {_B} AS BIGINT) AS prefix FROM timed",
    ),
    "w8_first_by_key": (
        lambda spark, d: t.first_by_key(s.timed(spark, d), ["project", "speaker"], ["seq"]).select("project", "speaker", "seq"),
        f"{_T} SELECT project, speaker, min(seq) AS seq FROM timed GROUP BY 1, 2",
    ),
    "w9_context_of_batches": (
        lambda spark, d: t.context_of_batches(s.timed(spark, d), 20, 4),
        f"""{_T}, m AS (SELECT project, seq, (seq - 1) // 20 AS b, row_number() OVER (PARTITION BY project, (seq - 1) // 20 ORDER BY seq DESC) AS place FROM timed)
        SELECT project, b + 1 AS batch, place, seq FROM m WHERE place <= 4 AND EXISTS (SELECT 1 FROM m x WHERE x.project = m.project AND x.b = m.b + 1)""",
    ),
    "w10_runs": (
        lambda spark, d: t.runs(s.timed(spark, d).where("speaker <> 'click'")).select("project", "first", "last", "n"),
        f"""{_T}, m AS (SELECT project, seq, seq - row_number() OVER {_W} AS run FROM timed WHERE speaker <> 'click')
        SELECT project, min(seq) AS first, max(seq) AS last, count(*) AS n FROM m GROUP BY project, run""",
    ),
    "w11_union_intervals": (
        lambda spark, d: t.union_intervals(t.runs(s.timed(spark, d).where("seg_id % 5 = 0")).select("project", F.expr("greatest(1, first - 1)").alias("lo"), F.expr("last + 1").alias("hi"))),
        f"""{_T}, m AS (SELECT project, seq, seq - row_number() OVER {_W} AS run FROM timed WHERE seg_id % 5 = 0),
        i AS (SELECT project, greatest(1, min(seq) - 1) AS lo, max(seq) + 1 AS hi FROM m GROUP BY project, run),
        g AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY project ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM i),
        k AS (SELECT *, sum(fresh) OVER (PARTITION BY project ORDER BY lo) AS part FROM g) SELECT project, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM k GROUP BY project, part""",
    ),
    "w12_sandwiched": (
        lambda spark, d: t.sandwiched(s.timed(spark, d).withColumn("covered", F.expr("seg_id % 4 <> 0")), "covered").select("project", "seq"),
        f"""{_T}, m AS (SELECT *, seg_id % 4 <> 0 AS covered, lag(seg_id % 4 <> 0) OVER {_W} AS l, lead(seg_id % 4 <> 0) OVER {_W} AS r FROM timed)
        SELECT project, seq FROM m WHERE NOT covered AND l AND r""",
    ),
    "w13_order_violations": (
        lambda spark, d: t.order_violations(s.timed(spark, d).withColumn("src", F.expr("seq + seg_id % 3")), "src", "src").select("project", "seq", "src", "furthest"),
        f"{_T}, m AS (SELECT project, seq, seq + seg_id % 3 AS src, max(seq + seg_id % 3) OVER {_B} AS furthest FROM timed) SELECT * FROM m WHERE src < furthest",
    ),
    "tl3_sanitize": (
        lambda spark, d: t.sanitize(s.timed(spark, d), 120_000).select("project", "seg_id", "clean_start", "clean_end", "clamped", "overlap_fixed", "gap_ms", "large_gap"),
        f"""{_T}, a AS (SELECT project, seg_id, start_ms, end_ms, row_number() OVER (PARTITION BY project ORDER BY start_ms, end_ms, seq) AS n, greatest(0, least(start_ms, 120000)) AS cs FROM timed),
        b AS (SELECT *, greatest(cs + 50, least(end_ms, 120000)) AS e, lead(cs) OVER (PARTITION BY project ORDER BY n) AS nx FROM a),
        c AS (SELECT *, CASE WHEN e > nx THEN greatest(cs + 50, nx) ELSE e END AS clean_end FROM b)
        SELECT project, seg_id, cs AS clean_start, clean_end, cs <> start_ms OR e <> end_ms AS clamped, coalesce(e > nx, false) AS overlap_fixed, nx - clean_end AS gap_ms, coalesce(nx - clean_end >= 10000, false) AS large_gap FROM c""",
    ),
    "a6_timeline_stats": (
        lambda spark, d: t.timeline_stats(t.sanitize(s.timed(spark, d), 120_000)),
        f"""{_T}, a AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY start_ms, end_ms, seq) AS n, greatest(0, least(start_ms, 120000)) AS cs FROM timed),
        b AS (SELECT *, greatest(cs + 50, least(end_ms, 120000)) AS e, lead(cs) OVER (PARTITION BY project ORDER BY n) AS nx FROM a)
        SELECT project, count(*) FILTER (cs <> start_ms OR e <> end_ms) AS clamped, count(*) FILTER (e > nx) AS "overlaps",
          count(*) FILTER (nx - CASE WHEN e > nx THEN greatest(cs + 50, nx) ELSE e END >= 10000) AS large_gaps, CAST(sum(e - cs) AS BIGINT) AS spoken_ms FROM b GROUP BY 1""",
    ),
    "tl11_session_windows": (
        lambda spark, d: t.sessions(s.timed(spark, d)),
        f"""{_T}, m AS (SELECT *, CASE WHEN start_ms - max(end_ms) OVER {_B} < 10000 THEN 0 ELSE 1 END AS fresh FROM timed),
        k AS (SELECT *, CAST(sum(fresh) OVER {_W} AS BIGINT) AS session FROM m)
        SELECT project, session, greatest(0, min(start_ms) - 350) AS win_start, greatest(greatest(0, min(start_ms) - 350) + 100, max(end_ms) + 450) AS win_end, min(seq) AS first_seq, max(seq) AS last_seq FROM k GROUP BY 1, 2""",
    ),
    "tl15_clause_allocation": (
        lambda spark, d: t.allocate(paced(spark, d).withColumn("item", F.expr("(seq - 1) div 4")).withColumn("span", F.lit(7000)).withColumn("at", F.expr("item * 7000")), "words", "span", "at", ["project", "item"], "seq").select("project", "seq", "part_start", "part_end"),
        f"""{_T}, a AS (SELECT project, seq, (seq - 1) // 4 AS item, 3 + seg_id % 17 AS w FROM timed),
        b AS (SELECT *, sum(w) OVER (PARTITION BY project, item) AS total FROM a), c AS (SELECT *, CAST((7000 * w * 2 + total) // (total * 2) AS BIGINT) AS share FROM b),
        e AS (SELECT *, item * 7000 + coalesce(sum(share) OVER (PARTITION BY project, item ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ps, lead(seq) OVER (PARTITION BY project, item ORDER BY seq) AS nx FROM c)
        SELECT project, seq, CAST(ps AS BIGINT) AS part_start, CAST(CASE WHEN nx IS NULL THEN item * 7000 + 7000 ELSE ps + share END AS BIGINT) AS part_end FROM e""",
    ),
    "tl18_borrow_gap": (
        lambda spark, d: t.fit_voice(paced(spark, d), "raw_ms", TOTAL_MS).select("project", "seq", "base_ms", "target_ms"),
        f"{_FIT} SELECT project, seq, base_ms, target_ms FROM g",
    ),
    "tl19_trim_plan": (
        lambda spark, d: t.fit_voice(paced(spark, d), "raw_ms", TOTAL_MS).select("project", "seq", "cut_head", "cut_tail", "trimmed_ms"),
        f"{_FIT} SELECT project, seq, cut_head, cut_tail, trimmed_ms FROM g",
    ),
    "tl20_fit_voice": (
        lambda spark, d: t.fit_voice(paced(spark, d), "raw_ms", TOTAL_MS).select("project", "seq", "speed_pct", "fitted_end"),
        f"{_FIT} SELECT project, seq, speed_pct, least(start_ms + trimmed_ms * 100 // speed_pct, greatest(next_start, start_ms)) AS fitted_end FROM g",
    ),
    "a7_voice_summary": (
        lambda spark, d: t.fit_voice(paced(spark, d), "raw_ms", TOTAL_MS).groupBy("project").agg(
            F.count_if(F.col("speed_pct") == 110).alias("natural"), F.count_if(F.col("speed_pct") > 110).alias("stretched"), F.count_if(F.expr("cut_head + cut_tail > 0")).alias("trimmed"), F.avg("speed_pct").alias("mean_pct")
        ),
        f"{_FIT} SELECT project, count(*) FILTER (speed_pct = 110) AS natural, count(*) FILTER (speed_pct > 110) AS stretched, count(*) FILTER (cut_head + cut_tail > 0) AS trimmed, avg(speed_pct) AS mean_pct FROM g GROUP BY 1",
    ),
    "tl21_swollen": (
        lambda spark, d: paced(spark, d).where(t.swollen("raw_ms", "words")).select("project", "seq"),
        f"""{_T} SELECT project, seq FROM (SELECT {PACED} FROM timed) WHERE raw_ms * 100 > (end_ms - start_ms) * 130 AND (raw_ms - 250) * 100 > (end_ms - start_ms) * 115
        AND end_ms - start_ms BETWEEN 1 AND 10000 AND words <= 60""",
    ),
    "tl24_ceilings": (
        lambda spark, d: t.ceilings(s.timed(spark, d)).select("project", "seq", "e_max"),
        f"""{_T}, m AS (SELECT *, lead(start_ms) OVER {_W} AS nx FROM timed) SELECT project, seq,
        greatest(end_ms, CASE WHEN nx IS NULL THEN end_ms + 400 WHEN nx - end_ms >= 850 THEN least(end_ms + 400, nx - 80) ELSE nx - 80 END) AS e_max FROM m""",
    ),
    "tl24_ceilings_over_junk": (
        lambda spark, d: t.ceilings_over_junk(s.timed(spark, d).withColumn("junk", F.col("speaker") == "view"), "junk").select("project", "seq", "e_max_ext"),
        f"""{_T}, m AS (SELECT *, lead(start_ms) OVER {_W} AS nx, max(seq) OVER (PARTITION BY project) AS n FROM timed),
        e AS (SELECT *, greatest(end_ms, CASE WHEN nx IS NULL THEN end_ms + 400 WHEN nx - end_ms >= 850 THEN least(end_ms + 400, nx - 80) ELSE nx - 80 END) AS e_max FROM m),
        k AS (SELECT project, seq, start_ms - lag(end_ms) OVER {_W} AS gap, lag(end_ms) OVER {_W} AS was, start_ms, speaker FROM timed),
        v AS (SELECT project, seq, CASE WHEN gap >= 850 THEN least(was + 400, start_ms - 80) ELSE start_ms - 80 END AS v FROM k WHERE gap >= 850 OR speaker <> 'view'),
        f AS (SELECT e.project, e.seq, e.end_ms, e.e_max, coalesce((SELECT arg_min(v.v, v.seq) FROM v WHERE v.project = e.project AND v.seq > e.seq),
          (SELECT arg_max(t.end_ms, t.seq) FROM timed t WHERE t.project = e.project) + 400) AS lim FROM e)
        SELECT project, seq, greatest(e_max, least(lim, end_ms + 1000)) AS e_max_ext FROM f""",
    ),
    "tl27_speech_rate": (
        lambda spark, d: t.speech_rate(paced(spark, d), "words").select("project", "seq", "wps", "too_fast", "severity"),
        f"""{_T}, m AS (SELECT project, seq, (3 + seg_id % 17) / (greatest(end_ms - start_ms, 1) / 1000) AS wps FROM timed)
        SELECT *, wps / 3.3::DOUBLE > 1.6::DOUBLE AS too_fast, CAST(CASE WHEN wps / 3.3::DOUBLE > 3.2::DOUBLE THEN 2 WHEN wps / 3.3::DOUBLE > 1.6::DOUBLE THEN 1 ELSE 0 END AS INT) AS severity FROM m""",
    ),
    "tl30_slice_plan": (
        lambda spark, d: t.slice_plan(lengths(spark, d).withColumn("duration", F.expr("duration * 8")), "duration").select("project", "slice", "slice_start", "slice_ms"),
        f"""{_LEN}, q AS (SELECT project, duration * 8 AS d, CASE WHEN duration * 8 <= 300000 THEN greatest(30000, CAST(ceil(duration * 8 / 4) AS BIGINT)) WHEN duration * 8 <= 1800000 THEN 150000 ELSE 300000 END AS len FROM p),
        x AS (SELECT project, d, len, unnest(range(0, greatest(1, CAST(ceil(d / len) AS BIGINT)))) AS slice FROM q)
        SELECT project, slice, slice * len AS slice_start, least(len, d - slice * len) AS slice_ms FROM x""",
    ),
    "src11_overlapping_chunks": (
        lambda spark, d: t.overlapping_chunks(lengths(spark, d), "duration", 20_000, 3_000).select("project", "chunk", "chunk_start", "chunk_end"),
        f"""{_LEN}, x AS (SELECT project, duration, unnest(range(0, 1 + greatest(0, CAST(ceil((duration - 20000) / 17000) AS BIGINT)))) AS chunk FROM p)
        SELECT project, chunk, chunk * 17000 AS chunk_start, least(chunk * 17000 + 20000, duration) AS chunk_end FROM x""",
    ),
    "tl34_shift": (
        lambda spark, d: t.shift(s.timed(spark, d), 5_000).select("project", "seq", "new_start", "new_end"),
        f"{_T} SELECT project, seq, greatest(0, start_ms - 5000) AS new_start, greatest(greatest(0, start_ms - 5000) + 80, end_ms - 5000) AS new_end FROM timed",
    ),
}
