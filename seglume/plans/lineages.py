"""Queries of time joins and of lineage between stages, with their SQL.

Items are made of three timed segments each (a few are left out, a few are named by the next item as well).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seglume.operators import intervals as iv
from seglume.operators import lineage as ln
from seglume.plans import surrogate as s

ITEMS_SQL = """pre AS (SELECT project, (seq - 1) // 3 + 1 AS item, seq, seg_id FROM timed WHERE seg_id % 17 <> 0
  UNION ALL SELECT project, (seq - 1) // 3 + 2 AS item, seq, seg_id FROM timed WHERE seg_id % 23 = 0),
items AS (SELECT project, item, list(seq ORDER BY seq) AS src, CASE WHEN max(seg_id) % 7 = 0 THEN ['LOW_MATCH x', 'soft'] WHEN max(seg_id) % 5 = 0 THEN ['soft', 'fast'] ELSE ['ok'] END AS flags, max(seg_id) % 7 = 0 AS bad FROM pre GROUP BY 1, 2),
edges AS (SELECT DISTINCT project, item, seq FROM pre)"""
BLOCKS_SQL = "blocks AS (SELECT project, seg_id AS block_id, start_ms + 120 AS block_start, end_ms + 120 AS block_end FROM timed WHERE seg_id % 5 <> 0)"
_T = f"WITH {s.TIMED_SQL}"
_I = f"{_T}, {ITEMS_SQL}"
_J = f"{_T}, {BLOCKS_SQL}"


def items(spark: SparkSession, d: str) -> DataFrame:
    rows = s.timed(spark, d)
    item = F.expr("(seq - 1) div 3 + 1").alias("item")
    named = rows.where("seg_id % 17 <> 0").select("project", item, "seq", "seg_id").unionByName(rows.where("seg_id % 23 = 0").select("project", F.expr("(seq - 1) div 3 + 2").alias("item"), "seq", "seg_id"))
    out = named.groupBy("project", "item").agg(F.sort_array(F.collect_list("seq")).alias("src"), F.max("seg_id").alias("top"))
    flags = F.when(F.col("top") % 7 == 0, F.array(F.lit("LOW_MATCH x"), F.lit("soft"))).when(F.col("top") % 5 == 0, F.array(F.lit("soft"), F.lit("fast"))).otherwise(F.array(F.lit("ok")))
    return out.select("project", "item", "src", flags.alias("flags"), (F.col("top") % 7 == 0).alias("bad"))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return s.timed(spark, d).where("seg_id % 5 <> 0").select("project", F.col("seg_id").alias("block_id"), (F.col("start_ms") + 120).alias("block_start"), (F.col("end_ms") + 120).alias("block_end"))


def _slices(spark: SparkSession, d: str) -> DataFrame:
    ends = s.timed(spark, d).groupBy("project").agg(F.max("end_ms").alias("e"))
    return ends.select("project", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("e div 7000"))).alias("slice")).withColumn("slice_start", F.expr("slice * 7000")).withColumn("slice_end", F.expr("slice * 7000 + 7000"))


def _words(spark: SparkSession, d: str) -> DataFrame:
    return iv.words_in_segments(s.timed(spark, d), blocks(spark, d).select("project", F.col("block_start").alias("word_start"), F.col("block_end").alias("word_end")))


_WORDS = f"""{_J}, w AS (SELECT t.project, t.seq, min(block_start) AS first_word, max(block_end) AS last_word, count(*) AS n_words FROM timed t JOIN blocks b ON t.project = b.project
  AND ((block_start + block_end BETWEEN 2 * (start_ms - 150) AND 2 * (end_ms + 150)) OR (block_start >= start_ms - 100 AND block_end <= end_ms + 100)) GROUP BY 1, 2),
v AS (SELECT t.*, first_word, last_word, coalesce(n_words, 0) AS n_words FROM timed t LEFT JOIN w ON w.project = t.project AND w.seq = t.seq)"""


def _targets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = s.timed(spark, d)
    targets = rows.where("seg_id % 3 = 0").select("project", F.col("seg_id").alias("target_id"), F.col("start_ms").alias("at"), F.expr("start_ms - 20").alias("from_ms"), F.expr("start_ms + 60").alias("to_ms"))
    return targets, rows.where("seg_id % 3 <> 0").select("project", F.col("seg_id").alias("row_id"), F.col("start_ms").alias("row_at"))


def _edits(spark: SparkSession, d: str) -> DataFrame:
    edited = items(spark, d).where("item % 4 = 0").select("project", "item", F.when(F.col("item") % 8 == 0, "").otherwise("new text").alias("text"))
    segs = s.timed(spark, d).select("project", "seq", F.col("speaker").alias("translated_text"), F.lit("RAW").alias("status"))
    return ln.edit_parents(segs, items(spark, d), edited)


def _remap(spark: SparkSession, d: str) -> DataFrame:
    rows = s.timed(spark, d).select("project", "seq", F.expr("(seq - 1) div 3 + 1").alias("parent"))
    mapping = items(spark, d).where("bad").select("project", F.col("item").alias("old"), (F.col("item") + 1000).alias("new"))
    return ln.remap(rows, mapping, "parent").select("project", "seq", "parent")


def _splice(spark: SparkSession, d: str) -> DataFrame:
    rows = s.timed(spark, d).select("project", F.expr("(seq - 1) div 3 + 1").alias("parent"), "seq")
    rescued = rows.where("parent % 5 = 0 and seq % 3 <> 0")
    return ln.splice(rows, rescued).select("project", "parent", "seq", "new_seq")


def _single_items(spark: SparkSession, d: str) -> DataFrame:
    """Items of one source, with some sources in two or three of them."""
    return s.timed(spark, d).select("project", F.col("seq").alias("item"), F.array(F.expr("seq - seq % 3 % 2")).alias("src"))


QUERIES = {
    "j1_gather_sources": (
        lambda spark, d: ln.gather(items(spark, d), s.timed(spark, d), "speaker"),
        f"{_I} SELECT e.project, e.item, string_agg(speaker, ' ' ORDER BY e.seq) AS text, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM pre e JOIN timed t ON t.project = e.project AND t.seq = e.seq GROUP BY 1, 2",
    ),
    "j3_parent_of": (
        lambda spark, d: ln.parent_of(s.timed(spark, d).select("project", "seq"), items(spark, d)),
        f"{_I} SELECT t.project, t.seq, (SELECT min(item) FROM edges e WHERE e.project = t.project AND e.seq = t.seq) AS parent FROM timed t",
    ),
    "j4_children": (
        lambda spark, d: s.timed(spark, d).join(ln.edges(items(spark, d).where("bad")), ["project", "seq"], "left_semi").select("project", "seq"),
        f"{_I} SELECT project, seq FROM timed t WHERE EXISTS (SELECT 1 FROM edges e JOIN items i ON i.project = e.project AND i.item = e.item WHERE i.bad AND e.project = t.project AND e.seq = t.seq)",
    ),
    "j6_visual_matches": (
        lambda spark, d: iv.visual_matches(s.timed(spark, d), blocks(spark, d)).select("project", "seq", "block_id", "overlap_ms"),
        f"""{_J}, p AS (SELECT t.project, seq, block_id, greatest(100, end_ms - start_ms) AS len, least(end_ms, block_end + 40) - greatest(start_ms, greatest(0, block_start - 40)) AS overlap_ms
          FROM timed t JOIN blocks b ON t.project = b.project AND start_ms <= block_end + 40 AND block_start - 40 <= end_ms),
        q AS (SELECT *, row_number() OVER (PARTITION BY project, seq ORDER BY overlap_ms DESC, block_id) AS n FROM p WHERE overlap_ms > 120)
        SELECT project, seq, block_id, overlap_ms FROM q WHERE overlap_ms * 100 >= len * 58 OR (n = 1 AND overlap_ms * 100 >= len * 45)""",
    ),
    "j7_clip_to_slices": (
        lambda spark, d: iv.clip_to_slices(s.timed(spark, d), _slices(spark, d)).select("project", "seq", "slice", "clip_start", "clip_end"),
        f"""{_T}, w AS (SELECT project, unnest(range(0, max(end_ms) // 7000 + 1)) AS slice FROM timed GROUP BY project)
        SELECT t.project, seq, slice, greatest(start_ms, slice * 7000) - slice * 7000 AS clip_start, least(end_ms, slice * 7000 + 7000) - slice * 7000 AS clip_end
        FROM timed t JOIN w ON w.project = t.project AND end_ms > slice * 7000 AND start_ms < slice * 7000 + 7000""",
    ),
    "j8_words_in_segments": (
        lambda spark, d: _words(spark, d).select("project", "seq", "first_word", "last_word", "n_words"),
        f"{_WORDS} SELECT project, seq, first_word, last_word, n_words FROM v",
    ),
    "tl8_hollow": (
        lambda spark, d: iv.words_in_segments(s.timed(spark, d).withColumn("end_ms", F.expr("end_ms + seg_id % 4 * 1500")), blocks(spark, d).where("block_id % 3 = 0").select("project", F.col("block_start").alias("word_start"), F.col("block_end").alias("word_end"))).where("n_words > 0").where(iv.hollow()).select("project", "seq", "n_words"),
        f"""{_J}, t AS (SELECT project, seq, start_ms, end_ms + seg_id % 4 * 1500 AS end_ms FROM timed),
        w AS (SELECT t.project, t.seq, any_value(end_ms - start_ms) AS len, max(block_end) - min(block_start) AS cover, count(*) AS n_words FROM t JOIN blocks b ON t.project = b.project AND block_id % 3 = 0
          AND ((block_start + block_end BETWEEN 2 * (start_ms - 150) AND 2 * (end_ms + 150)) OR (block_start >= start_ms - 100 AND block_end <= end_ms + 100)) GROUP BY 1, 2)
        SELECT project, seq, n_words FROM w WHERE len > 2000 AND (cover * 4 < len OR (n_words <= 1 AND len > 3000))""",
    ),
    "tl32_tighten": (
        lambda spark, d: iv.tighten(_words(spark, d)).select("project", "seq", "tight_start", "tight_end"),
        f"{_WORDS} SELECT project, seq, greatest(start_ms, first_word - 100) AS tight_start, least(end_ms, last_word + 150) AS tight_end FROM v WHERE n_words > 0",
    ),
    "j9_same_time": (
        lambda spark, d: blocks(spark, d).withColumn("cs", F.expr("(block_start + 5) div 10")).join(s.timed(spark, d).groupBy("project", F.expr("(start_ms + 5) div 10").alias("cs")).agg(F.max("seq").alias("seq")), ["project", "cs"]).select("project", "block_id", "seq"),
        f"{_J}, k AS (SELECT project, (start_ms + 5) // 10 AS cs, max(seq) AS seq FROM timed GROUP BY 1, 2) SELECT b.project, block_id, seq FROM blocks b JOIN k ON k.project = b.project AND k.cs = (block_start + 5) // 10",
    ),
    "j10_contained": (
        lambda spark, d: iv.contained(s.timed(spark, d).where("seg_id % 10 = 0").select("project", F.col("seg_id").alias("span_id"), F.col("start_ms").alias("span_start"), F.expr("end_ms + 2000").alias("span_end")), s.timed(spark, d)).select("project", "span_id", "seq"),
        f"{_T} SELECT t.project, x.seg_id AS span_id, t.seq FROM timed t JOIN timed x ON x.project = t.project AND x.seg_id % 10 = 0 AND t.start_ms >= x.start_ms AND t.end_ms <= x.end_ms + 2000",
    ),
    "j13_neighbours": (
        lambda spark, d: s.timed(spark, d).selectExpr("project", "seq", "lag(speaker) over (partition by project order by seq) as before", "lead(speaker) over (partition by project order by seq) as after"),
        f"{_T} SELECT project, seq, lag(speaker) OVER w AS before, lead(speaker) OVER w AS after FROM timed WINDOW w AS (PARTITION BY project ORDER BY seq)",
    ),
    "j18_remap": (_remap, f"{_I} SELECT t.project, t.seq, (t.seq - 1) // 3 + 1 + CASE WHEN coalesce(bad, false) THEN 1000 ELSE 0 END AS parent FROM timed t LEFT JOIN items i ON i.project = t.project AND i.item = (t.seq - 1) // 3 + 1"),
    "j19_nearest": (
        lambda spark, d: iv.nearest(*_targets(spark, d)).select("project", "target_id", "row_id"),
        f"""{_T}, a AS (SELECT project, seg_id AS target_id, start_ms AS at_ms FROM timed WHERE seg_id % 3 = 0), b AS (SELECT project, seg_id AS row_id, start_ms AS row_at FROM timed WHERE seg_id % 3 <> 0),
        p AS (SELECT a.project, target_id, row_id, row_number() OVER (PARTITION BY a.project, target_id ORDER BY CASE WHEN row_at > at_ms - 20 AND row_at < at_ms + 60 THEN 0 ELSE 1 END, abs(row_at - at_ms), row_id) AS n
          FROM a JOIN b ON a.project = b.project AND abs(row_at - at_ms) <= 380)
        SELECT a.project, a.target_id, p.row_id FROM a LEFT JOIN p ON p.project = a.project AND p.target_id = a.target_id AND n = 1""",
    ),
    "t32_csv": (
        lambda spark, d: items(spark, d).withColumn("csv", F.concat(ln.to_csv("src"), F.lit(", x,"))).select("project", "item", F.array_join(ln.parse_csv("csv"), ",").alias("csv")),
        f"{_I} SELECT project, item, array_to_string(src, ',') AS csv FROM items",
    ),
    "t32_expand_range": (
        lambda spark, d: items(spark, d).select("project", "item", F.array(F.array_min("src"), F.array_max("src")).alias("src")).select("project", "item", F.size(ln.expand_range("src")).alias("n")),
        f"{_I} SELECT project, item, CAST(CASE WHEN list_max(src) > list_min(src) THEN list_max(src) - list_min(src) + 1 ELSE 2 END AS INT) AS n FROM items",
    ),
    "m2_edit_parents": (
        _edits,
        f"""{_I}, e AS (SELECT e.project, e.item, e.seq, CASE WHEN item % 8 = 0 THEN '' ELSE 'new text' END AS text, e.seq = min(e.seq) OVER (PARTITION BY e.project, e.item) AS first FROM edges e WHERE item % 4 = 0),
        l AS (SELECT project, seq, arg_max(text, item) AS text, arg_max(first, item) AS first FROM e GROUP BY 1, 2)
        SELECT t.project, t.seq, CASE WHEN l.seq IS NULL THEN speaker WHEN first THEN text ELSE '' END AS translated_text, CASE WHEN l.seq IS NULL THEN 'RAW' WHEN NOT first THEN 'MERGED_CHILD' WHEN text <> '' THEN 'TRANSLATED' ELSE 'RAW' END AS status
        FROM timed t LEFT JOIN l ON l.project = t.project AND l.seq = t.seq""",
    ),
    "m2_edit_children": (
        lambda spark, d: ln.edit_children(items(spark, d).withColumn("text", F.lit("old")), s.timed(spark, d).where("seg_id % 2 = 0").select("project", "seq", F.col("speaker").alias("text"))).select("project", "item", "text"),
        f"{_I} SELECT i.project, i.item, coalesce(t.speaker, 'old') AS text FROM items i LEFT JOIN timed t ON len(src) = 1 AND t.project = i.project AND t.seq = src[1] AND t.seg_id % 2 = 0",
    ),
    "m5_write_back": (
        lambda spark, d: ln.write_back(s.timed(spark, d).select("project", "seq"), items(spark, d)),
        f"{_I} SELECT t.project, t.seq, (SELECT max(item) FROM edges e WHERE e.project = t.project AND e.seq = t.seq) AS tts_index FROM timed t",
    ),
    "m7_splice": (
        _splice,
        f"""{_T}, r AS (SELECT project, (seq - 1) // 3 + 1 AS parent, seq FROM timed)
        SELECT project, parent, seq, row_number() OVER (PARTITION BY project ORDER BY parent, seq) AS new_seq FROM r
        WHERE (parent % 5 = 0 AND seq % 3 <> 0) OR (project, parent) NOT IN (SELECT (project, parent) FROM r WHERE parent % 5 = 0 AND seq % 3 <> 0)""",
    ),
    "a11_duplicate_sources": (
        lambda spark, d: ln.duplicate_sources(items(spark, d)),
        f"""{_I}, k AS (SELECT e.project, e.seq, count(DISTINCT e.item) AS m, max(len(src)) AS most, min(e.item) AS lo, max(e.item) AS hi FROM edges e JOIN items i ON i.project = e.project AND i.item = e.item GROUP BY 1, 2)
        SELECT project, seq, m AS n FROM k WHERE m > 1 AND NOT (most = 1 AND hi - lo + 1 = m)""",
    ),
    "a16_shared_sources": (
        lambda spark, d: ln.shared_sources(_single_items(spark, d)).select("project", "seq", F.array_join("items", ",").alias("items")),
        f"{_T} SELECT project, seq - seq % 3 % 2 AS seq, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) AS items FROM timed GROUP BY 1, 2 HAVING count(*) > 1".replace("GROUP BY 1, 2", "GROUP BY project, seq - seq % 3 % 2"),
    ),
    "al10_silently_missing": (
        lambda spark, d: ln.silently_missing(s.timed(spark, d), items(spark, d)),
        f"""{_I}, c AS (SELECT t.*, EXISTS (SELECT 1 FROM edges e WHERE e.project = t.project AND e.seq = t.seq) AS c FROM timed t),
        n AS (SELECT *, coalesce(lag(c) OVER w, false) AND coalesce(lead(c) OVER w, false) AS near FROM c WINDOW w AS (PARTITION BY project ORDER BY seq)) SELECT project, seq FROM n WHERE NOT c AND NOT (near AND end_ms - start_ms <= 3500)""",
    ),
    "al10_verify": (
        lambda spark, d: ln.verify(s.timed(spark, d), items(spark, d)),
        f"""{_I}, c AS (SELECT t.*, EXISTS (SELECT 1 FROM edges e WHERE e.project = t.project AND e.seq = t.seq) AS c FROM timed t),
        n AS (SELECT *, coalesce(lag(c) OVER w, false) AND coalesce(lead(c) OVER w, false) AS near FROM c WINDOW w AS (PARTITION BY project ORDER BY seq)),
        s1 AS (SELECT project, count(*) AS silent FROM n WHERE NOT c AND NOT (near AND end_ms - start_ms <= 3500) GROUP BY 1),
        k AS (SELECT e.project, e.seq, count(DISTINCT e.item) AS m, max(len(src)) AS most, min(e.item) AS lo, max(e.item) AS hi FROM edges e JOIN items i ON i.project = e.project AND i.item = e.item GROUP BY 1, 2),
        s2 AS (SELECT project, count(*) AS duplicates FROM k WHERE m > 1 AND NOT (most = 1 AND hi - lo + 1 = m) GROUP BY 1),
        x AS (SELECT e.project, item, min(e.seq) AS lo, max(e.seq) AS hi, arg_min(start_ms, e.seq) AS s, arg_max(end_ms, e.seq) AS e FROM edges e JOIN timed t ON t.project = e.project AND t.seq = e.seq GROUP BY 1, 2),
        y AS (SELECT *, max(hi) OVER (PARTITION BY project ORDER BY item ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far, lag(e) OVER (PARTITION BY project ORDER BY item) AS was FROM x),
        s3 AS (SELECT project, count(*) FILTER (lo < far) AS disorder, count(*) FILTER (s + 10 < was) AS "overlaps" FROM y GROUP BY 1)
        SELECT p.project, coalesce(silent, 0) AS silent, coalesce(duplicates, 0) AS duplicates, coalesce(disorder, 0) AS disorder, coalesce("overlaps", 0) AS "overlaps", 0::BIGINT AS empty,
          coalesce(silent, 0) + coalesce(duplicates, 0) + coalesce(disorder, 0) + coalesce("overlaps", 0) = 0 AS passed
        FROM (SELECT DISTINCT project FROM timed) p LEFT JOIN s1 USING (project) LEFT JOIN s2 USING (project) LEFT JOIN s3 USING (project)""",
    ),
    "al11_retry_windows": (
        lambda spark, d: ln.retry_windows(items(spark, d), F.col("bad")).withColumn("reasons", F.array_join("reasons", ",")),
        f"""{_I}, a AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY item) AS pos, count(*) OVER (PARTITION BY project) AS n FROM items),
        r AS (SELECT project, pos, n, pos - row_number() OVER (PARTITION BY project ORDER BY pos) AS run FROM a WHERE bad),
        i AS (SELECT project, greatest(1, min(pos) - 1) AS lo, least(any_value(n), max(pos) + 1) AS hi FROM r GROUP BY project, run),
        g AS (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY project ORDER BY lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM i),
        k AS (SELECT *, sum(fresh) OVER (PARTITION BY project ORDER BY lo) AS part FROM g), w AS (SELECT project, min(lo) AS lo, max(hi) AS hi FROM k GROUP BY project, part)
        SELECT w.project, lo, hi, min(list_min(src)) AS src_lo, max(list_max(src)) AS src_hi, array_to_string(list_sort(list_distinct(flatten(list(flags)))), ',') AS reasons FROM w JOIN a ON a.project = w.project AND a.pos BETWEEN lo AND hi GROUP BY 1, 2, 3""",
    ),
    "al13_hard_flags": (
        lambda spark, d: items(spark, d).select("project", "item", F.size(ln.hard_flags()).cast("long").alias("hard")),
        f"{_I} SELECT project, item, len(list_filter(flags, lambda x: x LIKE 'LOW_MATCH%')) AS hard FROM items",
    ),
    "a14_flag_histogram": (
        lambda spark, d: items(spark, d).select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("n")),
        f"{_I} SELECT flag, count(*) AS n FROM (SELECT unnest(flags) AS flag FROM items) GROUP BY 1",
    ),
    "a12_longest_run": (
        lambda spark, d: ln.longest_run(items(spark, d), F.col("bad")),
        f"""{_I}, a AS (SELECT project, bad, row_number() OVER (PARTITION BY project ORDER BY item) AS n FROM items), b AS (SELECT project, n - row_number() OVER (PARTITION BY project ORDER BY n) AS run FROM a WHERE bad),
        c AS (SELECT project, run, count(*) AS n FROM b GROUP BY 1, 2), m AS (SELECT project, CAST(sum(n) AS BIGINT) AS bad, max(n) AS longest FROM c GROUP BY 1)
        SELECT p.project, p.items, coalesce(m.bad, 0) AS bad, coalesce(longest, 0) AS longest FROM (SELECT project, count(*) AS items FROM items GROUP BY 1) p LEFT JOIN m ON m.project = p.project""",
    ),
    "a13_closed_gate": (
        lambda spark, d: ln.closed_gate(items(spark, d), F.col("bad"), 200, 2).select("project", "open"),
        f"""{_I}, a AS (SELECT project, bad, lag(bad) OVER (PARTITION BY project ORDER BY item) AS was FROM items)
        SELECT project, count(*) FILTER (bad) * 1000 <= count(*) * 200 AND count(*) FILTER (bad AND was) = 0 AS open FROM a GROUP BY 1""",
    ),
    "al14_mega_summary": (
        lambda spark, d: s.timed(spark, d).groupBy("project", F.expr("(seq - 1) div 7").alias("item")).agg(F.collect_list("seq").alias("src"), F.sum(F.length("speaker")).alias("chars"), F.max("seg_id").alias("m")).withColumn("words", F.expr("m % 12")).where(ln.mega_summary("words", "chars")).select("project", "item"),
        f"{_T} SELECT project, (seq - 1) // 7 AS item FROM timed GROUP BY project, (seq - 1) // 7 HAVING count(*) >= 6 AND max(seg_id) % 12 * 100 < sum(length(speaker)) * 28",
    ),
    "al15_should_retry": (
        lambda spark, d: items(spark, d).groupBy("project").agg(F.count("*").alias("n"), F.count_if("bad").alias("failed")).select("project", ln.should_retry((F.col("n") - F.col("failed")) * 100 / F.col("n"), F.col("failed")).alias("retry")),
        f"""{_I}, k AS (SELECT project, (count(*) - count(*) FILTER (bad)) * 100 / count(*) AS c, count(*) FILTER (bad) AS f FROM items GROUP BY 1) SELECT project, NOT (c >= 96 AND f <= 2) AND (c < 95 OR f > 3) AS retry FROM k""",
    ),
    "tl26_gap_collisions": (
        lambda spark, d: ln.edges(items(spark, d)).join(s.timed(spark, d).select("project", "seq", "start_ms", "end_ms"), ["project", "seq"]).selectExpr("project", "item", "lead(start_ms) over (partition by project, item order by seq) - end_ms as gap").groupBy("project", "item").agg(F.max(F.coalesce(F.col("gap") >= 800, F.lit(False))).alias("collides")),
        f"""{_I}, g AS (SELECT e.project, e.item, lead(start_ms) OVER (PARTITION BY e.project, e.item ORDER BY e.seq) - end_ms AS gap FROM edges e JOIN timed t ON t.project = e.project AND t.seq = e.seq)
        SELECT project, item, max(coalesce(gap >= 800, false)) AS collides FROM g GROUP BY 1, 2""",
    ),
}
