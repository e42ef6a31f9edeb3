"""Queries of ordered folds, parsing, alignment and fusion; SQL where a recursion in it can say the same."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from seglume.functions import parsing, similarity
from seglume.operators import align as al
from seglume.operators import dictionary, folds, fusion
from seglume.operators import lineage as ln
from seglume.operators import timeline as tl
from seglume.operators import turns
from seglume.plans import lineages, surrogate as s
from seglume.session import table

_T = f"WITH RECURSIVE {s.TIMED_SQL}"


def voiced(spark: SparkSession, d: str) -> DataFrame:
    """Timed segments; every eleventh has no voice."""
    return s.timed(spark, d).withColumn("raw_ms", F.when(F.col("seg_id") % 11 != 0, F.expr("(end_ms - start_ms) * (8 + seg_id % 9) div 10 + 40"))).withColumn("text", F.col("speaker"))


def chars(spark: SparkSession, d: str) -> DataFrame:
    return s.talk(spark, d).select("project", "seq", F.length("text").cast("long").alias("chars"))


def words(spark: SparkSession, d: str) -> DataFrame:
    """The words of a conversation, one after another, with a pause after each by its length."""
    split = F.posexplode(F.filter(F.split("text", " "), lambda x: x != "")).alias("k", "text")
    rows = s.talk(spark, d).select("project", (F.col("seq").cast("long") * 10_000_000).alias("base"), split).withColumn("seq", F.col("base") + F.col("k")).withColumn("len", F.expr("200 + length(text) * 90 % 1100"))
    rows = tl.offsets(rows, "len", "start_ms")
    return rows.withColumn("end_ms", F.expr("start_ms + 200"))


def sentences(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence of every document."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(parsing.arrays(parsing.split_sentences)("text")).alias("place", "sentence"))


def script(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Turns as sources, and items that quote one or two of them each (with every ninth character lost)."""
    segs = s.talk(spark, d).select("project", F.expr("(seq - 1) div 40").alias("batch"), "seq", "text")
    items = segs.groupBy("project", "batch", F.expr("(seq - 1) div 2").alias("item")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("zh"))
    return items.withColumn("zh", F.regexp_replace("zh", "(.{8}).", "$1")), segs


def readings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Timed segments with a made-up line each, and three readings of a block over every two of them, some misread; every
    fifth block is missing, and some of its lines are misheard."""
    rows = s.timed(spark, d).withColumn("said", F.concat("speaker", F.lit("x"), (F.col("seg_id") % 50).cast("string"), F.lit("yz"))).withColumn("block_id", F.expr("(seq + 1) div 2"))
    lost = (F.col("block_id") + F.col("project")) % 5 == 0
    shown = rows.where(~lost).groupBy("project", "block_id").agg(F.min("start_ms").alias("block_start"), F.max("end_ms").alias("block_end"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "said"))), lambda x: x["said"]), "").alias("shown"))
    blocks = shown.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    read = F.when((F.col("block_id") + F.col("k")) % 4 == 0, F.translate("shown", "xy", "vw")).otherwise(F.col("shown"))
    heard = F.when(lost & (F.col("seg_id") % 2 == 0), F.translate("said", "y", "q")).when(F.col("seg_id") % 7 == 0, F.regexp_replace("said", "(.{4}).", "$1")).otherwise(F.col("said"))
    return rows.select("project", "seq", "start_ms", "end_ms", heard.alias("text")), blocks.select("project", "block_id", "block_start", "block_end", read.alias("reading"))


def sounds(spark: SparkSession) -> DataFrame:
    """Characters that sound alike."""
    return spark.createDataFrame([("y", "i"), ("q", "i"), ("x", "s"), ("v", "s")], "char string, sound string")


def _refined(spark: SparkSession, d: str) -> DataFrame:
    return fusion.refine(*readings(spark, d), sounds(spark))


def _two_readings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Turns that were heard with characters lost and seen with characters misread; counts over what was said."""
    rows = s.talk(spark, d)
    seen = F.when(F.col("seq") % 3 == 0, F.translate("text", "ae", "eo")).otherwise(F.regexp_replace("text", "(.{6}).", "$1e"))
    pairs = rows.select("project", "seq", F.regexp_replace("text", "(.{8}).", "$1").alias("heard"), seen.alias("seen")).withColumn("witnesses", F.array("seen"))
    return pairs, fusion.ngrams(rows, "text", (2,))


def _spans(spark: SparkSession, d: str) -> DataFrame:
    return fusion.choose_spans(*_two_readings(spark, d), ["project", "seq"])


def _votes(spark: SparkSession, d: str) -> DataFrame:
    rows = s.timed(spark, d).withColumn("batch", F.expr("(seq - 1) div 5"))
    return fusion.vote(rows, ["project", "batch"], "speaker", "seq").select("project", "batch", "speaker", "votes", "readings")


def _stitched(spark: SparkSession, d: str) -> DataFrame:
    rows = s.timed(spark, d).select("project", "seq", "start_ms", "end_ms", F.col("speaker").alias("text"))
    chunk = F.explode(F.array_distinct(F.array(F.expr("start_ms div 20000"), F.expr("greatest(0, start_ms - 3000) div 20000")))).alias("chunk")
    rows = rows.select("*", chunk).withColumn("window_end", F.expr("chunk * 20000 + 3000"))
    return folds.fold(rows, folds.stitch(), "seq long, start_ms long, end_ms long, text string", order=("chunk", "seq"))


def _broken_json(spark: SparkSession, d: str) -> DataFrame:
    rows = s.talk(spark, d).groupBy("project").agg(F.sort_array(F.collect_list(F.struct("seq", "speaker", "text"))).alias("r"))
    full = F.to_json(F.transform("r", lambda x: F.struct(x["seq"].alias("src"), x["speaker"].alias("role"), x["text"].alias("vi"))))
    return rows.select("project", F.size("r").alias("n"), F.concat(F.lit("Here it is:\n```json\n"), full, F.lit("\n```")).alias("raw"))


def _cut_json(spark: SparkSession, d: str) -> DataFrame:
    rows = _broken_json(spark, d)
    return rows.select("project", "n", F.when(F.col("project") % 2 == 0, F.substr("raw", F.lit(1), F.length("raw") - 12)).otherwise(F.col("raw")).alias("raw"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _demerge(text: pd.Series, durations: pd.Series) -> pd.Series:
    return pd.Series([parsing.demerge(x or "", list(d)) for x, d in zip(text, durations)], dtype=object)


#: Phrases with their categories, and one that is none of them.
PHRASES = {"the": ["article"], "what": ["question"], "what is": ["question", "phrase"], "in": ["place"]}
SAFE = ["what is the"]


def _matched(spark: SparkSession, d: str) -> DataFrame:
    rows = dictionary.matches(table(spark, d, "benchmark"), "text", PHRASES, SAFE)
    return rows.select("item_id", F.explode("matches").alias("m")).select("item_id", "m.start", "m.end", "m.text", F.array_join("m.categories", ",").alias("categories"))


SCRIPT = "struct<n:int,role:string,src:array<long>,text:string>"

QUERIES = {
    "tl1_word_groups": (lambda spark, d: folds.fold(words(spark, d), folds.word_groups, "segment long, start_ms long, end_ms long, n long, text string"), None),
    "tl2_merge_fragments": (
        lambda spark, d: folds.fold(voiced(spark, d).withColumn("text", F.expr("substring(speaker, 1, 1 + cast(seg_id % 4 as int))")).withColumn("confidence", F.col("seg_id") % 10 / 10), folds.merge_fragments(), "seq long, start_ms long, end_ms long, text string, confidence double"),
        None,
    ),
    "tl4_join_chunks": (
        lambda spark, d: folds.fold(voiced(spark, d), folds.join_chunks(), "seq long, start_ms long, end_ms long, text string"),
        None,
    ),
    "tl5_stitch": (_stitched, None),
    "tl6_split_overlaps": (
        lambda spark, d: turns.split_overlaps(s.timed(spark, d)),
        f"""{_T}, f AS (SELECT project, seq, start_ms, CASE WHEN end_ms <= start_ms THEN start_ms + 500 ELSE end_ms END AS end_ms FROM timed),
        r AS (SELECT project, seq, start_ms AS s, end_ms AS e, NULL::BIGINT AS ps, NULL::BIGINT AS pe FROM f WHERE seq = 1
          UNION ALL SELECT f.project, f.seq, CASE WHEN f.start_ms < r.e THEN least(f.end_ms - 300, (r.e + f.start_ms) // 2 + 10) ELSE f.start_ms END, f.end_ms,
            r.s, CASE WHEN f.start_ms < r.e THEN greatest(r.s + 300, (r.e + f.start_ms) // 2 - 10) ELSE r.e END FROM r JOIN f ON f.project = r.project AND f.seq = r.seq + 1)
        SELECT project, seq, s AS start_ms, coalesce(lead(pe) OVER (PARTITION BY project ORDER BY seq), e) AS end_ms FROM r""",
    ),
    "tl9_pack_batches": (
        lambda spark, d: folds.fold(chars(spark, d), folds.pack_batches(4, 300), "seq long, batch long"),
        f"""WITH RECURSIVE {s.TALK_SQL}, r AS (SELECT project, seq, 1::BIGINT AS batch, 1 AS n, CAST(length(text) AS BIGINT) AS c FROM talk WHERE seq = 1
          UNION ALL SELECT t.project, t.seq, CASE WHEN n >= 4 OR c + length(text) > 300 THEN batch + 1 ELSE batch END, CASE WHEN n >= 4 OR c + length(text) > 300 THEN 1 ELSE n + 1 END,
            CASE WHEN n >= 4 OR c + length(text) > 300 THEN length(text) ELSE c + length(text) END FROM r JOIN talk t ON t.project = r.project AND t.seq = r.seq + 1)
        SELECT project, seq, batch FROM r""",
    ),
    "tl10_pause_chunks": (lambda spark, d: folds.fold(s.timed(spark, d), folds.pause_chunks(folds.PauseCuts(20_000, 20, 10)), "chunk long, first_seq long, last_seq long"), None),
    "tl12_speaker_turns": (
        lambda spark, d: turns.speaker_turns(voiced(spark, d)).select("project", "seq", "turn", "offset_ms"),
        f"""{_T}, v0 AS (SELECT *, CASE WHEN seg_id % 11 <> 0 THEN (end_ms - start_ms) * (8 + seg_id % 9) // 10 + 40 END AS raw_ms FROM timed),
        v AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY seq) AS k FROM v0 WHERE raw_ms IS NOT NULL OR seq = 1),
        r AS (SELECT project, k, seq, speaker, end_ms AS e, 1::BIGINT AS turn, 0::BIGINT AS at_ms, coalesce(raw_ms, 0) AS raw FROM v WHERE k = 1
          UNION ALL SELECT v.project, v.k, v.seq, v.speaker, CASE WHEN v.speaker = r.speaker AND v.start_ms - r.e < 850 THEN greatest(r.e, v.end_ms) ELSE v.end_ms END,
            CASE WHEN v.speaker = r.speaker AND v.start_ms - r.e < 850 THEN turn ELSE turn + 1 END,
            CASE WHEN v.speaker = r.speaker AND v.start_ms - r.e < 850 THEN at_ms + raw + least(greatest(v.start_ms - r.e, 0), 850) ELSE 0 END, coalesce(v.raw_ms, 0) FROM r JOIN v ON v.project = r.project AND v.k = r.k + 1)
        SELECT project, seq, turn, at_ms AS offset_ms FROM r""",
    ),
    "a18_clusters": (
        lambda spark, d: folds.fold(s.timed(spark, d).select("project", "seq", (F.col("seg_id") % 100 / 100).alias("value")), folds.clusters(0.085), "seq long, cluster long", order=("value", "seq")),
        None,
    ),
    "tl13_demerge": (
        lambda spark, d: s.talk(spark, d).select("project", "seq", F.posexplode(_demerge(F.col("text"), F.array(*map(F.lit, (1.0, 2.0, 1.5))))).alias("place", "part")),
        None,
    ),
    "tl17_borrow": (lambda spark, d: folds.fold(voiced(spark, d), folds.borrow(), "seq long, from_before long, from_after long"), None),
    "tl12_turn_texts": (
        lambda spark, d: turns.turn_texts(turns.speaker_turns(voiced(spark, d))).select("project", "turn", "speaker", "first_seq", "last_seq", "text"),
        f"""{_T}, v AS (SELECT project, seq, speaker, start_ms, end_ms, CASE WHEN seg_id % 11 <> 0 THEN 1 END AS raw FROM timed), k AS (SELECT * FROM v WHERE raw IS NOT NULL OR seq = 1),
        o AS (SELECT *, CASE WHEN lag(speaker) OVER w = speaker THEN 0 ELSE 1 END AS other FROM k WINDOW w AS (PARTITION BY project ORDER BY seq)),
        r AS (SELECT *, sum(other) OVER (PARTITION BY project ORDER BY seq) AS run FROM o),
        c AS (SELECT *, CASE WHEN other = 1 OR start_ms - max(end_ms) OVER (PARTITION BY project, run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= 850 THEN 1 ELSE 0 END AS cut FROM r),
        t AS (SELECT *, CAST(sum(cut) OVER (PARTITION BY project ORDER BY seq) AS BIGINT) AS turn FROM c)
        SELECT project, turn, min(speaker) AS speaker, min(seq) AS first_seq, max(seq) AS last_seq, string_agg(speaker, ' ' ORDER BY seq) AS text FROM t GROUP BY 1, 2""",
    ),
    "tl22_sync_to_waveform": (
        lambda spark, d: turns.sync_to_waveform(s.timed(spark, d).select("project", "seq", F.expr("seq * 400 % 4000").alias("part_start"), F.expr("seq * 400 % 4000 + 350").alias("part_end"), F.lit(120).alias("cut_ms"), F.lit(118).alias("speed_pct"), F.col("start_ms").alias("slot_start"))),
        f"""WITH RECURSIVE {s.TIMED_SQL}, p AS (SELECT project, seq, start_ms + greatest(0, seq * 400 % 4000 - 120) * 100 // 118 AS s, start_ms + greatest(0, seq * 400 % 4000 + 230) * 100 // 118 AS e FROM timed),
        r AS (SELECT project, seq, s AS start_ms, greatest(s + 300, e) AS end_ms FROM p WHERE seq = 1
          UNION ALL SELECT p.project, p.seq, greatest(r.end_ms, p.s), greatest(greatest(r.end_ms, p.s) + 300, p.e) FROM r JOIN p ON p.project = r.project AND p.seq = r.seq + 1) SELECT * FROM r""",
    ),
    "tl25_split_at_gaps": (lambda spark, d: al.split_at_gaps(lineages.items(spark, d).withColumn("text", F.lit("one two, three. four five six")), s.timed(spark, d).withColumn("text", F.col("speaker")), 300), None),
    "tl31_look_ahead": (
        lambda spark, d: folds.fold(s.timed(spark, d).select("project", "seq", "start_ms", "end_ms", F.col("speaker").alias("text"), F.concat("speaker", F.lit("click")).alias("block")), folds.look_ahead(similarity.ratio), "seq long, last_seq long, text string, score double"),
        None,
    ),
    "t15_split_sentences": (sentences, None),
    "t2_numerals": (
        lambda spark, d: table(spark, d, "part").select("p_partkey", parsing.texts(parsing.arabic_numerals)(F.concat(F.lit("第二十"), F.element_at(F.array(*map(F.lit, "一二三四五")), (F.col("p_partkey") % 5 + 1).cast("int")))).alias("out")),
        "SELECT p_partkey, '第2' || (p_partkey % 5 + 1) AS out FROM part",
    ),
    "t18_replace_once": (
        lambda spark, d: table(spark, d, "part").select("p_partkey", parsing.texts(lambda x: parsing.replace_once(x, [("STEEL", "COPPER"), ("COPPER", "STEEL"), ("ECONOMY", "CHEAP")]))("p_type").alias("out")),
        "SELECT p_partkey, replace(replace(replace(replace(p_type, 'STEEL', chr(1)), 'COPPER', 'STEEL'), chr(1), 'COPPER'), 'ECONOMY', 'CHEAP') AS out FROM part",
    ),
    "t20_longest_matches": (_matched, None),
    "t20_match_counts": (
        lambda spark, d: _matched(spark, d).groupBy("item_id", F.lower("text").alias("phrase"), "categories").agg(F.count("*").alias("n")),
        r"""WITH m AS (SELECT item_id, unnest(list_filter(regexp_extract_all(lower(text), '\b(what is the|what is|what|the|in)\b'), lambda x: x <> 'what is the')) AS phrase FROM benchmark)
        SELECT item_id, phrase, CASE phrase WHEN 'the' THEN 'article' WHEN 'what' THEN 'question' WHEN 'in' THEN 'place' ELSE 'phrase,question' END AS categories, count(*) AS n FROM m GROUP BY 1, 2, 3""",
    ),
    "t29_repaired_json": (
        lambda spark, d: _cut_json(spark, d).select("project", "n", F.size(parsing.arrays(parsing.parse_script, SCRIPT)("raw")).alias("rows")).select("project", (F.col("rows") >= F.col("n") - 1).alias("kept")),
        "SELECT conv_id AS project, true AS kept FROM conversations GROUP BY 1",
    ),
    "src8_script_rows": (
        lambda spark, d: _broken_json(spark, d).select("project", F.explode(parsing.arrays(parsing.parse_script, SCRIPT)("raw")).alias("r")).select("project", "r.n", "r.role", F.array_join("r.src", ",").alias("src")),
        "SELECT conv_id AS project, CAST(turn + 1 AS INT) AS n, role, CAST(turn + 1 AS VARCHAR) AS src FROM conversations WHERE trim(text) <> ''",
    ),
    "al5_align": (lambda spark, d: al.align(*script(spark, d)), None),
    "al1_pieces": (
        lambda spark, d: al.pieces(s.talk(spark, d).select("project", F.col("seq").alias("item"), F.concat("speaker", F.lit(" / / "), F.col("seq").cast("string")).alias("zh"))),
        f"WITH {s.TALK_SQL} SELECT project, seq AS item, 0 AS place, lower(speaker) AS piece FROM talk UNION ALL SELECT project, seq, 1, CAST(seq AS VARCHAR) FROM talk",
    ),
    "al7_trusted": (
        lambda spark, d: al.align(*script(spark, d)).groupBy("project").agg(F.count_if(al.trusted()).alias("trusted"), F.count("*").alias("items")),
        None,
    ),
    "al2_piece_similarity": (
        lambda spark, d: s.talk(spark, d).selectExpr("project", "seq", "text as a", "lead(text) over (partition by project order by seq) as b").select("project", "seq", similarity.of_columns(similarity.piece_similarity)(F.col("a"), F.col("b")).alias("score")),
        None,
    ),
    "t44_blended_score": (
        lambda spark, d: s.talk(spark, d).select("project", "seq", similarity.of_columns(similarity.blended)(F.col("text"), F.expr("substring(text, 3)")).alias("score")),
        None,
    ),
    "a10_votes": (
        _votes,
        f"""{_T}, n AS (SELECT project, (seq - 1) // 5 AS batch, speaker, count(*) AS votes, min(seq) AS first FROM timed GROUP BY 1, 2, 3),
        k AS (SELECT *, CAST(sum(votes) OVER (PARTITION BY project, batch) AS BIGINT) AS readings, row_number() OVER (PARTITION BY project, batch ORDER BY votes DESC, first) AS place FROM n) SELECT project, batch, speaker, votes, readings FROM k WHERE place = 1""",
    ),
    "a23_pick_witness": (
        lambda spark, d: fusion.pick_witness(s.timed(spark, d).withColumn("batch", F.expr("(seq - 1) div 3")), s.timed(spark, d).where("seq % 3 = 1").select("project", F.expr("(seq - 1) div 3").alias("batch"), F.when(F.col("seg_id") % 2 == 0, F.col("speaker")).otherwise("zz").alias("hint")), ["project", "batch"], "speaker", "seq"),
        None,
    ),
    "f5_blocks_of_frames": (
        lambda spark, d: fusion.blocks_of_frames(s.timed(spark, d).groupBy("project", F.col("start_ms").alias("at_ms")).agg(F.min("speaker").alias("text")), 600),
        f"""{_T}, f AS (SELECT project, start_ms AS at_ms, min(speaker) AS text FROM timed GROUP BY 1, 2),
        n AS (SELECT *, CASE WHEN lag(at_ms) OVER w IS NULL OR lag(text) OVER w <> text OR at_ms - lag(at_ms) OVER w > 600 THEN 1 ELSE 0 END AS fresh FROM f WINDOW w AS (PARTITION BY project ORDER BY at_ms)),
        b AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY project ORDER BY at_ms) AS BIGINT) AS block FROM n)
        SELECT project, block, min(at_ms) AS block_start, max(at_ms) AS block_end, min(text) AS text, count(*) AS frames FROM b GROUP BY 1, 2""",
    ),
    "a10_preempted": (
        lambda spark, d: fusion.vote(s.timed(spark, d).withColumn("batch", F.expr("(seq - 1) div 5")).withColumn("heard", F.when(F.col("batch") % 2 == 0, F.lit("a click, then")).otherwise("none")), ["project", "batch"], "speaker", "seq", heard="heard").select("project", "batch", "speaker", "votes", "readings"),
        f"""{_T}, n AS (SELECT project, (seq - 1) // 5 AS batch, speaker, count(*) AS votes, min(seq) AS first FROM timed GROUP BY 1, 2, 3),
        k AS (SELECT *, CAST(sum(votes) OVER (PARTITION BY project, batch) AS BIGINT) AS readings, batch % 2 = 0 AND contains('a click, then', speaker) AS inside FROM n)
        SELECT project, batch, speaker, votes, readings FROM (SELECT *, row_number() OVER (PARTITION BY project, batch ORDER BY inside DESC, CASE WHEN inside THEN 0 ELSE -votes END, first) AS place FROM k) WHERE place = 1""",
    ),
    "t27_spans": (_spans, None),
    "t27_fused": (lambda spark, d: fusion.fuse_spans(_spans(spark, d), ["project", "seq"]), None),
    "f5_groups": (lambda spark, d: _refined(spark, d).where("last_seq > unit").select("project", "unit", "last_seq", "heard", "seen"), None),
    "f5_refine": (_refined, None),
    "f5_breaker": (lambda spark, d: fusion.breaker(_refined(spark, d)), None),
}
