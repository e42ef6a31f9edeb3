"""Joins by time: overlap, containment, clipping, nearest row.

An interval join is an equality join on (key, time bucket): each side is listed in every bucket that it touches, and a
pair is made only in the bucket where the later of the two begins, so it comes once. Nothing compares all rows of a key,
and a key with most of all rows spreads over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seglume.operators.relational import pick


def _bucketed(rows: DataFrame, start: Column, end: Column, width: int, names: tuple[str, str, str]) -> DataFrame:
    low, high, bucket = names
    rows = rows.withColumn(low, start).withColumn(high, F.greatest(start, end))
    return rows.withColumn(bucket, F.explode(F.sequence(F.expr(f"{low} div {width}"), F.expr(f"{high} div {width}"))))


def interval_join(left: DataFrame, right: DataFrame, right_start: str, right_end: str, start: str = "start_ms", end: str = "end_ms", key: str = "project", pad_ms: int = 0, width: int = 10_000) -> DataFrame:
    """All pairs of a key whose intervals (the right one padded) touch, with overlap_ms. ``right`` has no column name of
    ``left`` but the key. Times are not negative beyond the padding; ``width`` should be near the usual length."""
    a = _bucketed(left, F.col(start), F.col(end), width, ("_la", "_lb", "_bucket"))
    # a bucket number may be negative only by padding: shift both sides
    b = _bucketed(right.withColumnRenamed(key, "_key"), F.greatest(F.lit(0), F.col(right_start) - pad_ms), F.col(right_end) + pad_ms, width, ("_ra", "_rb", "_rbucket"))
    touch = (F.col(key) == F.col("_key")) & (F.col("_bucket") == F.col("_rbucket")) & (F.col("_la") <= F.col("_rb")) & (F.col("_ra") <= F.col("_lb"))
    once = F.col("_bucket") == F.greatest(F.expr(f"_la div {width}"), F.expr(f"_ra div {width}"))
    out = a.join(b, touch & once)
    overlap = F.least(F.col(end), F.col(right_end) + pad_ms) - F.greatest(F.col(start), F.col(right_start) - pad_ms)
    return out.withColumn("overlap_ms", overlap).drop("_la", "_lb", "_ra", "_rb", "_bucket", "_rbucket", "_key")


def visual_matches(segs: DataFrame, blocks: DataFrame, pad_ms: int = 40, least_ms: int = 120) -> DataFrame:
    """Pairs of segment and visual block (block_id, block_start, block_end): over ``least_ms`` of overlap, and 58 % of the
    segment, or 45 % by the block that overlaps most."""
    pairs = interval_join(segs, blocks, "block_start", "block_end", pad_ms=pad_ms).where(F.col("overlap_ms") > least_ms)
    best = pick(pairs.select("project", "seq", "overlap_ms", "block_id"), ["project", "seq"], -F.col("overlap_ms"), "block_id").select("project", "seq", F.col("block_id").alias("_best"))
    length = F.greatest(F.lit(100), F.col("end_ms") - F.col("start_ms"))
    share = F.col("overlap_ms") * 100
    return pairs.join(best, ["project", "seq"]).where((share >= length * 58) | ((F.col("block_id") == F.col("_best")) & (share >= length * 45))).drop("_best")


def clip_to_slices(segs: DataFrame, slices: DataFrame) -> DataFrame:
    """Segments cut to the slices (slice, slice_start, slice_end) that they meet, in the slice's own time."""
    pairs = interval_join(segs, slices, "slice_start", "slice_end").where("overlap_ms > 0")
    start = F.greatest("start_ms", "slice_start") - F.col("slice_start")
    return pairs.withColumn("clip_start", start).withColumn("clip_end", F.least("end_ms", "slice_end") - F.col("slice_start"))


def words_in_segments(segs: DataFrame, words: DataFrame, middle_ms: int = 150, inside_ms: int = 100) -> DataFrame:
    """Of each segment its words (word_start, word_end): the middle within ``middle_ms`` of it, or all of it within
    ``inside_ms``: first_word, last_word, n_words; zero words where there are none."""
    pairs = interval_join(segs.select("project", "seq", "start_ms", "end_ms"), words, "word_start", "word_end", pad_ms=middle_ms)
    middle = F.col("word_start") + F.col("word_end")  # doubled
    near = middle.between(2 * (F.col("start_ms") - middle_ms), 2 * (F.col("end_ms") + middle_ms))
    inside = (F.col("word_start") >= F.col("start_ms") - inside_ms) & (F.col("word_end") <= F.col("end_ms") + inside_ms)
    own = pairs.where(near | inside).groupBy("project", "seq").agg(F.min("word_start").alias("first_word"), F.max("word_end").alias("last_word"), F.count("*").alias("n_words"))
    return segs.join(own, ["project", "seq"], "left").withColumn("n_words", F.coalesce("n_words", F.lit(0)))


def hollow() -> Column:
    """Segments over two seconds of which words cover less than a quarter, or over three with one word at most."""
    length = F.col("end_ms") - F.col("start_ms")
    return (length > 2000) & (((F.col("last_word") - F.col("first_word")) * 4 < length) | ((F.col("n_words") <= 1) & (length > 3000)))


def tighten(segs: DataFrame, before_ms: int = 100, after_ms: int = 150) -> DataFrame:
    """Segments with words, drawn to their first and last word."""
    rows = segs.where("n_words > 0")
    return rows.withColumn("tight_start", F.greatest("start_ms", F.col("first_word") - before_ms)).withColumn("tight_end", F.least("end_ms", F.col("last_word") + after_ms))


def contained(spans: DataFrame, segs: DataFrame) -> DataFrame:
    """Spans (span_id, span_start, span_end) and the segments that lie in them."""
    return interval_join(segs, spans, "span_start", "span_end").where("start_ms >= span_start and end_ms <= span_end")


def nearest(targets: DataFrame, rows: DataFrame, tolerance_ms: int = 380) -> DataFrame:
    """Of each target (target_id, at, from_ms, to_ms) the nearest row (row_id, row_at): one within (from, to) before all
    others, else within the tolerance; null where there is none."""
    span = targets.withColumn("start_ms", F.least(F.col("from_ms"), F.greatest(F.lit(0), F.col("at") - tolerance_ms))).withColumn("end_ms", F.greatest(F.col("to_ms"), F.col("at") + tolerance_ms))
    pairs = interval_join(span, rows.withColumn("_to", F.col("row_at")), "row_at", "_to")
    apart = F.abs(F.col("row_at") - F.col("at"))
    inside = (F.col("row_at") > F.col("from_ms")) & (F.col("row_at") < F.col("to_ms"))
    pairs = pairs.withColumn("_out", (~inside).cast("int")).withColumn("_apart", apart).where(inside | (apart <= tolerance_ms))
    best = pick(pairs.select("project", "target_id", "row_id", "_out", "_apart"), ["project", "target_id"], "_out", "_apart", "row_id")
    return targets.join(best.select("project", "target_id", "row_id"), ["project", "target_id"], "left")
