"""Timelines: operators over ordered segments of a project, in integer milliseconds.

Input rows have project, seq (the order, from 1), start_ms and end_ms; an operator adds columns or keeps rows. Each is a
closed form over one window by project, so rows shuffle once however many of them follow each other. A project that
holds a large share of all rows goes through ``chunked_prefix`` first, which needs no window over a whole project.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F


def ordered() -> WindowSpec:
    return W.partitionBy("project").orderBy("seq")


def earlier() -> WindowSpec:
    return ordered().rowsBetween(W.unboundedPreceding, -1)


def so_far() -> WindowSpec:
    return ordered().rowsBetween(W.unboundedPreceding, 0)


def renumber(segs: DataFrame, *order: str) -> DataFrame:
    """Numbers the rows that are left from 1, by ``order`` (else by their old numbers)."""
    return segs.withColumn("seq", F.row_number().over(W.partitionBy("project").orderBy(*(order or ("seq",)))).cast("long"))


def gap_after(segs: DataFrame, total_ms: int | None = None) -> DataFrame:
    """Adds gap_ms to the next start (of the last row, to ``total_ms``), and next_start."""
    end = F.col("end_ms") if total_ms is None else F.lit(total_ms)
    nxt = F.coalesce(F.lead("start_ms").over(ordered()), end)
    return segs.withColumn("next_start", nxt).withColumn("gap_ms", F.col("next_start") - F.col("end_ms"))


def runs(rows: DataFrame, at: str = "seq", key: str = "project") -> DataFrame:
    """Runs of consecutive positions: key, run (a label), first, last, n."""
    label = F.col(at) - F.row_number().over(W.partitionBy(key).orderBy(at))
    return rows.withColumn("run", label).groupBy(key, "run").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"))


def drop_repeats(segs: DataFrame, text: str, most: int = 2) -> DataFrame:
    """Of a run of equal texts, only the first ``most`` rows."""
    same = F.coalesce(F.lower(F.trim(text)) == F.lag(F.lower(F.trim(text))).over(ordered()), F.lit(False))
    marked = segs.withColumn("_run", F.sum((~same).cast("long")).over(so_far()))
    place = F.row_number().over(W.partitionBy("project", "_run").orderBy("seq"))
    return marked.withColumn("_place", place).where(F.col("_place") <= most).drop("_run", "_place")


def repeated_neighbours(segs: DataFrame, text: str, source: str) -> DataFrame:
    """Rows whose next row has the same text though its source differs."""
    return segs.withColumn("next_text", F.lead(text).over(ordered())).withColumn("next_source", F.lead(source).over(ordered())).where(f"{text} = next_text and {source} <> next_source")


def clamp_monotone(segs: DataFrame) -> DataFrame:
    """s = max(s, end before), e = max(e, s), down the rows: the new end is the prefix maximum of both."""
    end = F.max(F.greatest("start_ms", "end_ms"))
    return segs.withColumn("clamped_start", F.greatest("start_ms", F.coalesce(end.over(earlier()), F.col("start_ms")))).withColumn("clamped_end", end.over(so_far()))


def clamp_with_least(segs: DataFrame, least_ms: int) -> DataFrame:
    """As ``clamp_monotone`` with e = max(e, s + least): the recurrence is a prefix maximum after taking off ``least``
    a row."""
    step = F.col("seq") * least_ms
    base = F.greatest(F.col("end_ms"), F.col("start_ms") + least_ms) - step
    end = F.max(base)
    before = end.over(earlier()) + (F.col("seq") - 1) * least_ms
    return segs.withColumn("clamped_start", F.greatest("start_ms", F.coalesce(before, F.col("start_ms")))).withColumn("clamped_end", end.over(so_far()) + step)


def offsets(rows: DataFrame, length: str, out: str = "offset_ms") -> DataFrame:
    """Adds where each row begins if all lie end to end."""
    return rows.withColumn(out, F.coalesce(F.sum(length).over(earlier()), F.lit(0)))


def first_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_place", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def context_of_batches(segs: DataFrame, size: int, n: int = 4) -> DataFrame:
    """For each batch after the first, the last ``n`` rows of the one before: project, batch, place, seq."""
    rows = segs.withColumn("batch", F.expr(f"(seq - 1) div {size} + 1"))
    last = rows.withColumn("place", F.row_number().over(W.partitionBy("project", "batch").orderBy(F.col("seq").desc()))).where(F.col("place") <= n)
    there = rows.groupBy("project", F.col("batch").alias("b")).agg(F.count("*").alias("n")).select("project", (F.col("b") - 1).alias("batch"))
    return last.join(there, ["project", "batch"], "left_semi").select("project", "batch", "place", "seq")


def union_intervals(spans: DataFrame, low: str = "lo", high: str = "hi", key: str = "project") -> DataFrame:
    """Merges intervals that overlap or touch: key, lo, hi, n."""
    before = W.partitionBy(key).orderBy(low, high).rowsBetween(W.unboundedPreceding, -1)
    until = W.partitionBy(key).orderBy(low, high).rowsBetween(W.unboundedPreceding, 0)
    fresh = F.coalesce(F.col(low) > F.max(high).over(before), F.lit(True))
    marked = spans.withColumn("_new", fresh.cast("long")).withColumn("_part", F.sum("_new").over(until))
    return marked.groupBy(key, "_part").agg(F.min(low).alias("lo"), F.max(high).alias("hi"), F.count("*").alias("n")).drop("_part")


def sandwiched(segs: DataFrame, covered: str) -> DataFrame:
    """Rows that are not covered though both neighbours are."""
    near = [f(F.col(covered)).over(ordered()) for f in (F.lag, F.lead)]
    return segs.withColumn("_l", near[0]).withColumn("_r", near[1]).where(f"not {covered} and _l and _r").drop("_l", "_r")


def order_violations(items: DataFrame, first: str, last: str) -> DataFrame:
    """Rows that begin before the furthest source of the rows before them."""
    return items.withColumn("furthest", F.max(last).over(earlier())).where(F.col(first) < F.col("furthest"))


def sanitize(segs: DataFrame, total_ms: int, least_ms: int = 50, large_ms: int = 10_000) -> DataFrame:
    """Sorted by (start, end), clamped to the recording, at least ``least_ms`` long, cut where the next row begins.

    Adds clean_start, clean_end, clamped, overlap_fixed, gap_ms (to the next row, after the cut) and large_gap.
    """
    rows = renumber(segs, "start_ms", "end_ms", "seq")
    start = F.greatest(F.lit(0), F.least("start_ms", F.lit(total_ms)))
    rows = rows.withColumn("clean_start", start).withColumn("_end", F.greatest(F.col("clean_start") + least_ms, F.least("end_ms", F.lit(total_ms))))
    rows = rows.withColumn("clamped", (F.col("clean_start") != F.col("start_ms")) | (F.col("_end") != F.col("end_ms")))
    rows = rows.withColumn("_next", F.lead("clean_start").over(ordered()))
    over = F.coalesce(F.col("_end") > F.col("_next"), F.lit(False))
    rows = rows.withColumn("overlap_fixed", over).withColumn("clean_end", F.when(over, F.greatest(F.col("clean_start") + least_ms, "_next")).otherwise(F.col("_end")))
    rows = rows.withColumn("spoken_ms", F.col("_end") - F.col("clean_start")).withColumn("gap_ms", F.col("_next") - F.col("clean_end"))
    return rows.withColumn("large_gap", F.coalesce(F.col("gap_ms") >= large_ms, F.lit(False))).drop("_end", "_next")


def timeline_stats(clean: DataFrame) -> DataFrame:
    """Of ``sanitize``: clamped, overlaps, large gaps and spoken time (before cuts) by project."""
    count = lambda c: F.sum(F.col(c).cast("long"))
    return clean.groupBy("project").agg(count("clamped").alias("clamped"), count("overlap_fixed").alias("overlaps"), count("large_gap").alias("large_gaps"), F.sum("spoken_ms").alias("spoken_ms"))


def sessions(segs: DataFrame, gap_ms: int = 10_000, pad_before: int = 350, pad_after: int = 450) -> DataFrame:
    """Windows of talk: a new one where the gap to the latest end so far is long. project, session, win_start, win_end,
    first_seq, last_seq."""
    fresh = F.coalesce(F.col("start_ms") - F.max("end_ms").over(earlier()) >= gap_ms, F.lit(True))
    marked = segs.withColumn("_new", fresh.cast("long")).withColumn("session", F.sum("_new").over(so_far()))
    start = F.greatest(F.lit(0), F.min("start_ms") - pad_before)
    return marked.groupBy("project", "session").agg(
        start.alias("win_start"), F.greatest(start + 100, F.max("end_ms") + pad_after).alias("win_end"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    )


def allocate(rows: DataFrame, weight: str, span: str, start: str, keys: list[str], order: str) -> DataFrame:
    """Splits a span among the rows of a group by weight (rounded shares, the last takes what is left): adds part_start
    and part_end."""
    own = W.partitionBy(*keys).orderBy(order)
    every = W.partitionBy(*keys)
    total = F.sum(weight).over(every)
    share = F.floor((F.col(span) * F.col(weight) * 2 + total) / (total * 2)).cast("long")
    rows = rows.withColumn("_share", share).withColumn("_last", F.lead(order).over(own).isNull())
    at = F.coalesce(F.sum("_share").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("part_start", F.col(start) + at)
    end = F.when(F.col("_last"), F.col(start) + F.col(span)).otherwise(F.col("part_start") + F.col("_share"))
    return rows.withColumn("part_end", end).drop("_share", "_last")


def fit_voice(segs: DataFrame, raw: str, total_ms: int) -> DataFrame:
    """Fits recorded voices into their slots: borrow from the gap after, then trim silence, then change the speed.

    Adds base_ms, target_ms (after borrowing, towards 1.10), cut_head, cut_tail (beyond 1.20; a third and two thirds, at
    most 140 ms each), speed_pct (at least 110) and fitted_end (never past the next start).
    """
    rows = gap_after(segs, total_ms)
    raw_ms = F.col(raw)
    rows = rows.withColumn("base_ms", F.greatest(F.lit(100), F.col("end_ms") - F.col("start_ms")))
    lack = F.greatest(F.lit(0), F.expr(f"{raw} * 100 div 110") - F.col("base_ms"))
    room = F.greatest(F.lit(0), F.col("gap_ms"))
    borrow = F.when((raw_ms * 100 > F.col("base_ms") * 110) & (room > 1), F.least(lack, room)).otherwise(F.lit(0))
    rows = rows.withColumn("target_ms", F.col("base_ms") + borrow)
    need = F.when(raw_ms * 100 > F.col("target_ms") * 120, F.expr(f"({raw} * 10 - target_ms * 12 + 5) div 10")).otherwise(F.lit(0))
    rows = rows.withColumn("_need", need).withColumn("_head", F.expr("(_need * 2 + 3) div 6"))
    rows = rows.withColumn("cut_head", F.least(F.lit(140), "_head")).withColumn("cut_tail", F.least(F.lit(140), F.col("_need") - F.col("_head")))
    rows = rows.withColumn("trimmed_ms", F.greatest(F.lit(50), raw_ms - F.col("cut_head") - F.col("cut_tail")))
    rows = rows.withColumn("speed_pct", F.greatest(F.lit(110), F.expr("(trimmed_ms * 200 + target_ms) div (target_ms * 2)")))
    rows = rows.withColumn("fitted_ms", F.expr("trimmed_ms * 100 div speed_pct"))
    return rows.withColumn("fitted_end", F.least(F.col("start_ms") + F.col("fitted_ms"), F.greatest("next_start", "start_ms"))).drop("_need", "_head")


def swollen(raw: str, words: str) -> Column:
    """Voices that no fitting saves: over 1.30, over 1.15 without a quarter second of silence, in a slot of at most ten
    seconds."""
    slot = F.col("end_ms") - F.col("start_ms")
    return (F.col(raw) * 100 > slot * 130) & ((F.col(raw) - 250) * 100 > slot * 115) & (slot <= 10_000) & (slot > 0) & (F.col(words) <= 60)


def ceilings(segs: DataFrame, hard_gap: int = 850, tail: int = 400, buffer: int = 80) -> DataFrame:
    """Adds e_max, how far the row may be drawn out: to just before the next start, or a little into a long gap."""
    nxt = F.lead("start_ms").over(ordered())
    limit = F.when(nxt.isNull(), F.col("end_ms") + tail).when(nxt - F.col("end_ms") >= hard_gap, F.least(F.col("end_ms") + tail, nxt - buffer)).otherwise(nxt - buffer)
    return segs.withColumn("e_max", F.greatest("end_ms", limit))


def ceilings_over_junk(segs: DataFrame, junk: str, hard_gap: int = 850, tail: int = 400, buffer: int = 80, most: int = 1000) -> DataFrame:
    """``ceilings`` and e_max_ext: over rows of junk that follow, up to the first long gap or row that is none, and at
    most ``most`` beyond the end. The place where the walk stops is the first marked row after this one."""
    before = F.lag("end_ms").over(ordered())
    gap = F.col("start_ms") - before
    stop = F.when(gap >= hard_gap, F.least(before + tail, F.col("start_ms") - buffer)).when(~F.col(junk), F.col("start_ms") - buffer)
    later = ordered().rowsBetween(1, W.unboundedFollowing)
    rows = ceilings(segs, hard_gap, tail, buffer).withColumn("_stop", stop)
    limit = F.coalesce(F.first("_stop", ignorenulls=True).over(later), F.coalesce(F.last("end_ms").over(later), F.col("end_ms")) + tail)
    return rows.withColumn("e_max_ext", F.greatest("e_max", F.least(limit, F.col("end_ms") + most))).drop("_stop")


def speech_rate(rows: DataFrame, words: str, wps: float = 3.3, most: float = 1.6) -> DataFrame:
    """Adds wps (words a second), speedup against ``wps``, too_fast and severity (0 to 2)."""
    seconds = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(1)) / 1000
    rows = rows.withColumn("wps", F.col(words) / seconds).withColumn("speedup", F.col("wps") / wps)
    return rows.withColumn("too_fast", F.col("speedup") > most).withColumn("severity", F.when(F.col("speedup") > 2 * most, 2).when(F.col("speedup") > most, 1).otherwise(0))


def slice_plan(projects: DataFrame, duration: str, workers: int = 4) -> DataFrame:
    """Tumbling slices of a recording: its length by tiers decides a slice's; the last one is shorter."""
    d = F.col(duration)
    length = F.when(d <= 300_000, F.greatest(F.lit(30_000), F.ceil(d / workers).cast("long"))).when(d <= 1_800_000, F.lit(150_000)).otherwise(F.lit(300_000)).cast("long")
    rows = projects.withColumn("length_ms", length).withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil(d / F.col("length_ms")) - 1))))
    begin = F.col("slice") * F.col("length_ms")
    return rows.withColumn("slice_start", begin).withColumn("slice_ms", F.least("length_ms", d - begin))


def overlapping_chunks(projects: DataFrame, duration: str, chunk_ms: int, overlap_ms: int) -> DataFrame:
    """Sliding chunks that overlap; the last one ends with the recording."""
    stride = chunk_ms - overlap_ms
    last = F.greatest(F.lit(0), F.ceil((F.col(duration) - chunk_ms) / stride)).cast("long")
    rows = projects.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return rows.withColumn("chunk_start", F.col("chunk") * stride).withColumn("chunk_end", F.least(F.col("chunk_start") + chunk_ms, F.col(duration)))


def shift(segs: DataFrame, offset_ms: int, least_ms: int = 80) -> DataFrame:
    """Moves all times earlier; none before zero, none shorter than ``least_ms``."""
    start = F.greatest(F.lit(0), F.col("start_ms") - offset_ms)
    return segs.withColumn("new_start", start).withColumn("new_end", F.greatest(F.col("new_start") + least_ms, F.col("end_ms") - offset_ms))


def chunked_prefix(rows: DataFrame, key: str, order: str, value: str, how: str = "sum", chunk: int = 4096) -> DataFrame:
    """Adds ``prefix``, the sum or maximum of all earlier rows of the key (null for the first), without a window over a
    whole key: rows are folded within chunks of the order, chunks among each other, so that one key may hold most of
    all rows. ``order`` is an integer position."""
    fold = {"sum": F.sum, "max": F.max}[how]
    rows = rows.withColumn("_chunk", F.expr(f"{order} div {chunk}"))
    parts = rows.groupBy(key, "_chunk").agg(fold(value).alias("_part"))
    before = fold("_part").over(W.partitionBy(key).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1))
    parts = parts.select(key, "_chunk", before.alias("_before"))
    inner = fold(value).over(W.partitionBy(key, "_chunk").orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    out = rows.withColumn("_inner", inner).join(parts, [key, "_chunk"])
    if how == "sum":
        prefix = F.when(F.col("_before").isNull() & F.col("_inner").isNull(), None).otherwise(F.coalesce("_before", F.lit(0)) + F.coalesce("_inner", F.lit(0)))
    else:
        prefix = F.greatest("_before", "_inner")
    return out.withColumn("prefix", prefix).drop("_chunk", "_before", "_inner")
