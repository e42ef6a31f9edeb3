"""Audits of batches, rescue of items, and what else compares rows of a script with its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from seglume.functions.similarity import of_columns, piece_similarity
from seglume.functions.text import word_count
from seglume.operators.lineage import edges
from seglume.operators.relational import pick


def truncated_tails(segs: DataFrame, text: str = "translated_text", slack_ms: int = 250) -> DataFrame:
    """Batches of five rows or more whose last four or more rows, a quarter at least, have no text, unless the last text
    reaches the batch's end: project, batch, last_seq."""
    done = F.trim(F.coalesce(text, F.lit(""))) != ""
    n = segs.groupBy("project", "batch").agg(
        F.count("*").alias("n"), F.max(F.when(done, F.col("seq"))).alias("last_seq"), F.max("seq").alias("top"), F.max_by("end_ms", "seq").alias("end"), F.max_by(F.when(done, F.col("end_ms")), F.when(done, F.col("seq"))).alias("reach")
    )
    missing = F.col("top") - F.col("last_seq")
    return n.where((F.col("n") >= 5) & (missing >= 4) & (missing * 4 >= F.col("n")) & (F.col("reach") < F.col("end") - slack_ms)).select("project", "batch", "last_seq")


def too_fast(segs: DataFrame, text: str = "translated_text") -> DataFrame:
    """Rows of 1.5 s or more with more words than can be said: four a second, 4.5 with numbers."""
    seconds, words = (F.col("end_ms") - F.col("start_ms")) / 1000, word_count(text)
    rate = F.when(F.col(text).rlike(r"\d"), 4.5).otherwise(4.0)
    return segs.where((seconds >= 1.5) & (words > F.greatest(F.lit(6), F.bround(seconds * rate).cast("int"))) & (words > seconds * rate))


def big_gaps(items: DataFrame, segs: DataFrame, gap_ms: int = 850) -> DataFrame:
    """The first silent gap within an item's sources: project, item, seq (the source before it), gap."""
    rows = edges(items).join(segs.select("project", "seq", "start_ms", "end_ms"), ["project", "seq"])
    gap = F.lead("start_ms").over(W.partitionBy("project", "item").orderBy("seq")) - F.col("end_ms")
    return pick(rows.withColumn("gap", gap).where(F.col("gap") >= gap_ms).select("project", "item", "seq", "gap"), ["project", "item"], "seq")


def one_to_one(lines: DataFrame, segs: DataFrame, low: float = 0.5) -> DataFrame:
    """Line i against source i, and against its neighbours: adds score, shift (-1, 0, 1) and suspicious. A shift is
    named where a neighbour fits better by 0.2."""
    w = W.partitionBy("project").orderBy("seq")
    src = segs.select("project", "seq", F.col("text").alias("_t"), F.lag("text").over(w).alias("_b"), F.lead("text").over(w).alias("_a"))
    score = of_columns(piece_similarity)
    rows = lines.join(src, ["project", "seq"], "left").withColumn("score", score("line", "_t")).withColumn("_sb", score("line", "_b")).withColumn("_sa", score("line", "_a"))
    shift = F.when(F.greatest("_sb", "_sa") < F.col("score") + 0.2, 0).when(F.col("_sa") >= F.col("_sb"), 1).otherwise(-1)
    return rows.withColumn("shift", shift).withColumn("suspicious", (F.col("score") < low) | (shift != 0)).drop("_t", "_b", "_a", "_sb", "_sa")


def quarantine(items: DataFrame, windows: DataFrame, max_retries: int = 2) -> DataFrame:
    """Bad items of windows (project, lo, hi, retry_count; positions) that were tried often enough are set apart: adds
    quarantined."""
    spent = windows.where(F.col("retry_count") >= max_retries).select("project", F.explode(F.sequence("lo", "hi")).alias("pos")).distinct().withColumn("_q", F.lit(True))
    at = items.withColumn("pos", F.row_number().over(W.partitionBy("project").orderBy("item")).cast("long"))
    return at.join(spent, ["project", "pos"], "left").withColumn("quarantined", F.coalesce("_q", F.lit(False)) & F.col("bad")).drop("_q", "pos")


def best_attempt(attempts: DataFrame) -> DataFrame:
    """Of a batch's attempts (coverage, errors, attempt) the one that covers most, then errs least, then came first."""
    return pick(attempts, ["project", "batch"], -F.col("coverage"), "errors", "attempt")


def child_times(pieces: DataFrame, children: DataFrame, length: str = "len_ms") -> DataFrame:
    """Times within pieces (project, piece, len_ms) that are played one after another, as times within the whole:
    children have project, piece, start_ms, end_ms."""
    before = F.coalesce(F.sum(length).over(W.partitionBy("project").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = pieces.select("project", "piece", before.alias("_at"))
    moved = children.join(at, ["project", "piece"])
    return moved.withColumn("start_ms", F.col("start_ms") + F.col("_at")).withColumn("end_ms", F.col("end_ms") + F.col("_at")).drop("_at")


def restore_from(stage: DataFrame, source: DataFrame, key: str = "project") -> DataFrame:
    """A stage's rows, but the source's for projects in which the two have not as many rows."""
    n = source.groupBy(key).agg(F.count("*").alias("_s")).join(stage.groupBy(key).agg(F.count("*").alias("_n")), key, "left")
    stale = n.where(F.col("_s") != F.coalesce("_n", F.lit(0))).select(key)
    return stage.join(stale, key, "left_anti").unionByName(source.join(stale, key, "left_semi").select(*stage.columns))


def locked(found: DataFrame, kept: DataFrame) -> DataFrame:
    """Entities found and entities that a user locked: a locked one takes the place of a found one. Adds is_locked."""
    rows = kept.withColumn("is_locked", F.lit(True)).unionByName(found.withColumn("is_locked", F.lit(False)), allowMissingColumns=True)
    return pick(rows, ["raw"], F.when(F.col("is_locked"), 0).otherwise(1), "batch", "pos")


def audit(segs: DataFrame, text: str, source: str) -> DataFrame:
    """All findings of the three audits: project, seq, kind."""
    from seglume.operators.timeline import repeated_neighbours

    tail = truncated_tails(segs, text).select("project", F.col("last_seq").alias("seq"), F.lit("TRUNCATED_BATCH_TAIL").alias("kind"))
    twice = repeated_neighbours(segs.where(F.trim(F.coalesce(text, F.lit(""))) != ""), text, source).select("project", "seq", F.lit("DUPLICATE").alias("kind"))
    fast = too_fast(segs, text).select("project", "seq", F.lit("OVER_SPEED_BLOWUP").alias("kind"))
    return tail.unionByName(twice).unionByName(fast)


def column_counts(rows: DataFrame, key: str, **tests: Column) -> DataFrame:
    """Counts of each test by key: partial sums of the parts of a job, added up."""
    return rows.groupBy(key).agg(*[F.count_if(t).alias(k) for k, t in tests.items()])
