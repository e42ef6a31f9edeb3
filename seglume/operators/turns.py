"""Rules of neighbours that need no walk from row to row: what looks like a recursion is a lag or a prefix maximum.

Rows are ordered by seq within a project; windows stream, so a task keeps a few numbers of a project.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

def _order():
    return W.partitionBy("project").orderBy("seq")


def _before(*keys: str):
    return W.partitionBy("project", *keys).orderBy("seq").rowsBetween(W.unboundedPreceding, -1)


def speaker_turns(rows: DataFrame, gap_ms: int = 850) -> DataFrame:
    """Rows with a voice (raw_ms) whose speaker is the one before them, and who begin within ``gap_ms`` of the end so far,
    join a turn: adds turn and offset_ms, where the voice begins in the turn's recording, with a pause of at most
    ``gap_ms`` between two. The first row of a project counts even without a voice; a blank speaker joins none. Rows end no
    earlier than they begin, so the latest end of a speaker's run is that of the turn."""
    first = F.row_number().over(_order()) == 1
    rows = rows.withColumn("_first", first).where(F.col("raw_ms").isNotNull() | F.col("_first")).drop("_first")
    rows = rows.withColumn("_name", F.lower(F.trim(F.coalesce("speaker", F.lit("")))))
    other = F.coalesce((F.col("_name") != F.lag("_name").over(_order())) | (F.col("_name") == ""), F.lit(True))
    rows = rows.withColumn("_other", other).withColumn("_run", F.sum(F.col("_other").cast("long")).over(_order().rowsBetween(W.unboundedPreceding, 0)))
    late = F.col("start_ms") - F.max("end_ms").over(_before("_run")) >= gap_ms
    cut = (F.col("_other") | F.coalesce(late, F.lit(False))).cast("long")
    rows = rows.withColumn("_cut", cut).withColumn("turn", F.sum("_cut").over(_order().rowsBetween(W.unboundedPreceding, 0)))
    gap = F.greatest(F.lit(0), F.col("start_ms") - F.max("end_ms").over(_before("turn")))
    rows = rows.withColumn("_pause", F.coalesce(F.least(F.lit(gap_ms), gap), F.lit(0)))
    so_far = W.partitionBy("project", "turn").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    voice = F.coalesce("raw_ms", F.lit(0))
    at = F.sum(F.col("_pause") + voice).over(so_far) - voice
    return rows.withColumn("offset_ms", at).drop("_name", "_other", "_run", "_cut", "_pause")


def turn_texts(turns: DataFrame, text: str = "text") -> DataFrame:
    """project, turn, speaker, first_seq, last_seq, start_ms, end_ms, text: the texts of a turn in order, with spaces."""
    said = F.filter(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.trim(F.coalesce(text, F.lit(""))).alias("t")))), lambda x: x["t"]), lambda t: t != "")
    ends = [F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")]
    return turns.groupBy("project", "turn").agg(F.min_by("speaker", "seq").alias("speaker"), *ends, F.array_join(said, " ").alias("text"))


def split_overlaps(rows: DataFrame, gap_ms: int = 20, least_ms: int = 300) -> DataFrame:
    """Overlapping neighbours part at the middle of their overlap, with a small gap; none gets shorter than ``least_ms``:
    project, seq, start_ms, end_ms. Where a row begins hangs on its neighbour's given end only, and where it ends on its
    own new beginning and the next row's given one."""
    half = gap_ms // 2
    rows = rows.select("project", "seq", F.col("start_ms").alias("s"), F.when(F.col("end_ms") <= F.col("start_ms"), F.col("start_ms") + 500).otherwise(F.col("end_ms")).alias("e"))
    middle = lambda end, start: F.floor((end + start) / 2)
    earlier, later = F.lag("e").over(_order()), F.lead("s").over(_order())
    begin = F.when(F.col("s") < earlier, F.least(F.col("e") - least_ms, middle(earlier, F.col("s")) + half)).otherwise(F.col("s"))
    rows = rows.withColumn("start_ms", begin)
    end = F.when(later < F.col("e"), F.greatest(F.col("start_ms") + least_ms, middle(F.col("e"), later) - half)).otherwise(F.col("e"))
    return rows.withColumn("end_ms", end).select("project", "seq", "start_ms", "end_ms")


def sync_to_waveform(rows: DataFrame, least_ms: int = 300) -> DataFrame:
    """Places the parts of a fitted voice (part_start and part_end within the raw recording, cut_ms taken off its head,
    speed_pct, slot_start) on the timeline, in order and none shorter than ``least_ms``: project, seq, start_ms, end_ms.

    A part ends at the latest of its own end, its own beginning and the end before it, the last two ``least_ms`` on: a
    prefix maximum of what is left when ``least_ms`` a row is taken off."""
    at = lambda c: F.col("slot_start") + F.expr(f"greatest(0, {c} - cut_ms) * 100 div speed_pct")
    rows = rows.withColumn("_k", F.row_number().over(_order())).withColumn("_s", at("part_start")).withColumn("_e", at("part_end"))
    own: Column = F.greatest(F.col("_s") + least_ms, F.col("_e")) - F.col("_k") * least_ms
    rows = rows.withColumn("end_ms", F.max(own).over(_order().rowsBetween(W.unboundedPreceding, 0)) + F.col("_k") * least_ms)
    start = F.greatest("_s", F.coalesce(F.lag("end_ms").over(_order()), F.col("_s")))
    return rows.withColumn("start_ms", start).select("project", "seq", "start_ms", "end_ms")
