"""Lineage between stages: which source segments an item was made of, as an edge table (project, item, seq).

Everything that asks "whose children" or "whose parent" is an equality join on the edges. Items have project, item (the
order) and src (an array of source numbers).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def parse_csv(column: str) -> Column:
    """A list such as ``1, 2,x,3`` as integers; what is no number is left out."""
    return F.filter(F.transform(F.split(F.coalesce(F.col(column), F.lit("")), ","), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull())


def to_csv(column: str) -> Column:
    return F.array_join(column, ",")


def expand_range(column: str) -> Column:
    """A pair [a, b] with a < b means all numbers from a to b."""
    src = F.col(column)
    return F.when((F.size(src) == 2) & (F.get(src, F.lit(1)) > F.get(src, F.lit(0))), F.sequence(F.get(src, F.lit(0)), F.get(src, F.lit(1)))).otherwise(src)


def edges(items: DataFrame) -> DataFrame:
    """project, item, seq, place (of the source in the item)."""
    return items.select("project", "item", F.posexplode("src").alias("place", "seq")).withColumn("seq", F.col("seq").cast("long"))


def gather(items: DataFrame, segs: DataFrame, text: str) -> DataFrame:
    """Joined text, start and end of each item's sources that exist: project, item, text, start_ms, end_ms, n."""
    rows = edges(items).join(segs.select("project", "seq", text, "start_ms", "end_ms"), ["project", "seq"])
    parts = F.sort_array(F.collect_list(F.struct("place", F.col(text).alias("t"))))
    return rows.groupBy("project", "item").agg(F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias("text"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n"))


def parent_of(segs: DataFrame, items: DataFrame) -> DataFrame:
    """Adds parent: the first item that has the segment among its sources, or null."""
    first = edges(items).groupBy("project", "seq").agg(F.min("item").alias("parent"))
    return segs.join(first, ["project", "seq"], "left")


def write_back(segs: DataFrame, items: DataFrame) -> DataFrame:
    """Adds tts_index: of several items that name the segment the last one."""
    last = edges(items).groupBy("project", "seq").agg(F.max("item").alias("tts_index"))
    return segs.join(last, ["project", "seq"], "left")


def remap(rows: DataFrame, mapping: DataFrame, column: str, key: str = "project") -> DataFrame:
    """New numbers for old ones (mapping: project, old, new); numbers that are not in it stay."""
    return rows.join(mapping.withColumnRenamed("old", column), [key, column], "left").withColumn(column, F.coalesce("new", column)).drop("new")


def edit_parents(segs: DataFrame, items: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits of items (project, item, text): the first source gets the text, the others become empty merged children."""
    hit = edges(items).join(edits, ["project", "item"]).withColumn("first", F.min("seq").over(W.partitionBy("project", "item")) == F.col("seq"))
    last = hit.groupBy("project", "seq").agg(F.max_by(F.struct("text", "first"), "item").alias("e"))
    rows = segs.join(last, ["project", "seq"], "left")
    edited, first = F.col("e").isNotNull(), F.col("e.first")
    text = F.when(~edited, F.col("translated_text")).when(first, F.col("e.text")).otherwise("")
    state = F.when(~edited, F.col("status")).when(~first, "MERGED_CHILD").when(F.col("e.text") != "", "TRANSLATED").otherwise(F.col("status"))
    return rows.withColumn("translated_text", text).withColumn("status", state).drop("e")


def edit_children(items: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits of segments (project, seq, text) reach the item only if it is made of one source."""
    only = edges(items).join(items.where(F.size("src") == 1).select("project", "item"), ["project", "item"], "left_semi")
    hit = only.join(edits, ["project", "seq"]).groupBy("project", "item").agg(F.max_by("text", "seq").alias("_text"))
    return items.join(hit, ["project", "item"], "left").withColumn("text", F.coalesce("_text", "text")).drop("_text")


def splice(rows: DataFrame, rescued: DataFrame) -> DataFrame:
    """Replaces all rows of some parents by others and numbers anew, in the order of (parent, seq)."""
    kept = rows.join(rescued.select("project", "parent").distinct(), ["project", "parent"], "left_anti")
    every = kept.unionByName(rescued.select(*rows.columns))
    return every.withColumn("new_seq", F.row_number().over(W.partitionBy("project").orderBy("parent", "seq")).cast("long"))


# ---- checks of items against their sources

def duplicate_sources(items: DataFrame) -> DataFrame:
    """Sources that several items name, but for items of one source each that follow each other: project, seq, n."""
    sized = edges(items).join(items.select("project", "item", F.size("src").alias("n_src")), ["project", "item"])
    by = sized.groupBy("project", "seq").agg(F.count("*").alias("n"), F.count_distinct("item").alias("items"), F.max("n_src").alias("most"), F.min("item").alias("lo"), F.max("item").alias("hi"))
    return by.where("items > 1 and not (most = 1 and hi - lo + 1 = items)").select("project", "seq", "n")


def shared_sources(items: DataFrame) -> DataFrame:
    """Items of one source that several of them share: project, seq, items (in order)."""
    one = items.where(F.size("src") == 1).select("project", F.get("src", F.lit(0)).cast("long").alias("seq"), "item")
    return one.groupBy("project", "seq").agg(F.sort_array(F.collect_list("item")).alias("items")).where("size(items) > 1")


def silently_missing(segs: DataFrame, items: DataFrame, short_ms: int = 3500) -> DataFrame:
    """Sources of no item, but for short ones between two that have items: project, seq."""
    named = edges(items).select("project", "seq").distinct().withColumn("_c", F.lit(True))
    rows = segs.join(named, ["project", "seq"], "left").withColumn("_c", F.coalesce("_c", F.lit(False)))
    w = W.partitionBy("project").orderBy("seq")
    near = F.coalesce(F.lag("_c").over(w), F.lit(False)) & F.coalesce(F.lead("_c").over(w), F.lit(False))
    return rows.withColumn("_near", near).where(~F.col("_c") & ~(F.col("_near") & (F.col("end_ms") - F.col("start_ms") <= short_ms))).select("project", "seq")


def verify(segs: DataFrame, items: DataFrame) -> DataFrame:
    """The invariants by project: silent (missing sources), duplicates, disorder (items that begin before an earlier
    item's last source), overlaps (items that begin before the end of the one before), empty (no sources), passed."""
    by_seq = edges(items).join(segs.select("project", "seq", "start_ms", "end_ms"), ["project", "seq"])
    spans = by_seq.groupBy("project", "item").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.min_by("start_ms", "seq").alias("s"), F.max_by("end_ms", "seq").alias("e"))
    w = W.partitionBy("project").orderBy("item")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    checked = spans.withColumn("bad_order", F.coalesce(F.col("lo") < F.max("hi").over(before), F.lit(False))).withColumn("bad_time", F.coalesce(F.col("s") + 10 < F.lag("e").over(w), F.lit(False)))
    count = lambda rows, name: rows.groupBy("project").agg(F.count("*").alias(name))
    parts = [
        count(silently_missing(segs, items), "silent"),
        count(duplicate_sources(items), "duplicates"),
        checked.groupBy("project").agg(F.count_if("bad_order").alias("disorder"), F.count_if("bad_time").alias("overlaps")),
        count(items.where(F.size("src") == 0), "empty"),
    ]
    out = segs.select("project").distinct()
    for p in parts:
        out = out.join(p, "project", "left")
    names = ["silent", "duplicates", "disorder", "overlaps", "empty"]
    out = out.select("project", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    return out.withColumn("passed", F.expr(" + ".join(names) + " = 0"))


def hard_flags(column: str = "flags") -> Column:
    """Flags that make an item bad, by their first words."""
    return F.filter(column, lambda f: f.rlike(HARD))


#: Beginnings of flags that make an item bad.
HARD = "^(DROPPED_CHUNK|LOW_MATCH|TIE|EMPTY_SRC|GAP_COLLISION)"


def longest_run(items: DataFrame, bad: Column) -> DataFrame:
    """project, items, bad, longest (run of bad items that follow each other)."""
    w = W.partitionBy("project").orderBy("item")
    rows = items.select("project", "item", bad.alias("_bad"), F.row_number().over(w).alias("_n"))
    own = rows.where("_bad").withColumn("_run", F.col("_n") - F.row_number().over(w)).groupBy("project", "_run").agg(F.count("*").alias("n"))
    most = own.groupBy("project").agg(F.sum("n").alias("bad"), F.max("n").alias("longest"))
    every = items.groupBy("project").agg(F.count("*").alias("items"))
    return every.join(most, "project", "left").select("project", "items", F.coalesce("bad", F.lit(0)).alias("bad"), F.coalesce("longest", F.lit(0)).alias("longest"))


def closed_gate(items: DataFrame, bad: Column, most_per_mille: int = 15, most_run: int = 3) -> DataFrame:
    """Opens only for projects with few bad items and no long run of them."""
    return longest_run(items, bad).withColumn("open", (F.col("bad") * 1000 <= F.col("items") * most_per_mille) & (F.col("longest") < most_run))


def retry_windows(items: DataFrame, bad: Column, flags: str = "flags") -> DataFrame:
    """Runs of bad items, a good one on each side, merged where they meet: project, lo, hi, src_lo, src_hi, reasons."""
    from seglume.operators.timeline import runs, union_intervals

    w = W.partitionBy("project")
    at = items.withColumn("pos", F.row_number().over(w.orderBy("item")).cast("long")).withColumn("_bad", bad)
    ends = at.groupBy("project").agg(F.max("pos").alias("end"))
    spans = runs(at.where("_bad"), "pos").join(ends, "project").select("project", F.greatest(F.lit(1), F.col("first") - 1).alias("lo"), F.least("end", F.col("last") + 1).alias("hi"))
    windows = union_intervals(spans).select("project", "lo", "hi")
    inside = windows.withColumn("pos", F.explode(F.sequence("lo", "hi"))).join(at, ["project", "pos"])
    return inside.groupBy("project", "lo", "hi").agg(
        F.min(F.array_min("src")).alias("src_lo"), F.max(F.array_max("src")).alias("src_hi"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(flags)))).alias("reasons")
    )


def mega_summary(words: str, chars: str) -> Column:
    """Items that stand for very many sources: twenty, or six with few words for their length."""
    n = F.size("src")
    return (n >= 20) | ((n >= 6) & (F.col(words) * 100 < F.col(chars) * 28))


def should_retry(coverage_pct: Column, failed: Column) -> Column:
    """Whether a batch is tried again: never at 96 % with two failures at most, else below 95 % or beyond three."""
    return ~((coverage_pct >= 96) & (failed <= 2)) & ((coverage_pct < 95) | (failed > 3))
