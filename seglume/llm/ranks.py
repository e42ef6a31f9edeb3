"""Positions in a global order without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from seglume.storage import stage


def numbered(rows: DataFrame, group: str, order: list[str], label: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``at`` (from 0, in ``order`` within ``group``), and the size ``n`` of each group. Nulls come first.

    Rows are dealt by ranges of (group, order), so a group with a third of all rows lies in many tasks; equal rows are
    told apart by a number of their own, or they would lie in one. Only counts of (range, group) are summed up.
    """
    own = stage(rows.withColumn("_own", F.monotonically_increasing_id()), label)
    keys = [group, *order, "_own"]
    dealt = own.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_own")
    dealt = stage(dealt.withColumn("_mid", F.monotonically_increasing_id()), label).withColumn("_part", F.shiftright("_mid", 33))
    counts = dealt.groupBy("_part", group).agg(F.count("*").alias("_c"), F.min("_mid").alias("_first"))
    before = F.sum("_c").over(W.partitionBy(group).orderBy("_part")) - F.col("_c")
    starts = stage(counts.withColumn("_shift", before - F.col("_first")), label)
    placed = dealt.join(starts.select("_part", group, "_shift"), ["_part", group])
    sizes = starts.groupBy(group).agg(F.sum("_c").alias("n"))
    return placed.withColumn("at", F.col("_mid") + F.col("_shift")).drop("_mid", "_part", "_shift"), sizes
