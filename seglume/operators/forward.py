"""Candidates in a forward window: from a place in a project's order on, the next rows with content.

In rank space: a row's total rank counts the free rows before it, its content rank those with content. From a start with
ranks t and c, the window is the free rows of total rank under t + ``most`` and content rank under c + ``content``. As
ranks are dense, an equality join on blocks of ``most`` ranks meets each start with at most two blocks, whatever the
project's size; ranks come from prefixes in chunks, so no window holds a whole project.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seglume.operators.timeline import chunked_prefix


def forward_window(starts: DataFrame, rows: DataFrame, content: int = 8, most: int = 16) -> DataFrame:
    """(project, item, pos, place): of each start (project, item, start_pos) the rows (project, pos, junk, taken) in its
    window, in order from 0. Rows that are taken are left out; junk rows count for ``most`` only. Positions are integers
    from 0, each once a project."""
    zero = F.lit(0).cast("long")
    marks = rows.select("project", F.lit(None).cast("long").alias("item"), (F.col("pos") * 2 + 1).alias("_at"), "pos", (~F.col("taken")).cast("long").alias("_free"), (~F.col("taken") & ~F.col("junk")).cast("long").alias("_content"))
    asked = starts.select("project", F.col("item").cast("long").alias("item"), (F.col("start_pos") * 2).alias("_at"), F.lit(None).cast("long").alias("pos"), zero.alias("_free"), zero.alias("_content"))
    both = marks.unionByName(asked)
    both = chunked_prefix(both, "project", "_at", "_free").withColumn("_t", F.coalesce("prefix", zero)).drop("prefix")
    both = chunked_prefix(both, "project", "_at", "_content").withColumn("_c", F.coalesce("prefix", zero)).drop("prefix")
    free = both.where("pos is not null and _free = 1").select("project", "pos", F.col("_t").alias("_rt"), F.col("_c").alias("_rc"), F.expr(f"_t div {most}").alias("_block"))
    begun = both.where("item is not null").select("project", "item", "_t", "_c", F.explode(F.array(F.expr(f"_t div {most}"), F.expr(f"_t div {most} + 1"))).alias("_block"))
    inside = (F.col("_rt") >= F.col("_t")) & (F.col("_rt") < F.col("_t") + most) & (F.col("_rc") < F.col("_c") + content)
    return begun.join(free, ["project", "_block"]).where(inside).select("project", "item", "pos", (F.col("_rt") - F.col("_t")).alias("place"))
