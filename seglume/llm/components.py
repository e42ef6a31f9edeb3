"""Connected components by alternating stars, on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seglume.storage import stage


#: So few links are one partition, in which Spark needs no exchange between the steps of a round.
_FEW = 1 << 15


def connected(nodes: DataFrame, links: DataFrame, label: str, most_rounds: int = 60) -> DataFrame:
    """(node, label): label is the smallest node that links reach. ``nodes`` is distinct, ``links`` has a and b.

    Each round points every node at the smallest neighbour (large star), then the smaller neighbours of a node at the
    smallest of them (small star), until nothing moves: about log2 of the longest chain. A round aggregates with
    map-side partial minima and joins on the node; the links' number never grows. Joins are by sorted partitions: no side
    is gathered on the driver to be broadcast.
    """
    def mark(x: DataFrame):
        return tuple(x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def dealt(x: DataFrame) -> DataFrame:
        return x.coalesce(1) if before[0] <= _FEW else x

    pairs = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    before = mark(pairs)
    for _ in range(most_rounds):
        if not before[0]:
            break
        ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("end")
        both = dealt(pairs).select(ends).select("end.a", "end.b")
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        rest = large.join(least.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = stage(dealt(rest.unionByName(least.select("a", F.col("m").alias("b")))).distinct(), label)
        last, before = before, mark(pairs)  # each round's rows are counted once
        if last == before:
            break
    else:
        raise RuntimeError(f"components of {label} did not settle in {most_rounds} rounds")
    roots = pairs.groupBy("a").agg(F.min("b").alias("root"))
    return nodes.join(roots.hint("merge"), nodes["node"] == roots["a"], "left").select("node", F.coalesce("root", "node").alias("label"))
