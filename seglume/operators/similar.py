"""Pairs of like texts without comparing all: a set-similarity join finds pairs before any is scored.

What ``ratio`` counts as matching is no more than the characters that two texts have in common, whatever their order. So
a text is a set of (character, which one of its kind), and a pair with a likeness of ``least`` shares at least
least / 2 * (both lengths) of them. Sets are ordered by rarity over all texts; two sets that share so many must share
one within a prefix of each. Prefixes meet by equality, lengths and the common part are checked, and only then a pair is
scored.

Where many texts have a token in their prefix, nearly all of them meet. So a meeting is no joined row: both sides of a
token come to one task, in pieces of up to ``_PIECE`` rows, sorted, and are counted there as a product of matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seglume.functions.similarity import ratios
from seglume.storage import stage

#: Rows of one side of a token that meet at once, meetings that make a task, and those that are counted at once.
_PIECE, _TASK, _STRIP = 2048, 1 << 23, 1 << 20


def _tokens(text: Column) -> Column:
    """Each character with its number among those of its kind."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    kinds = F.transform(F.array_distinct(chars), lambda k: F.struct(k.alias("k"), F.size(F.filter(chars, lambda c: c == k)).alias("n")))
    return F.flatten(F.transform(kinds, lambda x: F.transform(F.sequence(F.lit(1), x["n"]), lambda i: F.concat(x["k"], i.cast("string")))))


def _ordered(rows: DataFrame, rarity: DataFrame) -> DataFrame:
    """key, id, text, set (ranks of tokens, the rarest first)."""
    each = rows.select("key", "id", "text", F.explode(_tokens(F.col("text"))).alias("token")).join(rarity, "token")
    return each.groupBy("key", "id", "text").agg(F.sort_array(F.collect_list("rank")).alias("set"))


def _meetings(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Rows of both sides for each token of their prefixes that the other side has too, dealt and sorted by (cell, at_a,
    at_b): every two pieces of a token's sides. key, cell, at_a, at_b, token, right, id_a, id_b, text, set."""
    rows = [x.select("key", "id", "text").where("coalesce(text, '') <> ''") for x in (left, right)]
    counted = rows[0].select("text").unionByName(rows[1].select("text")).select(F.explode(_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("c"))
    rarity = stage(counted.repartitionByRange("c", "token").sortWithinPartitions("c", "token").select("token", F.monotonically_increasing_id().alias("rank")), "similar-tokens")
    ids = [dict(x.dtypes)["id"] for x in rows]
    a, b = (_ordered(x, rarity) for x in rows)
    a = a.select("key", F.lit(False).alias("right"), F.col("id").alias("id_a"), F.lit(None).cast(ids[1]).alias("id_b"), "text", "set")
    b = b.select("key", F.lit(True).alias("right"), F.lit(None).cast(ids[0]).alias("id_a"), F.col("id").alias("id_b"), "text", "set")
    sets = stage(a.unionByName(b), "similar-sets")
    share = least / (2 - least)  # of a set that a partner of any length must have
    n = F.size("set")
    prefix = F.slice("set", F.lit(1), n - F.ceil(n * share - 1e-9).cast("int") + 1)
    begun = sets.withColumn("token", F.explode(prefix))
    counts = begun.groupBy("key", "token").agg(F.count_if(~F.col("right")).alias("n_a"), F.count_if("right").alias("n_b")).where("n_a > 0 and n_b > 0")
    counts = stage(counts.withColumn("cell", F.monotonically_increasing_id()), "similar-cells")
    most = counts.agg(F.sum(F.col("n_a").cast("double") * F.col("n_b"))).first()[0] or 0
    tasks = max(sets.sparkSession.sparkContext.defaultParallelism, min(10_000, int(most // _TASK)))
    # a row is in one piece of its side, and meets all pieces of the other
    pieces_a, pieces_b = (F.ceil(F.col(x) / _PIECE).cast("int") for x in ("n_a", "n_b"))
    own = F.pmod(F.xxhash64("id_a", "id_b", "text"), F.when(F.col("right"), pieces_b).otherwise(pieces_a)).cast("int")
    met = begun.join(counts, ["key", "token"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("right"), pieces_a).otherwise(pieces_b) - 1)))
    at = [F.when(F.col("right") == of, F.col("own")).otherwise(F.col("other")).alias(name) for name, of in (("at_a", False), ("at_b", True))]
    met = met.select("key", "cell", *at, "token", "right", "id_a", "id_b", "text", "set")
    return met.repartition(tasks, "cell", "at_a", "at_b").sortWithinPartitions("cell", "at_a", "at_b", "right")


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The sorted rows of each (cell, at_a, at_b)."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("cell", "at_a", "at_b")])
        cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), len(batch)]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            if hi == lo:
                continue
            if held and (key := tuple(keys[:, lo])) != last:
                yield pa.Table.from_batches(held)
                held = []
            last = tuple(keys[:, lo])
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _alike(cell: pa.Table, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (of the left side, of the right side) of the pairs that have enough in common and no token before this one:
    a pair counts where its first common token stands, so it comes once."""
    sets = cell.column("set").combine_chunks()
    n = np.diff(sets.offsets.to_numpy())
    ranks, columns = np.unique(sets.flatten().to_numpy(), return_inverse=True)
    has = np.zeros((len(n), len(ranks)), np.float32)
    has[np.repeat(np.arange(len(n)), n), columns] = 1
    first = int(np.searchsorted(ranks, cell.column("token")[0].as_py()))  # columns stand in the order of ranks
    m = int((~cell.column("right").to_numpy()).sum())
    a, b, n_a, n_b = has[:m], has[m:], n[:m, None], n[None, m:]
    for lo in range(0, m, step := max(1, _STRIP // max(1, len(n) - m))):
        x, own = a[lo : lo + step], n_a[lo : lo + step]
        keep = x @ b.T >= least / 2 * (own + n_b) - 1e-9
        keep &= np.minimum(own, n_b) >= least / (2 - least) * np.maximum(own, n_b) - 1e-9
        if first:
            keep &= x[:, :first] @ b[:, :first].T == 0
        i, j = np.nonzero(keep)
        if len(i):
            yield i + lo, j


def _pairs(left: DataFrame, right: DataFrame, least: float, scored: bool) -> DataFrame:
    """The pairs that have enough in common with their texts, or of these the ones that are like each other with their
    likeness."""
    met = _meetings(left, right, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches):
            m = int((~cell.column("right").to_numpy()).sum())
            names = ("key", "id_a", "id_b", "text")
            left, right = ({c: x.column(c).combine_chunks() for c in names} for x in (cell.slice(0, m), cell.slice(m)))
            texts = [x["text"].to_pylist() for x in (left, right)]
            for i, j in _alike(cell, least):
                if scored:
                    likeness = ratios(*texts, i, j)
                    keep = likeness >= least
                    i, j, likeness = i[keep], j[keep], likeness[keep]
                at_a, at_b = pa.array(i), pa.array(j)
                more = {"likeness": pa.array(likeness)} if scored else {"a": left["text"].take(at_a), "b": right["text"].take(at_b)}
                yield pa.RecordBatch.from_pydict({"key": left["key"].take(at_a), "id_a": left["id_a"].take(at_a), "id_b": right["id_b"].take(at_b)} | more)

    kinds = dict(met.dtypes)
    more = "likeness double" if scored else "a string, b string"
    return met.mapInArrow(run, f"key {kinds['key']}, id_a {kinds['id_a']}, id_b {kinds['id_b']}, {more}")


def candidates(left: DataFrame, right: DataFrame, least: float = 0.6) -> DataFrame:
    """(key, id_a, a, id_b, b): pairs of a key that have enough in common to be like each other at all. ``left`` and
    ``right``: key, id (each once a key), text; null and empty texts are like nothing."""
    return _pairs(left, right, least, False).select("key", "id_a", "a", "id_b", "b")


def similar(left: DataFrame, right: DataFrame, least: float = 0.6) -> DataFrame:
    """(key, id_a, id_b, likeness) of all pairs of a key with a ``ratio`` of ``least`` or more."""
    return _pairs(left, right, least, True)
