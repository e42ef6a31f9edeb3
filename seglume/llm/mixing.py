"""Mixing sources to target weights by Sainte-Lague apportionment (DataFrame operations only).

1. Sources get target sizes: a share of ``epochs`` times all words by weight, at most ``max_repeats`` times what a
   source has; the excess goes to the others by weight (the water level has a closed form over sources in the order
   of size by weight).
2. The mix is cut into blocks of ``block_words`` words. Sainte-Lague seats (the highest quotients votes / (2q + 1))
   give each source an integer number of blocks, then each shard of a source an integer part of these. What a shard cannot
   hold (``max_repeats`` times its words) is dealt again to the source's other shards, in words.
3. In a shard, documents lie end to end in an order drawn from ``seed``; the quota takes blocks from its front, and
   goes around again for repeats.

A shard is drawn from the document's id and text, so that a source or a null id with a third of all rows falls into as
many windows as the table needs. No step sees more than the numbers of a source, of its shards, or of a shard's documents.

Nulls: a null text or one without words has size 0 and is never taken; a null source is a source of its own, last in
order; a null id orders as the empty string. Repeated rows are separate documents. An empty table gives no rows. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from seglume.storage import stage

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixParams:
    weights: tuple[int, ...] = (5, 2, 1)
    epochs: float = 1.5
    max_repeats: int = 2
    block_words: int = 32
    rows_per_shard: int = 2000
    seed: str = "mix-1"


def source_key(source: str) -> Column:
    """A key that is never null: equality joins then keep the null source."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def source_targets(sizes: DataFrame, p: MixParams = MixParams()) -> DataFrame:
    """From (source, key, size): key, source_size, target, total_words, sources. One row a source."""
    per = sizes.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").cast("long").alias("source_size"))
    every = W.partitionBy(F.lit(1))
    rank = F.row_number().over(every.orderBy(F.col("source").asc_nulls_last()))
    weights = F.array(*[F.lit(w) for w in p.weights])
    per = per.select(
        "key",
        "source_size",
        F.element_at(weights, (rank - 1) % len(p.weights) + 1).cast("long").alias("weight"),
        F.sum("source_size").over(every).alias("total_words"),
        F.count("*").over(every).alias("sources"),
        rank.alias("rank"),
    ).withColumn("ratio", F.col("source_size") * p.max_repeats / F.col("weight"))
    before = every.orderBy("ratio", "rank").rowsBetween(W.unboundedPreceding, -1)
    level = (F.col("total_words") * p.epochs - F.coalesce(F.sum(F.col("source_size") * p.max_repeats).over(before), F.lit(0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    per = per.withColumn("level", level).withColumn("level", F.max("level").over(every))
    cap = (F.col("source_size") * p.max_repeats).cast("double")
    return per.select("key", "source_size", F.least(cap, F.col("weight") * F.col("level")).alias("target"), "total_words", "sources")


def sainte_lague(cells: DataFrame, group: str, cell: str) -> DataFrame:
    """Adds ``seats``: ``group_seats`` seats dealt to the cells of each group by the highest quotients votes / (2q + 1).

    Wants columns group, cell, votes, group_votes (their sum), group_seats and group_cells (their number). The seats
    at a divisor d are round(votes / d); two divisors on either side of the right one leave at most three quotients
    a cell on average to be ranked. Equal quotients go to the lower cell.
    """
    share, n = F.col("votes") / F.col("group_votes"), F.col("group_cells")
    safe = F.coalesce(share, F.lit(0.0))
    low = F.floor(F.greatest(F.lit(0.0), safe * (F.col("group_seats") - n / 2)) + F.lit(0.5))
    low = F.when(F.col("group_seats") > n / 2, low).otherwise(F.lit(0)).cast("long")
    high = (F.floor(safe * (F.col("group_seats") + n / 2) + F.lit(0.5)) + 1).cast("long")
    held = cells.withColumn("low", low).withColumn("high", F.when(F.col("votes") > 0, F.greatest(high, F.col("low"))).otherwise(F.col("low")))
    held = held.withColumn("open", F.col("group_seats") - F.sum("low").over(W.partitionBy(group)))
    bids = held.where("high > low").select(group, cell, "open", "votes", F.explode(F.sequence(F.col("low"), F.col("high") - 1)).alias("q"))
    order = W.partitionBy(group).orderBy((F.col("votes") / (2 * F.col("q") + 1)).desc(), cell)
    won = bids.withColumn("place", F.row_number().over(order)).where("place <= open").groupBy(group, cell).agg(F.count("*").alias("won"))
    return held.join(won, [group, cell], "left").withColumn("seats", F.col("low") + F.coalesce("won", F.lit(0)))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        source_key(source_col).alias("key"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("mark"),
        *more,
    )


def _drawn(sizes: DataFrame, n_shards: int, p: MixParams) -> DataFrame:
    draw = F.md5(F.concat_ws(":", F.lit(p.seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "mark"))
    return sizes.withColumn("draw", draw).withColumn("shard", F.conv(F.substring("draw", 1, 8), 16, 10).cast("long") % n_shards)


def quotas(sizes: DataFrame, p: MixParams) -> DataFrame:
    """key, shard, cell_size, source_size, target, source_blocks, quota (words); one row a shard of a source."""
    targets = source_targets(sizes, p)
    seats = sainte_lague(
        targets.select(
            F.lit(1).alias("all"),
            "key",
            F.col("target").alias("votes"),
            (F.col("total_words") * p.epochs).alias("group_votes"),
            F.floor(F.col("total_words") * p.epochs / p.block_words).alias("group_seats"),
            F.col("sources").alias("group_cells"),
            "source_size",
        ),
        "all",
        "key",
    ).select("key", "source_size", F.col("votes").alias("target"), F.col("seats").alias("source_blocks"))
    seats = stage(seats, "mix-sources")

    cells = sizes.groupBy("key", "shard").agg(F.sum("size").alias("cell_size")).join(seats, "key")
    cells = cells.select(
        "key",
        "shard",
        "cell_size",
        F.col("cell_size").cast("double").alias("votes"),
        F.col("source_size").cast("double").alias("group_votes"),
        F.col("source_blocks").alias("group_seats"),
        F.count("*").over(W.partitionBy("key")).alias("group_cells"),
        "source_size",
        "target",
    )
    cap = F.col("cell_size") * p.max_repeats
    own = F.least(F.col("seats") * p.block_words, cap)
    cells = sainte_lague(cells, "key", "shard").select(
        "key", "shard", "cell_size", "source_size", "target", F.col("group_seats").alias("source_blocks"),
        own.alias("own"), (F.col("seats") * p.block_words - own).alias("over"), (cap - own).alias("room"),
    )
    # words of seats above a cell's cap go to the source's other cells, each as much of them as it has of the room
    source = W.partitionBy("key")
    wide = lambda c: c.cast("decimal(19,0)")
    cells = cells.withColumn("all_room", wide(F.sum("room").over(source))).withColumn("again", F.least(wide(F.sum("over").over(source)), F.col("all_room")))
    cells = cells.withColumn("upto", wide(F.sum("room").over(source.orderBy("shard").rowsBetween(W.unboundedPreceding, 0))))
    dealt = F.expr("coalesce(again * upto div nullif(all_room, 0) - again * (upto - cast(room as decimal(19,0))) div nullif(all_room, 0), 0)")
    return stage(cells.select("key", "shard", "cell_size", "source_size", "target", "source_blocks", (F.col("own") + dealt).alias("quota")), "mix-cells")


def _takes(rows: DataFrame, cells: DataFrame, p: MixParams) -> tuple[DataFrame, list[Column]]:
    """Rows with their shard's quota and place, and how many words each turn around the shard takes of a row."""
    before = W.partitionBy("key", "shard").orderBy("draw", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    laid = rows.withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0))).join(cells, ["key", "shard"])
    left = lambda turn: F.col("quota") - F.col("cell_size") * turn - F.col("at")
    return laid, [F.greatest(F.lit(0), F.least(F.col("size"), left(turn))).cast("long") for turn in range(p.max_repeats)]


def _prepared(docs: DataFrame, id_col: str, text_col: str, source_col: str, p: MixParams) -> tuple[DataFrame, DataFrame, int]:
    sizes = stage(_sized(docs, id_col, text_col, source_col), "mix-sizes")
    n_shards = max(1, -(-sizes.count() // p.rows_per_shard))
    sizes = _drawn(sizes, n_shards, p)
    return sizes, quotas(sizes, p), n_shards


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", params: MixParams = MixParams()) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the document's shard and source_blocks; one row a document."""
    sizes, cells, _ = _prepared(docs, id_col, text_col, source_col, params)
    laid, takes = _takes(sizes, cells, params)
    return laid.select("doc_id", "size", "source_size", "target", sum(takes[1:], takes[0]).alias("taken"), "shard", F.col("source_blocks").cast("long").alias("source_blocks"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars", params: MixParams = MixParams()) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each turn that takes words of a document. Where a quota
    ends within a document, its row has the text's first words only (and ``chars_col``, if there, their length)."""
    _, cells, n_shards = _prepared(docs, id_col, text_col, source_col, params)
    rows = _drawn(_sized(docs, id_col, text_col, source_col, F.struct(*docs.columns).alias("row")), n_shards, params)
    laid, takes = _takes(rows, cells, params)
    out = laid.select("row", "size", F.explode(F.filter(F.array(*takes), lambda x: x > 0)).alias("take"))
    words = F.filter(F.split(F.col(f"row.{text_col}"), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    text = F.when(F.col("take") < F.col("size"), F.array_join(F.slice(words, F.lit(1), F.col("take").cast("int")), " ")).otherwise(F.col(f"row.{text_col}"))
    out = out.select("row", text.alias("text"), "take", "size")
    chars = F.when(F.col("take") < F.col("size"), F.char_length("text")).otherwise(F.col(f"row.{chars_col}")) if chars_col in docs.columns else None
    own = {text_col: F.col("text")} | ({chars_col: chars.cast(dict(docs.dtypes)[chars_col])} if chars is not None else {})
    return out.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


_SL = """{n}_l AS (SELECT *, CASE WHEN group_seats > group_cells / 2 THEN CAST(floor(greatest(0.0, coalesce(votes / nullif(group_votes, 0), 0.0) * (group_seats - group_cells / 2)) + 0.5) AS BIGINT) ELSE 0 END AS low,
     CAST(floor(coalesce(votes / nullif(group_votes, 0), 0.0) * (group_seats + group_cells / 2) + 0.5) + 1 AS BIGINT) AS high0 FROM {n}),
{n}_h AS (SELECT *, CASE WHEN votes > 0 THEN greatest(high0, low) ELSE low END AS high, group_seats - sum(low) OVER (PARTITION BY {g}) AS open FROM {n}_l),
{n}_b AS (SELECT {g}, {c}, open, votes, unnest(range(low, high)) AS q FROM {n}_h),
{n}_w AS (SELECT {g}, {c}, count(*) AS won FROM (SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY votes / (2 * q + 1) DESC, {c}) AS place FROM {n}_b) WHERE place <= open GROUP BY ALL),
{n}_s AS (SELECT h.*, low + coalesce(won, 0) AS seats FROM {n}_h h LEFT JOIN {n}_w w ON h.{g} = w.{g} AND h.{c} = w.{c})"""


def mix_sql(params: MixParams = MixParams()) -> str:
    """The same in DuckDB SQL over the view ``documents``."""
    p = params
    return f"""WITH n AS (SELECT greatest(1, (count(*) + {p.rows_per_shard - 1}) // {p.rows_per_shard}) AS shards FROM documents),
z AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS key, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
     md5('{p.seed}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS draw FROM documents),
sizes AS (SELECT z.*, CAST('0x' || draw[1:8] AS BIGINT) % shards AS shard FROM z, n),
s1 AS (SELECT key, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN {p.weights[0]} WHEN 1 THEN {p.weights[1]} ELSE {p.weights[2]} END AS weight,
     row_number() OVER (ORDER BY source NULLS LAST) AS rank, CAST(sum(source_size) OVER () AS BIGINT) AS total_words, count(*) OVER () AS sources
     FROM (SELECT key, min(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY key)),
s2 AS (SELECT *, (total_words * CAST({p.epochs} AS DOUBLE) - coalesce(sum(source_size * {p.max_repeats}) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
     FROM s1 WINDOW b AS (ORDER BY source_size * {p.max_repeats} / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
src AS (SELECT key, source_size, 1 AS one, least(CAST(source_size * {p.max_repeats} AS DOUBLE), weight * max(level) OVER ()) AS votes, total_words * CAST({p.epochs} AS DOUBLE) AS group_votes,
     CAST(floor(total_words * CAST({p.epochs} AS DOUBLE) / {p.block_words}) AS BIGINT) AS group_seats, sources AS group_cells FROM s2),
{_SL.format(n="src", g="one", c="key")},
cell0 AS (SELECT key, shard, CAST(sum(size) AS BIGINT) AS cell_size FROM sizes GROUP BY ALL),
cell AS (SELECT c.key, shard, cell_size, CAST(cell_size AS DOUBLE) AS votes, CAST(source_size AS DOUBLE) AS group_votes, seats AS group_seats, count(*) OVER (PARTITION BY c.key) AS group_cells,
     source_size, s.votes AS target FROM cell0 c JOIN src_s s ON c.key = s.key),
{_SL.format(n="cell", g="key", c="shard")},
own AS (SELECT *, CAST(least(seats * {p.block_words}, cell_size * {p.max_repeats}) AS HUGEINT) AS own FROM cell_s),
room AS (SELECT *, seats * {p.block_words} - own AS over_, cell_size * {p.max_repeats} - own AS room FROM own),
again AS (SELECT *, CAST(sum(room) OVER (PARTITION BY key) AS HUGEINT) AS all_room, least(CAST(sum(over_) OVER (PARTITION BY key) AS HUGEINT), CAST(sum(room) OVER (PARTITION BY key) AS HUGEINT)) AS again,
     CAST(sum(room) OVER (PARTITION BY key ORDER BY shard) AS HUGEINT) AS upto FROM room),
q AS (SELECT key, shard, cell_size, source_size, target, group_seats, CAST(own + coalesce(again * upto // nullif(all_room, 0) - again * (upto - room) // nullif(all_room, 0), 0) AS BIGINT) AS quota FROM again),
laid AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY key, shard ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM sizes)
SELECT doc_id, size, source_size, target, CAST(greatest(0, least(size, quota - pos)) + greatest(0, least(size, quota - cell_size - pos)) AS BIGINT) AS taken,
     l.shard AS shard, CAST(group_seats AS BIGINT) AS source_blocks FROM laid l JOIN q ON l.key = q.key AND l.shard = q.shard"""
