"""Sharding along a Hilbert curve (DataFrame operations only).

Source, language and text size are quantised at the quantiles of the table, the cell's index on a Hilbert curve orders
the documents, and the order is cut into shards whose row counts differ by at most one (law ``rows``). Neighbours on
the curve have near values in every dimension, so a shard's min and max prune files for filters on any of them.

The global position is exact without one global sort: a cell of the curve gets a salt for every
``rows_per_salt`` of its rows, counts of (cell, salt) are summed along the curve, and rows are numbered within
(cell, salt) only. A cell that holds a third of all rows so spreads over many tasks.

Source and language count by the place of their value among all distinct values in order, so one odd value changes
nothing for the others.

Nulls: a null text has 8 bytes of size and the checksum of no bytes; null source, language or id order first.
Repeated rows get positions of their own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from seglume.llm.ranks import numbered
from seglume.storage import stage


@dataclass(frozen=True)
class ShardParams:
    shards: int = 24
    bits: int = 4
    rows_per_salt: int = 4000


DIMENSIONS = 3


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """Position of a grid point on the Hilbert curve: undo the turns from the highest bit down, then Gray-decode."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    return int("".join(str(v >> b & 1) for b in range(bits - 1, -1, -1) for v in x), 2)


def curve_table(spark: SparkSession, bits: int) -> DataFrame:
    """(cell, h) for each of the 2 ** (3 * bits) grid cells: a table whose size no data changes."""
    side = 1 << bits
    rows = (f"({(a * side + b) * side + c},{hilbert_index((a, b, c), bits)})" for a in range(side) for b in range(side) for c in range(side))
    return spark.sql(f"SELECT CAST(col1 AS INT) AS cell, CAST(col2 AS LONG) AS h FROM VALUES {','.join(rows)}")


def ranked(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the place of each value among the distinct ones in order, -1 for null."""
    values = rows.select(F.lit(0).alias("_all"), column).where(F.col(column).isNotNull()).distinct()
    places = numbered(values, "_all", [column], f"shard-{column}")[0].select(column, F.col("at").alias(name))
    return rows.join(places, column, "left").withColumn(name, F.coalesce(name, F.lit(-1)))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", params: ShardParams = ShardParams()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, h (curve index); one row a document."""
    return _placed(docs, id_col, text_col, source_col, lang_col, params).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "h"
    )


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, params: ShardParams, *more: Column) -> DataFrame:
    """doc_id, size, text_crc32, h, shard, slot and columns that are carried along."""
    p, spark = params, docs.sparkSession
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = stage(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            F.col(lang_col).cast("string").alias("lang"),
            (F.octet_length(body) + 8).cast("long").alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.monotonically_increasing_id().alias("_own"),
            *more,
        ),
        "shard-rows",
    )
    rows = ranked(ranked(rows, "source", "d0"), "lang", "d1").drop("source", "lang")
    side = 1 << p.bits
    cuts = [i / side for i in range(1, side)]
    marks = rows.agg(F.count("*").alias("n"), *[F.percentile_approx(c, cuts, 10_000).alias(c) for c in ("d0", "d1", "size")]).first()
    if not marks["n"]:
        marks = {"n": 1, "d0": [], "d1": [], "size": []}

    def band(c: str) -> Column:
        """How many distinct cuts lie below the value."""
        out = F.lit(0)
        for cut in sorted(set(marks[c])):
            out = out + (F.col(c) > cut).cast("int")
        return out

    cell = (band("d0") * side + band("d1")) * side + band("size")
    curve = stage(
        rows.groupBy(cell.alias("cell")).agg(F.count("*").alias("n")).join(F.broadcast(curve_table(spark, p.bits)), "cell").select("cell", "h", F.ceil(F.col("n") / p.rows_per_salt).cast("int").alias("salts")),
        "shard-curve",
    )  # at most one row a cell: a size that no data changes
    # equal rows are told apart, or they would share a salt
    salt = F.pmod(F.xxhash64("doc_id", "text_crc32", "_own"), F.col("salts")).cast("int")
    rows = rows.withColumn("cell", cell).join(F.broadcast(curve), "cell").withColumn("salt", salt).drop("cell", "d0", "d1", "salts", "_own")

    counts = stage(rows.groupBy("h", "salt").agg(F.count("*").alias("rows")), "shard-counts")
    cells = counts.groupBy("h").agg(F.sum("rows").alias("all"))  # at most one row a cell: the only window over them all
    cells = cells.select("h", (F.sum("all").over(W.orderBy("h")) - F.col("all")).alias("cell_start"))
    inner = F.sum("rows").over(W.partitionBy("h").orderBy("salt")) - F.col("rows")
    starts = counts.select("h", "salt", inner.alias("inner")).join(F.broadcast(cells), "h")
    starts = stage(starts.select("h", "salt", (F.col("cell_start") + F.col("inner")).alias("start")), "shard-starts")

    within = F.row_number().over(W.partitionBy("h", "salt").orderBy("doc_id", "size", "text_crc32")) - 1
    total = marks["n"]
    at = rows.withColumn("within", within).join(starts, ["h", "salt"]).withColumn("at", F.col("start") + F.col("within"))
    at = at.withColumn("shard", F.expr(f"at * {p.shards} div {total}").cast("int"))
    first = F.expr(f"(shard * {total}L + {p.shards - 1}) div {p.shards}")
    return at.withColumn("slot", F.col("at") - first).drop("within", "start", "at", "salt")


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", params: ShardParams = ShardParams()) -> None:
    """The documents themselves, one folder a shard and rows in curve order, for readers that prune by min and max. Each
    row goes where ``shard`` puts it, whatever ids are null or repeated."""
    placed = _placed(docs, id_col, text_col, source_col, lang_col, params, F.struct(*docs.columns).alias("_row"))
    rows = placed.select("_row.*", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
    rows.repartition(params.shards, "_shard").sortWithinPartitions("_shard", "_slot").drop("_slot").write.partitionBy("_shard").parquet(path)


def shard_sql(params: ShardParams = ShardParams()) -> str:
    """``shard`` over ``documents`` while no cell of the curve holds more than ``rows_per_salt`` rows."""
    p, side = params, 1 << params.bits
    curve = ", ".join(f"({(a * side + b) * side + c}, {hilbert_index((a, b, c), p.bits)})" for a in range(side) for b in range(side) for c in range(side))
    table = "SELECT list_transform(range(256), lambda x: list_reduce(list_prepend(x, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab"
    codes = "list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"
    cuts = ", ".join(f"{i / side!r}" for i in range(1, side))
    # a value's band: how many distinct cuts lie below it; a cut is the least value that enough rows do not exceed
    below = lambda c: f"len(list_filter(list_distinct(quantile_disc_{c}), lambda q: q < {c}))"
    place = lambda c: f"CASE WHEN {c} IS NULL THEN -1 ELSE dense_rank() OVER (ORDER BY {c} NULLS FIRST) - 1 - CAST((SELECT count(*) > 0 FROM documents WHERE {c} IS NULL) AS INT) END"
    return (
        f"WITH crc AS ({table}), curve(cell, h) AS (VALUES {curve}), "
        f"rows_ AS (SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, {crc} AS text_crc32, {place('source')} AS d0, {place('lang')} AS d1 FROM documents, crc), "
        f"marks AS (SELECT count(*) AS total, {', '.join(f'quantile_disc({c}, [{cuts}]) AS quantile_disc_{c}' for c in ('d0', 'd1', 'size'))} FROM rows_), "
        f"cells AS (SELECT doc_id, size, text_crc32, total, ({below('d0')} * {side} + {below('d1')}) * {side} + {below('size')} AS cell FROM rows_, marks), "
        "placed AS (SELECT doc_id, size, text_crc32, total, h, row_number() OVER (ORDER BY h, doc_id NULLS FIRST, size, text_crc32) - 1 AS pos FROM cells JOIN curve USING (cell)), "
        f"sharded AS (SELECT *, CAST(pos * {p.shards} // total AS INT) AS shard FROM placed) "
        f"SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, shard, pos - (CAST(shard AS BIGINT) * total + {p.shards - 1}) // {p.shards} AS slot, CAST(NULL AS INT) AS grown_shard, CAST(h AS BIGINT) AS h FROM sharded"
    )
