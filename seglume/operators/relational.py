"""Filters, paging, lookups and edits over tables of projects, segments and entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

ALL = "ALL"


# ---- filters and projections

def only(rows: DataFrame, column: str, value: str | None) -> DataFrame:
    """Rows with the value; the word ALL (or no value) keeps every row."""
    return rows if value in (None, "", ALL) else rows.where(F.col(column) == value)


def search(rows: DataFrame, columns: list[str], needle: str) -> DataFrame:
    """Rows with the needle in any of the columns, whatever the case; % and _ in it are wildcards."""
    return rows.where(reduce(Column.__or__, (F.col(c).ilike(f"%{needle}%") for c in columns)))


def contains(rows: DataFrame, columns: list[str], needle: str, facet: str | None = None, value: str = ALL) -> DataFrame:
    """Rows with the needle, taken literally, in any of the columns; and of one facet."""
    hit = reduce(Column.__or__, (F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(needle.lower())) for c in columns))
    found = rows.where(hit)
    return only(found, facet, value) if facet else found


def first_text(*columns: str) -> Column:
    """The first text that is neither null nor empty, else the empty text."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns], F.lit(""))


def iso_or_empty(column: str) -> Column:
    return F.coalesce(F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))


def end_or_default(start: str, end: str, default_ms: int = 1000) -> Column:
    """The end, or a second after the start where there is none after it."""
    return F.when(F.col(end).isNull() | (F.col(end) <= F.col(start)), F.col(start) + default_ms).otherwise(F.col(end))


def facets(rows: DataFrame, **tests: Column) -> DataFrame:
    """One row: how many rows each test holds for, and all of them."""
    return rows.agg(*[F.count_if(t).alias(k) for k, t in tests.items()], F.count("*").alias("every"))


def page(rows: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of the rows, with the number of all rows and pages (one at least) on each row.

    The count is one aggregate beside the page, so the page itself is a top-k and not a sort of all rows.
    """
    n = rows.agg(F.count("*").alias("total")).withColumn("pages", F.greatest(F.lit(1), F.expr(f"(total + {size - 1}) div {size}")))
    return rows.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(n))  # one row


def batch_of_page(rows: DataFrame, batch: int, size: int) -> DataFrame:
    return rows.where(F.col("seq").between(batch * size + 1, (batch + 1) * size))


# ---- lookups

def with_counts(projects: DataFrame, segs: DataFrame, done: Column, key: str = "project") -> DataFrame:
    """Total and done segments of each project; zero where it has none."""
    n = segs.groupBy(key).agg(F.count("*").alias("total"), F.count_if(done).alias("done"))
    return projects.join(n, key, "left").withColumn("total", F.coalesce("total", F.lit(0))).withColumn("done", F.coalesce("done", F.lit(0)))


def lookup_chain(keys: DataFrame, key: str, *tables: tuple[DataFrame, str, str]) -> DataFrame:
    """Adds ``found``: the value of the first table (rows, key, value) that has the key with a text."""
    out, names = keys, []
    for i, (rows, k, v) in enumerate(tables):
        # of several values of a key the smallest counts
        one = rows.where(F.col(v).isNotNull()).groupBy(F.col(k).alias(f"_k{i}")).agg(F.min(v).alias(f"_v{i}"))
        out = out.join(one, F.col(key) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
        names.append(f"_v{i}")
    return out.withColumn("found", F.coalesce(*names)).drop(*names)


def scoped(rows: DataFrame, scope: str, value) -> DataFrame:
    """Rows of the scope and rows of none."""
    return rows.where((F.col(scope) == value) | F.col(scope).isNull())


def zip_rows(left: DataFrame, right: DataFrame, order: str = "seq", key: str = "project") -> DataFrame:
    """Pairs rows by their places; what one side has more is left out."""
    number = F.row_number().over(W.partitionBy(key).orderBy(order))
    return left.withColumn("place", number).join(right.withColumn("place", number).withColumnRenamed(order, f"right_{order}"), [key, "place"])


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, right_at: str) -> DataFrame:
    """Adds ``value`` of the latest row of ``right`` at or before ``at``, or null: one union and one window by key."""
    one = left.select(F.struct(*left.columns).alias("_row"), F.col(key).alias("_k"), F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"))
    two = right.select(F.lit(None).cast(one.schema["_row"].dataType).alias("_row"), F.col(key).alias("_k"), F.col(right_at).alias("_at"), F.lit(0).alias("_side"), F.col(value).alias("_v"))
    w = W.partitionBy("_k").orderBy("_at", "_side", "_v").rowsBetween(W.unboundedPreceding, 0)
    return one.unionByName(two).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1").select("_row.*", F.col("_v").alias(value))


def pick(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """The row of each key that comes first by the order given (ascending, nulls first).

    An aggregate, not a window: a key with most of all rows is reduced before the shuffle.
    """
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_best"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_best.{c}") for c in rows.columns])


def best_two(rows: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """Best and second score of each key, and the margin between them (null with one candidate)."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(score).desc(), tie))
    top = rows.withColumn("_place", place).where("_place <= 2")
    best, second = (F.max(F.when(F.col("_place") == i, F.col(score))) for i in (1, 2))
    return top.groupBy(*keys).agg(best.alias("best"), second.alias("second"), (best - second).alias("margin"))


# ---- edits

def clear_translations(segs: DataFrame, where: Column) -> DataFrame:
    """Sets the text to null and the state to RAW where the test holds."""
    return segs.withColumn("translated_text", F.when(where, None).otherwise(F.col("translated_text"))).withColumn("status", F.when(where, F.lit("RAW")).otherwise(F.col("status")))


def status_after_reset(projects: DataFrame, segs: DataFrame, done: Column, key: str = "project") -> DataFrame:
    """TRANSLATED where a project has done segments, TRANSCRIBED where it has any, else DOWNLOADED."""
    n = with_counts(projects, segs, done, key)
    return n.withColumn("state", F.when(F.col("done") > 0, "TRANSLATED").when(F.col("total") > 0, "TRANSCRIBED").otherwise("DOWNLOADED"))


def drop_projects(tables: dict[str, DataFrame], gone: DataFrame, key: str = "project") -> dict[str, DataFrame]:
    """Each table without the rows of these projects, by equal keys."""
    return {name: rows.join(gone.select(key), key, "left_anti") for name, rows in tables.items()}


def drop_from_batch(segs: DataFrame, stages: list[str], batch: int, size: int) -> DataFrame:
    """What stays when derived stages go from a batch on."""
    return segs.where(~(F.col("stage").isin(*stages) & (F.expr(f"(seq - 1) div {size}") >= batch)))


def continue_numbers(old: DataFrame, new: DataFrame, key: str = "project") -> DataFrame:
    """Numbers new rows after the largest old number of their project."""
    top = old.groupBy(key).agg(F.max("seq").alias("_top"))
    number = F.row_number().over(W.partitionBy(key).orderBy("seq"))
    return new.withColumn("_n", number).join(top, key, "left").withColumn("seq", F.coalesce("_top", F.lit(0)) + F.col("_n")).drop("_n", "_top")


def replace_texts(rows: DataFrame, column: str, rules: list[tuple[str, str]]) -> DataFrame:
    """Literal replacements whatever the case, one rule after another: adds new_text and changed."""
    out = F.col(column)
    for old, new in rules:
        out = F.regexp_replace(out, F.lit("(?iu)\\Q" + old.replace("\\E", "\\E\\\\E\\Q") + "\\E"), F.lit(new.replace("\\", "\\\\").replace("$", "\\$")))
    return rows.withColumn("new_text", out).withColumn("changed", F.coalesce(F.col("new_text") != F.col(column), F.lit(False)))


# ---- entities

def clean_entities(raw: DataFrame, locked: DataFrame | None = None) -> DataFrame:
    """Trimmed names without blanks, the first row of each name; a locked value takes the place of the found one."""
    rows = raw.withColumn("raw", F.trim("raw")).withColumn("viet", F.trim("viet")).where("raw <> ''")
    rows = pick(rows, ["raw"], "batch", "pos")
    if locked is None:
        return rows
    held = locked.select(F.trim("raw").alias("raw"), F.col("viet").alias("_held")).dropDuplicates(["raw"])
    return rows.join(held, "raw", "left").withColumn("viet", F.coalesce("_held", "viet")).drop("_held")


def accumulate(entities: DataFrame, fill: list[str]) -> DataFrame:
    """Over batches in order: of each name the first value that is given, and for other fields the first that is neither
    empty nor a dash."""
    order = F.struct("batch", "pos")
    first = lambda c, test: F.min_by(F.when(test, F.col(c)), F.when(test, order)).alias(c)
    kept = [first(c, F.col(c).isNotNull() & ~F.trim(c).isin("", "-")) for c in fill]
    return entities.groupBy("raw").agg(first("viet", F.col("viet").isNotNull() & (F.col("viet") != "")), *kept)


def union_with_priority(*tables: DataFrame, keys: list[str]) -> DataFrame:
    """All rows, and of equal keys the one of the earlier table."""
    rows = reduce(DataFrame.unionByName, (x.withColumn("_rank", F.lit(i)) for i, x in enumerate(tables)))
    every = [c for c in rows.columns if c not in ("_rank", *keys)]
    return pick(rows, keys, "_rank", *every).drop("_rank")


def clean_fixes(fixes: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """Replacements of two characters or more that change something, the first of each, longest first."""
    rows = fixes.withColumn(old, F.trim(old)).withColumn(new, F.trim(new)).where((F.length(old) >= 2) & (F.col(old) != F.col(new)))
    return pick(rows, [old], "pos").orderBy(F.length(old).desc(), old)
