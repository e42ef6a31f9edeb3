"""Progress of batches: predicates on status, grouped conditional sums, densified status, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from seglume.plans import surrogate as s

#: The states that count as translated, by predicate.
DONE = ("TRANSLATED", "DUBBED", "SILENT_VALID")
DONE_OR_MERGED = (*DONE, "MERGED_CHILD")


def translated_a(status: str = "status", text: str = "translated_text") -> Column:
    """Done by status, or a text that is neither null nor empty."""
    return F.coalesce(F.col(status).isin(*DONE), F.lit(False)) | (F.coalesce(F.col(text), F.lit("")) != "")


def translated_b(status: str = "status", text: str = "translated_text") -> Column:
    """As A, and merged children count."""
    return F.coalesce(F.col(status).isin(*DONE_OR_MERGED), F.lit(False)) | (F.coalesce(F.col(text), F.lit("")) != "")


def translated_c(status: str = "status", text: str = "translated_text") -> Column:
    """Done by status, or a text that is not null; an empty text counts."""
    return F.coalesce(F.col(status).isin(*DONE), F.lit(False)) | F.col(text).isNotNull()


def translated_d(status: str = "status", text: str = "translated_text") -> Column:
    """A text that is not blank, or one of the four states."""
    return (F.trim(F.coalesce(F.col(text), F.lit(""))) != "") | F.coalesce(F.col(status).isin(*DONE_OR_MERGED), F.lit(False))


def batch_progress(segs: DataFrame, size: int) -> DataFrame:
    """Rows and translated rows of each batch of ``size`` consecutive sequence numbers."""
    return segs.groupBy("project", F.expr(f"(seq - 1) div {size}").alias("batch")).agg(
        F.count("*").alias("total"), F.sum(translated_b().cast("long")).alias("done")
    )


def batch_status(segs: DataFrame, size: int) -> DataFrame:
    """One row for each batch from 0 to the last, also where it has no rows, with its state."""
    found = batch_progress(segs, size)
    spans = found.groupBy("project").agg(F.max("batch").alias("last"))
    every = spans.select("project", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("batch"))
    out = every.join(found, ["project", "batch"], "left")
    total, done = F.coalesce("total", F.lit(size)), F.coalesce("done", F.lit(0))
    state = F.when(done == 0, "PENDING").when(done >= total, "COMPLETED").otherwise("IN_PROGRESS")
    return out.select("project", "batch", total.cast("long").alias("total"), done.cast("long").alias("done"), state.alias("state"))


_B = "(coalesce(status IN ('TRANSLATED','DUBBED','SILENT_VALID','MERGED_CHILD'), false) OR coalesce(translated_text,'') <> '')"

QUERIES = {
    "a2_batch_progress": (
        lambda spark, d: batch_progress(s.work(spark, d), 50),
        f"""WITH {s.WORK_SQL} SELECT project, (seq-1)//50 AS batch, count(*) AS total, CAST(sum(CASE WHEN {_B} THEN 1 ELSE 0 END) AS BIGINT) AS done
        FROM work GROUP BY 1,2""",
    ),
    "a3_batch_status": (
        lambda spark, d: batch_status(s.work(spark, d), 50),
        f"""WITH {s.WORK_SQL}, f AS (SELECT project, (seq-1)//50 AS batch, count(*) AS total, sum(CASE WHEN {_B} THEN 1 ELSE 0 END) AS done
          FROM work GROUP BY 1,2),
        e AS (SELECT project, unnest(range(0, max(batch)+1)) AS batch FROM f GROUP BY project)
        SELECT e.project, e.batch, CAST(coalesce(total,50) AS BIGINT) AS total, CAST(coalesce(done,0) AS BIGINT) AS done,
          CASE WHEN coalesce(done,0)=0 THEN 'PENDING' WHEN coalesce(done,0)>=coalesce(total,50) THEN 'COMPLETED' ELSE 'IN_PROGRESS' END AS state
        FROM e LEFT JOIN f ON e.project=f.project AND e.batch=f.batch""",
    ),
}
