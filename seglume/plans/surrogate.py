"""The test tables read as the segment model: the same expressions, once for Spark and once as SQL text.

``timed``: events per user on a millisecond axis; ``work``: line items as translation units of a supplier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from seglume.session import table

#: Raw gaps between events are hours; this divisor brings them to the scale of speech.
US_PER_MS = 20_000_000

TIMED_SQL = f"""timed AS (
  SELECT user_id AS project, event_id AS seg_id, event_type AS speaker, start_ms,
         start_ms + 50 + CAST(floor(value * 20) AS BIGINT) AS end_ms,
         row_number() OVER (PARTITION BY user_id ORDER BY start_ms, event_id) AS seq
  FROM (SELECT *, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) // {US_PER_MS} AS start_ms FROM events))"""

WORK_SQL = """work AS (
  SELECT l_suppkey AS project, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus) AS seq,
         CASE l_returnflag WHEN 'A' THEN 'TRANSLATED' WHEN 'R' THEN 'RAW' ELSE 'MERGED_CHILD' END AS status,
         CASE WHEN l_linestatus = 'F' THEN '' WHEN l_quantity < 10 THEN NULL ELSE l_linestatus END AS translated_text,
         l_extendedprice AS price
  FROM lineitem)"""

TALK_SQL = """talk AS (
  SELECT conv_id AS project, turn + 1 AS seq, role AS speaker, text,
         300 * len(list_filter(string_split_regex(text, '[ \\n]+'), lambda x: x <> '')) AS dur_ms
  FROM conversations)"""


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project, seg_id, speaker, start_ms, end_ms, seq (from 1 by start, then id)."""
    w = W.partitionBy("user_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return (
        table(spark, sf_dir, "events")
        .select("user_id", "event_id", "event_type", "value", us.alias("us"))
        .withColumn("start_ms", F.expr(f"(us - min(us) over (partition by user_id)) div {US_PER_MS}"))
        .select(
            F.col("user_id").alias("project"),
            F.col("event_id").alias("seg_id"),
            F.col("event_type").alias("speaker"),
            "start_ms",
            (F.col("start_ms") + 50 + F.floor(F.col("value") * 20)).alias("end_ms"),
            F.row_number().over(w.orderBy("start_ms", "event_id")).cast("long").alias("seq"),
        )
    )


def work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project, seq, status, translated_text, price."""
    flag, line = F.col("l_returnflag"), F.col("l_linestatus")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("project"),
        F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")).cast("long").alias("seq"),
        F.when(flag == "A", "TRANSLATED").when(flag == "R", "RAW").otherwise("MERGED_CHILD").alias("status"),
        F.when(line == "F", "").when(F.col("l_quantity") < 10, F.lit(None)).otherwise(line).alias("translated_text"),
        F.col("l_extendedprice").alias("price"),
    )


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project, seq, speaker, text, dur_ms (300 ms a word)."""
    words = F.filter(F.split("text", "[ \\n]+"), lambda x: x != "")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("project"),
        (F.col("turn") + 1).alias("seq"),
        F.col("role").alias("speaker"),
        "text",
        (F.size(words) * 300).cast("long").alias("dur_ms"),
    )
