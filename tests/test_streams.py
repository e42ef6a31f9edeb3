"""Streams with keyed state against their batch forms; a timer that fires without an event."""

import time

import pytest
from pyspark.sql import functions as F

from seglume.streaming import events

KIND = "task string, at_ms long, event_id long, status string"


def fed(spark, rows, kind, folder, parts):
    for part in range(parts):
        spark.createDataFrame(rows[part::parts], kind).coalesce(1).write.mode("append").parquet(f"file://{folder}/in")
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}/in")


def run(stream, name, folder, until, seconds=150):
    q = stream.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", f"file://{folder}/cp-{name}").start()
    end = time.time() + seconds
    while time.time() < end and q.isActive and not until(q):
        time.sleep(0.5)
    q.stop()
    if q.exception():
        raise q.exception()


def test_a_gate_stream_equals_its_batch_form_and_opens_by_itself(spark, tmp_path):
    status = ["failed", "failed", "completed", "failed", "failed", "failed", "running", "failed"]
    rows = [(f"t{t}", 1000 * i + t, i, status[(i + t) % 8]) for i in range(20) for t in range(3)]
    rows.sort(key=lambda r: r[2])
    half = len(rows) // 2
    ordered = [r for pair in zip(rows[:half], rows[half:]) for r in pair]  # the first file holds the first half, the second the rest
    stream = events.cooldown_gate(fed(spark, ordered, KIND, tmp_path, 2), 2, 4000)
    opened = lambda q: spark.table("gates").where("opened").count() >= 2 and sum(p.numInputRows for p in q.recentProgress) >= len(rows)
    run(stream, "gates", tmp_path, opened)
    cols = ["task", "at_ms", "event_id", "failures", "until_ms", "blocked"]
    got = sorted(tuple(r) for r in spark.table("gates").where("not opened").select(*cols).collect())
    assert got == sorted(tuple(r) for r in events.gate(spark.createDataFrame(rows, KIND), 2, 4000).select(*cols).collect())
    assert any(r[-1] for r in got)
    last = {r.task: r for r in spark.table("gates").where("opened").collect()}
    assert last and all(r.until_ms == 0 and not r.blocked for r in last.values())


@pytest.mark.parametrize("keep", ["newest", "oldest"])
def test_a_lagging_subscriber_gets_a_hundred_and_the_count_of_the_rest(spark, tmp_path, keep):
    kind = "subscriber string, at long, event_id long, payload string, poll boolean"
    rows = [("slow", i, i, "x", i in (5, 400, 401)) for i in range(402)] + [("quick", i, i, "x", i % 10 == 9) for i in range(100)]
    rows.sort(key=lambda r: r[1])
    half = len(rows) // 2
    ordered = [r for pair in zip(rows[:half], rows[half:]) for r in pair]
    name = f"mail_{keep}"
    stream = events.mailboxes(fed(spark, ordered, kind, tmp_path, 2), 100, keep)
    run(stream, name, tmp_path, lambda q: sum(p.numInputRows for p in q.recentProgress) >= len(rows))
    got = sorted((r.subscriber, r.poll_id, r.event_ids, r.dropped) for r in spark.table(name).collect())
    want = events.deliveries(spark.createDataFrame(rows, kind), 100, keep).collect()
    assert got == sorted((r.subscriber, r.poll_id, r.event_ids, r.dropped) for r in want)
    slow = {g[1]: g for g in got if g[0] == "slow"}
    assert slow[400][3] == 294 and slow[400][2] == list(range(300, 400) if keep == "newest" else range(6, 106)) and slow[401][2:] == ([], 0)


def test_events_reach_each_subscriber_of_their_topic(spark):
    rows = spark.createDataFrame([("a", 1, 1, "x"), ("b", 2, 2, "y")], "topic string, at long, event_id long, payload string")
    who = spark.createDataFrame([("s", "a"), ("t", "a"), ("u", "c")], "subscriber string, topic string")
    assert sorted((r.subscriber, r.event_id) for r in events.subscriptions(rows, who).collect()) == [("s", 1), ("t", 1)]


def test_a_log_stream_keeps_the_order_of_a_batch_in_several_arrow_batches(spark, tmp_path):
    kind = "task string, at long, line_id long, line string"
    lines = [("t", 300 - i, i, f"l{300 - i}") for i in range(300)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        q = events.log_stream(fed(spark, lines, kind, tmp_path, 1)).writeStream.outputMode("update").format("memory").queryName("log7").option("checkpointLocation", f"file://{tmp_path}/cp").start()
        end = time.time() + 120
        while time.time() < end and sum(p.numInputRows for p in q.recentProgress) < len(lines):
            time.sleep(0.5)
        q.stop()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = [r.line for r in events.bounded_log(spark.createDataFrame(lines, kind)).orderBy(F.col("at")).collect()]
    assert spark.table("log7").first().lines == want


def test_a_batch_is_let_go_when_a_sink_fails(spark, tmp_path):
    kind = "task string, at long"
    stream = fed(spark, [("a", 1)], kind, tmp_path, 1)
    held = []

    def fails(batch):
        held.append(batch)
        raise ValueError("sink")

    q = events.fan_out(stream, [fails], f"file://{tmp_path}/cp").start()
    end = time.time() + 60
    while q.isActive and time.time() < end:
        time.sleep(0.2)
    assert "sink" in str(q.exception()) and not held[0].is_cached
