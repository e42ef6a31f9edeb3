"""Files read back, streams against their batch forms, time joins against brute force, results that no partitioning
changes."""

import random
import time

from pyspark.sql import functions as F

from seglume.operators import intervals, lineage, timeline
from seglume.plans import progress, surrogate
from seglume.sources import files
from seglume.streaming import events

D = "/root/testdata/sf0.001"


def test_subtitles_are_written_in_order_and_read_back(spark, tmp_path):
    segs = spark.createDataFrame([(1, 2, 1500, 2500, "b\nc"), (1, 1, 0, 1000, "a"), (2, 1, 61_000, 3_600_007, None)], "project long, seq long, start_ms long, end_ms long, text string")
    files.write_lines(segs, files.srt_text(), f"file://{tmp_path}/srt")
    back = files.srt_blocks(spark.read.text(f"file://{tmp_path}/srt", wholetext=True)).orderBy("project", "seq")
    assert [(r.project, r.seq, r.start_ms, r.end_ms, r.text) for r in back.collect()] == [(1, 1, 0, 1000, "a"), (1, 2, 1500, 2500, "b\nc"), (2, 1, 61_000, 3_600_007, "")]
    files.write_lines(segs.withColumn("speaker", F.lit("x,y")), files.ass_text(), f"file://{tmp_path}/ass", files.ASS_HEAD.format(width=1920, height=1080, size=60, margin=40))
    lines = spark.read.text(f"file://{tmp_path}/ass")
    assert lines.where("project = 1").first().value == "[Script Info]"
    assert [(r.start_ms, r.speaker, r.text) for r in files.ass_dialogues(lines).where("project = 1").orderBy("start_ms").collect()] == [(0, "x y", "a"), (1500, "x y", "b\\Nc")]


def test_stages_replace_only_themselves(spark, tmp_path):
    path = f"file://{tmp_path}/stages"
    files.write_stages(spark.createDataFrame([(1, "A"), (2, "B")], "seq long, stage string"), path)
    files.write_stages(spark.createDataFrame([(3, "B")], "seq long, stage string"), path)
    assert sorted((r.seq, r.stage) for r in spark.read.parquet(path).collect()) == [(1, "A"), (3, "B")]


def test_entities_of_odd_files(spark):
    rows = spark.createDataFrame([(1, "[]"), (2, "not json"), (3, None), (4, '{"terms": [{"raw": "x", "viet": "y"}]}'), (5, '[{"raw": "a"}]')], "id long, value string")
    assert [(r.id, r.raw, r.type) for r in files.entities(rows).orderBy("id").collect()] == [(4, "x", "OTHER"), (5, "a", "NAME")]


def test_byte_ranges(spark):
    got = spark.sql("SELECT * FROM VALUES ('bytes=0-9'), ('bytes=90-'), ('bytes=-5'), ('bytes=100-'), ('bytes=5-500') t(h)").select(files.byte_range(F.col("h"), F.lit(100)).alias("r")).collect()
    assert [r.r and tuple(r.r) for r in got] == [(0, 9), (90, 99), (95, 99), None, (5, 99)]


def test_log_stream_equals_its_batch_form(spark, tmp_path):
    kind = "task string, at long, line_id long, line string"
    lines = [(f"t{i % 2}", i, i, f"l{i}") for i in range(400)]
    for part in range(2):
        spark.createDataFrame(lines[part * 200 : part * 200 + 200], kind).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    q = events.log_stream(stream).writeStream.outputMode("update").format("memory").queryName("logs").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    end = time.time() + 120  # a stream with time-outs runs on without data, so it is stopped once all rows are in
    while sum(p.numInputRows for p in q.recentProgress) < len(lines) and time.time() < end:
        time.sleep(0.5)
    q.stop()
    got = {}
    for r in spark.table("logs").collect():
        got[r.task] = max(got.get(r.task, []), r.lines, key=lambda x: int(x[-1][1:]) if x else -1)
    want = events.bounded_log(spark.createDataFrame(lines, kind)).orderBy("at").collect()
    assert got == {t: [r.line for r in want if r.task == t] for t in ("t0", "t1")}


def test_survivors_equal_the_loop(spark):
    held, sizes = [], []
    for i in range(600):
        held.append(i)
        if len(held) > 150:
            del held[:30]
        sizes.append(len(held))
    got = spark.range(1, 601).select(events.survivors(F.col("id")).alias("n")).collect()
    assert [r.n for r in got] == sizes


def test_batches_without_rows_are_there(spark):
    kind = "project long, seq long, status string, translated_text string"
    rows = [(1, 1, "RAW", None), (1, 2, "RAW", "x"), (1, 7, "DUBBED", ""), (1, 8, "MERGED_CHILD", None), (2, 1, "RAW", " ")]
    got = sorted(tuple(r) for r in progress.batch_status(spark.createDataFrame(rows, kind), 2).collect())
    assert got == [(1, 0, 2, 1, "IN_PROGRESS"), (1, 1, 2, 0, "PENDING"), (1, 2, 2, 0, "PENDING"), (1, 3, 2, 2, "COMPLETED"), (2, 0, 1, 1, "COMPLETED")]


def test_interval_join_equals_all_pairs(spark):
    rng = random.Random(1)
    left = [(k, i, s, s + rng.randint(0, 5000)) for i, (k, s) in enumerate((rng.randint(0, 2), rng.randint(0, 40_000)) for _ in range(80))]
    right = [(k, i, s, s + rng.randint(0, 30_000)) for i, (k, s) in enumerate((rng.randint(0, 2), rng.randint(0, 40_000)) for _ in range(60))]
    a = spark.createDataFrame(left, "project long, seq long, start_ms long, end_ms long")
    b = spark.createDataFrame(right, "project long, other long, lo long, hi long")
    for width in (700, 10_000):
        got = sorted((r.seq, r.other) for r in intervals.interval_join(a, b, "lo", "hi", width=width).collect())
        assert got == sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3])


def test_sanitised_timelines_hold_their_invariants(spark):
    rows = timeline.sanitize(surrogate.timed(spark, D), 100_000).orderBy("project", "clean_start", "seq").collect()
    for x, y in zip(rows, rows[1:]):
        assert 0 <= x.clean_start < x.clean_end
        if x.project == y.project and y.clean_start - x.clean_start >= 50:
            assert x.clean_end <= y.clean_start


def test_no_partitioning_and_no_shift_changes_a_timeline(spark):
    base = surrogate.timed(spark, D)
    ask = lambda rows: sorted(tuple(r) for r in timeline.sessions(rows).select("project", "session", "first_seq", "last_seq").collect())
    want = ask(base)
    assert ask(base.repartition(8)) == want == ask(base.coalesce(1))
    moved = base.withColumn("start_ms", F.col("start_ms") + 5000).withColumn("end_ms", F.col("end_ms") + 5000)
    assert ask(moved) == want


def test_chunked_prefix_equals_one_window(spark):
    rows = surrogate.timed(spark, D).withColumn("v", F.expr("end_ms - start_ms"))
    for how in ("sum", "max"):
        got = timeline.chunked_prefix(rows, "project", "seq", "v", how, 7).select("project", "seq", "prefix")
        want = rows.selectExpr("project", "seq", f"{how}(v) over (partition by project order by seq rows between unbounded preceding and 1 preceding) as prefix")
        assert got.exceptAll(want).count() == 0 == want.exceptAll(got).count()


def test_verifier_finds_what_is_wrong_and_passes_what_is_right(spark):
    segs = spark.createDataFrame([(1, i, 1000 * i, 1000 * i + 900) for i in range(1, 7)], "project long, seq long, start_ms long, end_ms long")
    kind = "project long, item long, src array<long>"
    good = spark.createDataFrame([(1, 1, [1, 2]), (1, 2, [3]), (1, 3, [4, 5, 6])], kind)
    assert lineage.verify(segs, good).first().passed
    bad = spark.createDataFrame([(1, 1, [1, 2]), (1, 2, [2, 3]), (1, 3, [1]), (1, 4, [])], kind)
    r = lineage.verify(segs, bad).first()
    assert (r.silent, r.duplicates, r.empty, r.passed) == (3, 2, 1, False) and r.disorder >= 1
    assert lineage.verify(segs, good.limit(0)).first().silent == 6
