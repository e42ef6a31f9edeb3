"""Files a project: written in order, read back equal, nothing left of a job that failed."""

import json
import os

import pytest
from pyspark.sql import functions as F

from seglume.sources import files, project_files

SEGS = "project string, seq long, start_ms long, end_ms long, text string, translated_text string"
ROWS = [("b/ä", 2, 1500, 2500, "b\\Nc", "zwei"), ("b/ä", 1, 0, 1000, "a", "eins zwo"), (None, 1, 61_000, 3_600_007, None, None), ("c", 1, 5, 10, "{x}", "[7] 水"), ("c", 2, 7, 8, "水水", "3. ok ., so")]


def test_subtitles_come_back_as_they_were(spark, tmp_path):
    segs = spark.createDataFrame(ROWS, SEGS).repartition(3)
    path = f"file://{tmp_path}/srt"
    project_files.write(segs, files.srt_text(), path, "srt")
    assert sorted(os.listdir(tmp_path / "srt")) == ["%null.srt", "b%2F%C3%A4.srt", "c.srt"]
    back = project_files.read(spark, path, "srt")
    want = {(r[0], r[1], r[2], r[3], r[4] or "") for r in ROWS}
    assert {tuple(r) for r in back.collect()} == want
    project_files.write(segs.where("project = 'c'"), files.srt_text(), path, "srt", mode="append")
    assert back.count() == 5
    project_files.write(segs.where("project = 'c'"), files.srt_text(), path, "srt")
    assert os.listdir(tmp_path / "srt") == ["c.srt"]


def test_only_the_files_of_a_filter_are_opened(spark, tmp_path):
    path = f"file://{tmp_path}/srt"
    project_files.write(spark.createDataFrame(ROWS, SEGS), files.srt_text(), path, "srt")
    (tmp_path / "srt" / "c.srt").write_bytes(b"\xff\xfe broken")
    assert project_files.read(spark, path, "srt").where("project = 'b/ä'").count() == 2
    with pytest.raises(Exception, match="decode"):
        project_files.read(spark, path, "srt").count()


def test_karaoke_masks_and_audits(spark, tmp_path):
    segs = spark.createDataFrame(ROWS, SEGS)
    files.write_karaoke(segs, f"file://{tmp_path}/ass", 1280, 720)
    assert sorted(os.listdir(tmp_path / "ass")) == ["b%2F%C3%A4.ass", "c.ass"]  # without a caption, no file
    got = project_files.read(spark, f"file://{tmp_path}/ass", "ass").orderBy("project", "seq").collect()
    assert [(r.project, r.start_ms, r.end_ms, r.text) for r in got] == [("b/ä", 0, 1000, "{\\kf57}eins {\\kf43}zwo"), ("b/ä", 1500, 2500, "{\\kf100}zwei"), ("c", 10, 310, "{\\kf18}ok, {\\kf12}so")]
    head = (tmp_path / "ass" / "c.ass").read_text().splitlines()
    assert head[0] == "[Script Info]" and "PlayResY: 720" in head and any(x.startswith("Style: Main,Arial,28,") and x.endswith(",36") for x in head)
    masks = {(r.project, r.seq): r.m for r in segs.select("project", "seq", files.mask_text(width=1280, height=720).alias("m")).collect()}
    assert masks[(None, 1)] is None and masks[("c", 1)] is None
    assert masks[("c", 2)].startswith("Dialogue: 0,0:00:00.01,0:00:00.21,") and masks[("c", 2)].endswith("{\\p1}m 552 550 l 728 550 l 728 662 l 552 662{\\p0}")
    audit = segs.where("project is not null").select("project", "seq", "start_ms", "end_ms", *[F.lit(1234).alias(f"{x}_ms") for x in ("target", "raw", "trimmed", "voice")], F.lit(105).alias("speed_pct"), F.lit(0).alias("cut_head_ms"), F.lit(20).alias("cut_tail_ms"))
    files.write_audit(audit, f"file://{tmp_path}/audit")
    records = json.loads((tmp_path / "audit" / "c.json").read_text())
    assert [r["tts_index"] for r in records] == [1, 2]
    assert records[0] == {"tts_index": 1, "start": 0.01, "end": 0.01, "target": 1.23, "raw": 1.23, "trimmed": 1.23, "voice": 1.23, "speed": 1.05, "trimmed_voice": True, "cut_head_ms": 0, "cut_tail_ms": 20}


def test_a_task_that_fails_leaves_nothing_and_keeps_what_was_there(spark, tmp_path):
    segs = spark.createDataFrame(ROWS, SEGS)
    path = f"file://{tmp_path}/srt"
    project_files.write(segs.where("project = 'c'"), files.srt_text(), path, "srt")
    before = (tmp_path / "srt" / "c.srt").read_bytes()
    bad = F.when(F.col("project") == "b/ä", F.raise_error("stop")).otherwise(files.srt_text())
    with pytest.raises(Exception, match="stop"):
        project_files.write(segs, bad, path, "srt")
    assert os.listdir(tmp_path / "srt") == ["c.srt"] and (tmp_path / "srt" / "c.srt").read_bytes() == before
    project_files.write(segs.limit(0), files.srt_text(), path, "srt", mode="append")
    assert os.listdir(tmp_path / "srt") == ["c.srt"]
    assert project_files.read(spark, f"file://{tmp_path}/none", "srt").count() == 0
    writer = project_files.Writer({"path": path}, True)
    with pytest.raises(ValueError, match="several runs"):
        writer.commit([project_files.Written([("x", "a.txt")]), project_files.Written([("y", "a.txt")])])


def test_small_files_share_a_partition(spark, tmp_path, monkeypatch):
    """A task a file takes longer to start than to read; whole files are dealt by their bytes and number, and none is lost."""
    path = f"file://{tmp_path}/srt"
    rows = spark.range(40).selectExpr("cast(id as string) as project", "1L as seq", "0L as start_ms", "id as end_ms", "repeat('x', 20) as text")
    project_files.write(rows, files.srt_text(), path, "srt")
    back = project_files.read(spark, path, "srt")
    assert back.rdd.getNumPartitions() == 1
    assert sorted((r.project, r.end_ms) for r in back.collect()) == sorted((str(i), i) for i in range(40))
    reader = project_files.Reader({"path": path, "form": "srt"})
    for most, number in (("_BYTES", 150), ("_FILES", 2)):
        with monkeypatch.context() as m:
            m.setattr(project_files, most, number)
            parts = [p.value for p in reader.partitions()]
        assert sorted(x for p in parts for x in p) == sorted(os.listdir(tmp_path / "srt")) and 20 <= len(parts) < 40
    with monkeypatch.context() as m:
        m.setattr(project_files, "_BYTES", 1)  # a file that is larger stands alone
        assert len(reader.partitions()) == 40
