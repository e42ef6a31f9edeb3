"""Rules of neighbours as windows against the walks from row to row."""

import random

from seglume.operators import folds, turns


def test_windows_equal_the_walks(spark):
    rng = random.Random(5)
    talk, parts = [], []
    for project in range(12):
        t = 0
        for seq in range(1, rng.choice((2, 40, 80))):
            t += rng.choice((0, 100, 400, 900, 3000))
            talk.append((project, seq, rng.choice(("a", "A ", "b", "", None)), t, t + rng.choice((0, 200, 1500, 4000)), rng.choice((None, 100, 700)), f"w{seq}"))
            parts.append((project, seq, rng.randrange(4000), rng.randrange(5000), 120, rng.choice((90, 118)), t))
    rows = spark.createDataFrame(talk, "project long, seq long, speaker string, start_ms long, end_ms long, raw_ms long, text string").repartition(4)
    walked = folds.fold(rows, folds.speaker_turns(), "seq long, turn long, offset_ms long")
    own = turns.speaker_turns(rows)
    assert sorted(map(tuple, own.select("project", "seq", "turn", "offset_ms").collect())) == sorted(map(tuple, walked.collect()))
    walked = folds.fold(rows, folds.split_overlaps(), "seq long, start_ms long, end_ms long")
    assert sorted(map(tuple, turns.split_overlaps(rows).collect())) == sorted(map(tuple, walked.collect()))
    voice = spark.createDataFrame(parts, "project long, seq long, part_start long, part_end long, cut_ms long, speed_pct long, slot_start long")
    walked = folds.fold(voice, folds.sync_to_waveform(), "seq long, start_ms long, end_ms long")
    assert sorted(map(tuple, turns.sync_to_waveform(voice).collect())) == sorted(map(tuple, walked.collect()))
    texts = {(r.project, r.turn): r.text for r in turns.turn_texts(own).collect()}
    assert all(texts[p, t] == " ".join(f"w{r.seq}" for r in sorted(rs, key=lambda r: r.seq)) for (p, t), rs in _by(own.collect()).items())


def _by(rows):
    out = {}
    for r in rows:
        out.setdefault((r.project, r.turn), []).append(r)
    return out
