"""Chroma fingerprints: melodies found again under noise, gain and cuts; tables against brute force."""

import numpy as np
import pytest

from seglume.llm import audio

P = audio.AudioParams()
SCHEMA = "doc_id long, media binary, node string, offset int"


def pcm(x):
    return (np.clip(x, -1, 1) * 30000).astype("<i2").tobytes()


def sounds():
    rng = np.random.default_rng(1)
    return [audio.melody(rng, 60, P) / 2.5 for _ in range(4)]


def rows(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_frames"]))


def bits(x):
    return bin(x).count("1")


def plain_integers(recording, p=P):
    """Packed integers of one recording from direct sums: no integral image, no slices, one frame after another."""
    x = np.frombuffer(recording[: len(recording) // 2 * 2], "<i2").astype(np.float64) / 32768
    bins = [k for k in range(p.frame) if p.low <= k * p.rate / p.frame < p.high]
    frames = []
    for t in range(0, len(x) - p.frame + 1, p.hop):
        power = np.abs(np.fft.rfft(x[t : t + p.frame] * np.hanning(p.frame))) ** 2
        row = [0.0] * 12
        for k in bins:
            row[round(12 * np.log2(k * p.rate / p.frame / 440)) % 12] += power[k]
        frames.append(row)
    frames, levels = np.array(frames), []
    for t in range(len(frames) - 4):
        row = sum(c * frames[t + j] for j, c in enumerate((0.25, 0.75, 1, 0.75, 0.25)))
        norm = np.sqrt((row**2).sum())
        levels.append(np.rint(row / norm * 255) if norm > 1e-6 else np.zeros(12))
    out = []
    for t in range(len(levels) - p.width + 1):
        value = 0
        for f in audio.trained(p):
            box = np.array(levels[t : t + f.frames])[:, f.pitch : f.pitch + f.pitches]
            h, w = f.pitches, f.frames
            part = {
                "pitch halves": lambda: box[:, : h // 2].sum(),
                "time halves": lambda: box[: w // 2].sum(),
                "quarters": lambda: box[: w // 2, : h // 2].sum() + box[w // 2 :, h // 2 :].sum(),
                "pitch middle": lambda: box[:, h // 3 : h - h // 3].sum(),
                "time middle": lambda: box[w // 3 : w - w // 3].sum(),
            }[f.kind]()
            level = sum((part + 1) > b * (box.sum() - part + 1) for b in f.bounds)
            value = value << 2 | (0, 1, 3, 2)[level]
        out.append(value)
    return out


def plain_stretch(a, b, p=P):
    """The longest stretch of agreeing integers of two recordings over all offsets."""
    best = 0
    for offset in range(-len(b) + 1, len(a)):
        run = 0
        for i in range(max(0, offset), min(len(a), len(b) + offset)):
            run = run + 1 if bits(a[i] ^ b[i - offset]) <= p.bit_errors else 0
            best = max(best, run)
    return best


def test_copies_noise_gain_and_cuts_align(spark):
    a, b, c, _ = sounds()
    rng = np.random.default_rng(2)
    noisy = a + rng.normal(0, 0.003, len(a))
    cut = a[40 * P.hop :]
    both = np.concatenate([c[: 70 * P.hop], a])
    media = [(0, pcm(a)), (1, pcm(a)), (2, pcm(noisy)), (3, pcm(a * 0.5)), (4, pcm(cut)), (5, pcm(both)), (6, pcm(b)), (7, None), (8, b""), (9, pcm(np.zeros(5000)))]
    got = rows(audio.align(spark.createDataFrame(media, "doc_id long, media binary"), "doc_id", "media"))
    assert [r["component_id"] for r in got] == [0, 0, 0, 0, 0, 0, 6, 7, 8, 9]
    hub = {r["partner_id"] for r in got[:6]} - {None}
    assert hub and all(r["bit_error"] <= 0.1 and r["aligned"] > 0.5 * (r["n_frames"] - 90) for r in got[:6] if r["partner_id"] is not None)
    starts = {0: 0, 1: 0, 2: 0, 3: 0, 4: -40, 5: 70}
    for r in got[:6]:
        if r["partner_id"] is not None:
            assert r["offset"] == starts[r["doc_id"]] - starts[r["partner_id"]]


def test_integers_are_those_of_direct_sums():
    x = pcm(sounds()[0][: 90 * P.hop])
    own = audio.integers(*audio.pcm16(np.frombuffer(x, np.uint8), np.array([0, len(x)])), audio.trained(), P)[0]
    plain = plain_integers(x)
    assert len(own) == len(plain) > 50
    assert sum(bits(int(a) ^ b) for a, b in zip(own, plain)) <= 0.002 * 32 * len(plain)  # single precision turns a bit at times


def test_components_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    parts = [x[: len(x) // P.hop * P.hop] / 2.5 for x in (audio.melody(rng, 14, P) for _ in range(7))]
    media = [(i, pcm(np.concatenate([parts[k] for k in rng.integers(0, 7, rng.integers(1, 3))]))) for i in range(16)]
    got = rows(audio.align(spark.createDataFrame(media, "doc_id long, media binary"), "doc_id", "media"))
    fps, root = [plain_integers(m) for _, m in media], list(range(16))
    for i in range(16):
        for j in range(i):
            if root[i] != root[j] and plain_stretch(fps[i], fps[j]) >= P.least_run:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    assert [r["component_id"] for r in got] == root and 1 < len(set(root)) < 16
    for r in got:
        if r["partner_id"] is not None:
            a, b, o = fps[r["doc_id"]], fps[r["partner_id"]], r["offset"]
            errors = [bits(a[i] ^ b[i - o]) for i in range(max(0, o), min(len(a), len(b) + o))]
            agree = [e for e in errors if e <= P.bit_errors]
            assert abs(r["aligned"] - len(agree)) <= 2 and abs(r["bit_error"] - sum(agree) / len(agree) / 32) < 0.01


def test_recall_at_the_noise_it_is_built_for(spark):
    """Every pair of a melody of some four seconds and its noisy copy, cut at any sample, agrees in bits by brute force;
    nine in ten link."""
    rng, media, n = np.random.default_rng(12), [], 40
    for i in range(n):
        sound = audio.melody(rng, 120, P)
        noisy = (sound + rng.normal(0, P.noise, len(sound)).astype(np.float32))[rng.integers(0, 20 * P.hop) :]
        media += [(2 * i, pcm(sound / 2.5)), (2 * i + 1, pcm(noisy / 2.5))]
    got = rows(audio.align(spark.createDataFrame(media, "doc_id long, media binary"), "doc_id", "media"))
    pairs = [got[2 * i + 1]["component_id"] == got[2 * i]["component_id"] for i in range(n)]
    print("recall", sum(pairs) / n)
    for i in range(0, n, 20):
        assert plain_stretch(*(plain_integers(media[2 * i + k][1]) for k in range(2))) >= P.least_run
    assert sum(pairs) >= 0.9 * n
    assert all(r["component_id"] // 2 == r["doc_id"] // 2 for r in got)


def test_one_shared_landmark_is_no_link(spark, monkeypatch):
    """Recordings that meet in a landmark or more, but whose bits do not agree around them, stay apart."""
    rng = np.random.default_rng(9)
    few = rng.integers(0, 1 << 32, 15, dtype=np.uint64).astype(np.uint32)
    fps = [np.concatenate([rng.integers(0, 1 << 32, 60, dtype=np.uint64).astype(np.uint32), few, rng.integers(0, 1 << 32, 60, dtype=np.uint64).astype(np.uint32)]) for _ in range(4)]
    assert set(audio.landmarks(fps[0], P)[0].tolist()) & set(audio.landmarks(fps[1], P)[0].tolist())
    long_ = rng.integers(0, 1 << 32, 40, dtype=np.uint64).astype(np.uint32)
    fps += [np.concatenate([rng.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32), long_]) for k in (30, 47)]
    kind = "doc_id long, n_frames int, node binary, packed binary, marks array<struct<hash:long,pos:int,own:long>>"
    made = [(i, len(x), bytes([i]), x.astype("<u4").tobytes(), [tuple(map(int, m)) for m in zip(*audio.landmarks(x, P))]) for i, x in enumerate(fps)]
    monkeypatch.setattr(audio, "fingerprints", lambda *_: spark.createDataFrame(made, kind))
    got = rows(audio.align(None, "doc_id", "media"))
    assert [r["component_id"] for r in got] == [0, 1, 2, 3, 4, 4]
    assert [r["links"] for r in got] == [0, 0, 0, 0, 1, 1] and got[5]["offset"] == 17 and got[4]["offset"] == -17
    assert [r["partner_id"] for r in got] == [None] * 4 + [5, 4]


def test_turned_bits_and_earlier_repeats_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(12)
    some = lambda n: rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
    loose = [b for b in range(32) if not audio.stable_bits(P) >> b & 1]
    pairs = []
    for turned in (3, 5, 6, 8):  # all bits that may differ, of those that landmarks do not look at
        base = some(60)
        flips = np.array([sum(1 << int(b) for b in rng.choice(loose, turned, replace=False)) for _ in range(60)], np.uint32)
        pairs += [np.concatenate([some(20), base, some(20)]), np.concatenate([some(33), base ^ flips, some(10)])]
    base = some(60)
    noisy = base ^ np.array([sum(1 << int(b) for b in rng.choice(loose, 12, replace=False)) for _ in range(60)], np.uint32)
    for early, late in ((noisy, base), (base, base)):
        pairs.append(np.concatenate([some(11), early, some(9), late, some(5)]))  # a repeat before, beyond the bar
    kind = "doc_id long, n_frames int, node binary, packed binary, marks array<struct<hash:long,pos:int,own:long>>"
    made = [(i, len(x), bytes([i]), x.astype("<u4").tobytes(), [tuple(map(int, m)) for m in zip(*audio.landmarks(x, P))]) for i, x in enumerate(pairs)]
    monkeypatch.setattr(audio, "fingerprints", lambda *_: spark.createDataFrame(made, kind))
    got = rows(audio.align(None, "doc_id", "media"))
    assert [r["component_id"] for r in got] == [0, 0, 2, 2, 4, 4, 6, 6, 8, 8]


def test_landmarks_of_shared_stretches_meet():
    rng = np.random.default_rng(6)
    for _ in range(200):
        shared = rng.integers(0, 1 << 32, P.run + P.apart + 4 * P.window - 4, dtype=np.uint64).astype(np.uint32)
        one, two = (np.concatenate([rng.integers(0, 50, rng.integers(0, 30)), shared, rng.integers(0, 50, rng.integers(0, 30))]).astype(np.uint32) for _ in range(2))
        assert set(audio.landmarks(one, P)[0].tolist()) & set(audio.landmarks(two, P)[0].tolist())
    assert not len(audio.landmarks(np.full(100, 7, np.uint32), P)[0])


def test_integers_do_not_depend_on_neighbours_in_a_slice():
    parts = [x for x in sounds()]
    offs = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    packed, first = audio.integers(np.concatenate(parts), offs, audio.trained(), P)
    for i, x in enumerate(parts):
        own = audio.integers(x, np.array([0, len(x)]), audio.trained(), P)[0]
        assert len(own) == first[i + 1] - first[i] and np.mean(own != packed[first[i] : first[i + 1]]) < 0.01


def test_nulls_repeats_empty_tables_and_extra_columns(spark):
    a = pcm(sounds()[0])
    kind = "doc_id long, media binary, node string, offset int, hash int"
    media = spark.createDataFrame([(None, a, "x", 1, 2), (5, a, "y", 1, 2), (5, a, "y", 1, 2), (6, b"\1", None, None, None), (8, b"\1", None, None, None), (9, b"", None, None, None)], kind)
    got = rows(audio.align(media, "doc_id", "media"))
    assert [(r["doc_id"], r["component_id"]) for r in got] == [(5, 5), (5, 5), (6, 6), (8, 6), (9, 9), (None, 5)]
    assert audio.align(media.limit(0), "doc_id", "media").count() == 0


def test_texts_played_as_notes_keep_their_passages():
    play = audio.notes(P)
    rng = np.random.default_rng(3)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 5))
    shared = " ".join(word() for _ in range(300))
    texts = [" ".join(word() for _ in range(n)) + " " + shared for n in (37, 90)]
    found = []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        samples, offs = play(raw, np.array([0, len(raw)]))
        assert offs[-1] == len(samples)
        found.append(set(audio.landmarks(audio.integers(samples, offs, audio.trained(), P)[0], P)[0].tolist()))
    assert len(found[0] & found[1]) >= 5
    assert play(np.zeros(0, np.uint8), np.array([0, 0]))[1].tolist() == [0, 0]


def test_links_within_a_component_are_all_counted(spark, monkeypatch):
    """Recordings of which each meets each, and two that only meet one of them: the number of links is that of all pairs."""
    rng = np.random.default_rng(21)
    some = lambda n: rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
    one, two = some(50), some(50)
    fps = [np.concatenate([some(n), one, some(9)]) for n in (3, 20, 31, 14, 8)] + [np.concatenate([some(7), two, some(4), one])] + [np.concatenate([some(n), two]) for n in (5, 26)]
    kind = "doc_id long, n_frames int, node binary, packed binary, marks array<struct<hash:long,pos:int,own:long>>"
    made = [(i, len(x), bytes([i]), x.astype("<u4").tobytes(), [tuple(map(int, m)) for m in zip(*audio.landmarks(x, P))]) for i, x in enumerate(fps)]
    monkeypatch.setattr(audio, "fingerprints", lambda *_: spark.createDataFrame(made + made[:2], kind))
    got = rows(audio.align(None, "doc_id", "media"))
    plain = [sum(plain_stretch(x.tolist(), y.tolist()) >= P.least_run for y in fps if y is not x) for x in fps]
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[i]["links"] for i in range(8)] == plain == [5] * 5 + [7, 2, 2]
    assert [r["component_id"] for r in got] == [0] * 10


def test_landmarks_of_one_shared_stretch_are_one_meeting(spark, monkeypatch):
    """Recordings that share a long stretch meet once a stretch of it, not once a landmark, also where one repeats it; the
    votes are those of all pairs of places of a landmark around which the bits agree."""
    rng = np.random.default_rng(33)
    some = lambda n: rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
    one, two = some(60), some(11)
    fps = [np.concatenate([some(k), one, some(9)]) for k in (3, 20, 41)] + [np.concatenate([one, one, one, some(4), one])]
    fps += [np.concatenate([some(25), two, some(25)]) for _ in range(2)]
    kind = "doc_id long, n_frames int, node binary, packed binary, marks array<struct<hash:long,pos:int,own:long>>"
    marks = [list(zip(*(v.tolist() for v in audio.landmarks(x, P)))) for x in fps]
    made = spark.createDataFrame([(i, len(x), bytes([i]), x.astype("<u4").tobytes(), m) for i, (x, m) in enumerate(zip(fps, marks))], kind)
    classes = spark.createDataFrame([(bytes([i]), i) for i in range(len(fps))], "node binary, n long")
    met = audio.meetings(audio._bodies(made, classes), P).collect()
    places = sum(h in {y[0] for k, m in enumerate(marks) if k != i for y in m} for i, own in enumerate(marks) for h, _, _ in own)
    assert 0 < len(met) < places / 4 and sum(len(r["moves"]) * len(r["refs"]) for r in met) == places

    def votes(i, j):
        """By offset: pairs of places of a landmark that a stretch of agreeing integers meets."""
        out = {}
        for h, x, own in marks[i]:
            for g, y, other in marks[j]:
                if (h, own) == (g, other):
                    at = range(max(-x, -y), min(len(fps[i]) - x, len(fps[j]) - y))
                    good = [bits(int(fps[i][x + t] ^ fps[j][y + t])) <= P.bit_errors for t in at]
                    ok = any(all(good[k : k + P.least_run]) and at[k] < own + P.run and at[k] + P.least_run > 0 for k in range(len(good) - P.least_run + 1))
                    out[x - y] = out.get(x - y, 0) + ok
        return {k: v for k, v in out.items() if v}

    monkeypatch.setattr(audio, "fingerprints", lambda *_: made)
    got = rows(audio.align(None, "doc_id", "media"))
    assert [r["links"] for r in got] == [sum(bool(votes(i, j)) for j in range(6) if j != i) for i in range(6)] == [3, 3, 3, 3, 0, 0]
    for r in got[:4]:
        found = {j: votes(r["doc_id"], j) for j in range(4) if j != r["doc_id"]}
        assert r["votes"] == max(v for f in found.values() for v in f.values()) == found[r["partner_id"]][r["offset"]]
