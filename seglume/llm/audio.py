"""Media columns: chroma audio fingerprints.

1. A recording's samples become overlapping frames, each frame's power by pitch class a chroma vector, smoothed over
   five frames, scaled to length one and rounded to ``LEVELS`` (so that sums of them are exact).
2. Filters over images of ``width`` frames (sums of rectangles, from an integral image) compare two halves of a
   rectangle; each is quantised at three thresholds into two bits of a Gray code. Sixteen filters make a packed integer
   of 32 bits for each frame. The filters and thresholds are chosen here, on melodies from a seeded generator: balanced
   bits that noise turns least and that tell the least of each other.
3. Landmarks are runs of ``run`` integers, by the ``kept_bits`` bits of each that noise turns least, thinned by
   winnowing: of each ``window`` consecutive runs the one with the smallest hash stays. A run of one integer only (silence,
   a steady tone) is never one. A landmark is a pair of such runs, the second the first one at least ``apart`` integers
   on (neighbours look at much the same frames and tell little of each other), with the distance between them, so that two
   places agree on an offset before recordings meet at all; any stretch of run + apart + 4 * window - 4 integers that
   two recordings share in those bits has one in both.
4. Recordings with equal integers are one class. Two classes link if, at one offset of the histogram over their shared
   landmarks, at least ``least_votes`` landmarks agree, each within reach of a stretch of at least ``least_run`` consecutive
   integers that differ in no more than ``bit_errors`` bits each: votes propose, bit errors decide. A landmark counts if
   such a stretch meets it, which the integers around it tell; so whole recordings meet only for the best link of each.
5. All classes that share a landmark are compared, also within what other links already join, so that a recording's number
   of links is whole. Landmarks that stand at the same distances in the same classes are one meeting of these (by stretches
   of ``_STRETCH`` integers), so two recordings meet about once a shared stretch, not once a landmark. Equal recordings are
   one class before that; a group of recordings that differ has as many links as it has pairs.

Nulls: a null recording is empty; empty ones stand alone: their component is their own id. Recordings that are too short
for an image have no integers; those with equal bytes are one class, without links to others. A null id takes part, but
never names a component of which another member has an id. Repeated rows stay, and do not add votes. An empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from seglume.llm.components import connected
from seglume.llm.textbytes import SPACE, buffers, hashes, map_texts, mix64, slices, word_mask, words
from seglume.storage import stage

#: From the bytes of many recordings and their offsets: all samples, and where each recording begins (one more at the end).
Decoder = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class AudioParams:
    rate: int = 4000
    frame: int = 128
    hop: int = 32
    low: float = 500.0
    high: float = 2000.0
    width: int = 16
    run: int = 4
    window: int = 5
    #: Least distance of a landmark's two runs.
    apart: int = 6
    #: Bits of an integer that landmarks look at, the least turned by noise.
    kept_bits: int = 12
    #: Integers with no more differing bits agree.
    bit_errors: int = 8
    least_votes: int = 1
    least_run: int = 16
    #: Noise (beside tones of 0.3 to 1) for which filters and bits are chosen.
    noise: float = 0.05


FILTERS = 16
LEVELS = 255
_SMOOTH = (0.25, 0.75, 1.0, 0.75, 0.25)
_BLOCK = 8192
_SLICE = 1 << 20


def pcm16(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Little-endian samples of 16 bits; an odd last byte of a recording is left out."""
    n = np.diff(offs) // 2
    parts = [raw[a : a + 2 * k].tobytes() for a, k in zip(offs[:-1].tolist(), n.tolist())]
    return np.frombuffer(b"".join(parts), "<i2").astype(np.float32) / 32768, np.concatenate([[0], np.cumsum(n)])


# ---- pitch-class frames

@cache
def _basis(p: AudioParams) -> tuple[np.ndarray, np.ndarray]:
    """Windowed cosines and sines of the bins in the band, and the pitch class of each bin."""
    bins = np.arange(int(np.ceil(p.low * p.frame / p.rate)), int(p.high * p.frame / p.rate))
    at = np.arange(p.frame)
    angle = 2 * np.pi * np.outer(at, bins) / p.frame
    hann = np.hanning(p.frame)[:, None]
    classes = np.round(12 * np.log2(bins * p.rate / p.frame / 440)).astype(int) % 12
    return np.concatenate([np.cos(angle) * hann, np.sin(angle) * hann], axis=1).astype(np.float32), np.eye(12, dtype=np.float32)[classes]


def chroma(samples: np.ndarray, offs: np.ndarray, p: AudioParams) -> tuple[np.ndarray, np.ndarray]:
    """(levels, first): a row of 12 levels for each smoothed frame, and where each recording's rows begin."""
    n = np.maximum(0, (np.diff(offs) - p.frame) // p.hop + 1)
    first = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros((int(first[-1]), 12), np.float32)
    if len(out):
        waves, classes = _basis(p)
        half = waves.shape[1] // 2
        starts = np.repeat(offs[:-1] - first[:-1] * p.hop, n) + np.arange(first[-1]) * p.hop
        frames = np.lib.stride_tricks.sliding_window_view(samples, p.frame)
        for i in range(0, len(out), _BLOCK):
            z = frames[starts[i : i + _BLOCK]] @ waves
            out[i : i + _BLOCK] = (z[:, :half] ** 2 + z[:, half:] ** 2) @ classes
    lost = len(_SMOOTH) - 1
    rows = np.maximum(0, n - lost)
    if len(out) > lost:
        smooth = sum(c * out[j : len(out) - lost + j] for j, c in enumerate(_SMOOTH))
    else:
        smooth = np.zeros((0, 12), np.float32)
    ends = np.concatenate([[0], np.cumsum(rows)])
    smooth = smooth[np.repeat(first[:-1] - ends[:-1], rows) + np.arange(ends[-1])]
    norm = np.linalg.norm(smooth, axis=1, keepdims=True)
    levels = np.where(norm > 1e-6, smooth / np.where(norm > 0, norm, 1), 0) * LEVELS
    return np.rint(levels).astype(np.int64), ends


# ---- filters

@dataclass(frozen=True)
class Filter:
    """Rectangle of pitches and frames; ``kind`` says which part of it stands against the rest."""

    kind: str
    pitch: int
    pitches: int
    frames: int
    #: Bounds of (1 + part) / (1 + rest) between the four levels.
    bounds: tuple[float, float, float] = (1.0, 1.0, 1.0)


KINDS = ("pitch halves", "time halves", "quarters", "pitch middle", "time middle")


def integral(levels: np.ndarray) -> np.ndarray:
    """13 x (rows + 1): sums of all levels of lower pitches and earlier rows."""
    out = np.zeros((13, len(levels) + 1), np.int64)
    np.cumsum(np.cumsum(levels, axis=0), axis=1, out=out[1:, 1:].T)
    return out


def compare(sums: np.ndarray, f: Filter, n: int) -> tuple[np.ndarray, np.ndarray]:
    """1 + the part and 1 + the rest of the filter's rectangle, at each of the first ``n`` rows."""

    def box(y0: int, y1: int, t0: int, t1: int) -> np.ndarray:
        y0, y1 = y0 + f.pitch, y1 + f.pitch
        return sums[y1, t1 : t1 + n] - sums[y1, t0 : t0 + n] - sums[y0, t1 : t1 + n] + sums[y0, t0 : t0 + n]

    h, w = f.pitches, f.frames
    if f.kind == "pitch halves":
        part = box(0, h // 2, 0, w)
    elif f.kind == "time halves":
        part = box(0, h, 0, w // 2)
    elif f.kind == "quarters":
        part = box(0, h // 2, 0, w // 2) + box(h // 2, h, w // 2, w)
    elif f.kind == "pitch middle":
        part = box(h // 3, h - h // 3, 0, w)
    else:
        part = box(0, h, w // 3, w - w // 3)
    return part + 1, box(0, h, 0, w) - part + 1


_GRAY = np.array([0, 1, 3, 2], np.uint32)


def pack(levels: np.ndarray, filters: tuple[Filter, ...], p: AudioParams) -> np.ndarray:
    """A packed integer for each row at which an image begins."""
    n = len(levels) - p.width + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    sums, out = integral(levels), np.zeros(n, np.uint32)
    for f in filters:
        part, rest = compare(sums, f, n)
        level = sum((part > b * rest).astype(np.uint8) for b in f.bounds)
        out = out << np.uint32(2) | _GRAY[level]
    return out


def melody(rng: np.random.Generator, notes: int, p: AudioParams) -> np.ndarray:
    """Tones of random pitch and length, some two at a time, for choosing filters and for tests."""
    out = []
    for _ in range(notes):
        t = np.arange(rng.integers(1, 7) * p.hop + rng.integers(0, p.hop)) / p.rate
        tone = sum(np.sin(2 * np.pi * p.low * 2 ** (rng.integers(0, 24) / 12) * t + rng.uniform(0, 6)) for _ in range(rng.integers(1, 3)))
        out.append(tone * rng.uniform(0.3, 1.0))
    return np.concatenate(out).astype(np.float32)


@cache
def trained(p: AudioParams = AudioParams(), drawn: int = 300, seed: int = 3) -> tuple[Filter, ...]:
    rng = np.random.default_rng(seed)
    sound = melody(rng, 1500, p)
    noisy = sound + rng.normal(0, p.noise, len(sound)).astype(np.float32)
    ends = np.array([0, len(sound)])
    sums, other = (integral(chroma(x, ends, p)[0]) for x in (sound, noisy))
    n = sums.shape[1] - p.width
    pool = []
    for _ in range(drawn):
        kind, h = KINDS[rng.integers(len(KINDS))], int(rng.integers(3, 13))
        f = Filter(kind, int(rng.integers(0, 13 - h)), h, int(rng.integers(3, p.width + 1)))
        ratio = np.divide(*compare(sums, f, n))
        bounds = tuple(float(x) for x in np.quantile(ratio, (0.25, 0.5, 0.75)))
        code, again = (_GRAY[np.searchsorted(bounds, r)] for r in (ratio, np.divide(*compare(other, f, n))))
        stable = 1 - np.mean(np.bitwise_count(code ^ again)) / 2
        pool.append((Filter(f.kind, f.pitch, f.pitches, f.frames, bounds), stable, np.searchsorted(bounds, ratio) - 1.5))
    chosen: list[int] = []
    while len(chosen) < FILTERS:
        worth = [-1.0 if i in chosen else stable - max((abs(np.mean(own * pool[j][2])) / 1.25 for j in chosen), default=0.0) for i, (_, stable, own) in enumerate(pool)]
        chosen.append(int(np.argmax(worth)))
    return tuple(pool[i][0] for i in chosen)


@cache
def stable_bits(p: AudioParams = AudioParams(), seed: int = 5) -> int:
    """A mask of the ``kept_bits`` bits of an integer that noise and a cut between two frames turn least, on another
    melody."""
    rng = np.random.default_rng(seed)
    sound = melody(rng, 800, p)
    ends, filters = np.array([0, len(sound)]), trained(p)
    noisy = np.concatenate([sound[p.hop // 4 :], np.zeros(p.hop // 4, np.float32)]) + rng.normal(0, p.noise, len(sound)).astype(np.float32)
    clean, noisy = (integers(x, ends, filters, p)[0] for x in (sound, noisy))
    turned = [int(((clean ^ noisy) >> np.uint32(b) & np.uint32(1)).sum()) for b in range(2 * FILTERS)]
    return sum(1 << b for b in sorted(range(2 * FILTERS), key=lambda b: (turned[b], b))[: p.kept_bits])


def integers(samples: np.ndarray, offs: np.ndarray, filters: tuple[Filter, ...], p: AudioParams) -> tuple[np.ndarray, np.ndarray]:
    """(packed, first): the packed integers of all recordings, and where each recording's begin."""
    levels, rows = chroma(samples, offs, p)
    packed, n = pack(levels, filters, p), np.maximum(0, np.diff(rows) - p.width + 1)
    first = np.concatenate([[0], np.cumsum(n)])
    return packed[np.repeat(rows[:-1] - first[:-1], n) + np.arange(first[-1])], first


def landmarks(packed: np.ndarray, p: AudioParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, positions, distances) of one recording's landmarks, all of them: the position of the first run, and how far
    on the second one begins."""
    n = len(packed) - p.run + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)
    kept = packed & np.uint32(stable_bits(p))
    h, steady = np.zeros(n, np.uint64), np.ones(n, bool)
    for j in range(p.run):
        h = mix64(h + kept[j : j + n].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        steady &= kept[j : j + n] == kept[:n]
    h[steady] = np.uint64(2**64 - 1)
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    going, coming = np.ones(n, bool), np.ones(n, bool)
    for j in range(1, min(p.window, n)):
        going[:j] = False
        going[j:] &= h[:-j] >= h[j:]
        left += going
        coming[n - j :] = False
        coming[: n - j] &= h[j:] > h[: n - j]
        right += coming
    at = np.flatnonzero((left + right + 1 >= min(p.window, n)) & ~steady)
    then = np.searchsorted(at, at + p.apart)
    here, there = at[then < len(at)], at[then[then < len(at)]]
    hashed = mix64(mix64(h[here] + (there - here).astype(np.uint64)) + h[there])
    return hashed.view(np.int64), here.astype(np.int32), there - here


# ---- tables

_MARKS = "doc_id long, n_frames int, node binary, packed binary, marks array<struct<hash:long,pos:int,own:long>>"


def fingerprints(media: DataFrame, id_col: str, media_col: str, decode: Decoder = pcm16, params: AudioParams = AudioParams()) -> DataFrame:
    """doc_id, n_frames (packed integers), node (the class: a digest of the integers, of the bytes where there are none,
    null for an empty recording), packed (little-endian), marks (landmarks); one row a recording."""
    p, filters = params, trained(params)
    kind = pa.struct([("hash", pa.int64()), ("pos", pa.int32()), ("own", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offs in slices(batch.column(1), _SLICE):
                packed, first = integers(*decode(raw, offs), filters, p)
                own = [packed[x:y] for x, y in zip(first[:-1].tolist(), first[1:].tolist())]
                found = [landmarks(x, p) for x in own]
                ends = np.concatenate([[0], np.cumsum([len(h) for h, *_ in found])]).astype(np.int32)
                flat = pa.StructArray.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in range(3)], fields=list(kind))
                body = [x.astype("<u4").tobytes() for x in own]
                node = [md5(x).digest() if x else md5(b"bytes" + raw[y:z].tobytes()).digest() if z > y else None for x, y, z in zip(body, offs[:-1].tolist(), offs[1:].tolist())]
                cols = [batch.column(0).slice(a, b - a), pa.array(np.diff(first).astype(np.int32)), pa.array(node, pa.binary()), pa.array(body, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), flat)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_frames", "node", "packed", "marks"])

    body = F.coalesce(F.col(media_col).cast("binary"), F.lit(b""))
    return map_texts(media.select(F.col(id_col).cast("long").alias("doc_id"), body.alias("media")), run, _MARKS)


def agreement(a: np.ndarray, b: np.ndarray, offset: int, p: AudioParams) -> tuple[int, int, float | None]:
    """Of ``a`` moved by ``offset`` against ``b``: the longest stretch of aligned integers that agree, how many agree, and
    their share of differing bits."""
    x, y = max(0, offset), min(len(a), len(b) + offset)
    if x >= y:
        return 0, 0, None
    bits = np.bitwise_count(a[x:y] ^ b[x - offset : y - offset])
    good = bits <= p.bit_errors
    breaks = np.flatnonzero(~np.concatenate([[False], good, [False]]))
    bits = bits[good]
    return int(np.diff(breaks).max()) - 1, len(bits), float(bits.mean()) / 32 if len(bits) else None


def _agreements(p: AudioParams):
    """Of each pair at its offset how many integers agree, and their share of differing bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets = batch.column(4).to_pylist()
            rows = [agreement(*(np.frombuffer(v.as_buffer(), "<u4") for v in (x, y)), t, p) for x, y, t in zip(batch.column(2), batch.column(3), offsets)]
            told = [pa.array([r[k + 1] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *told], names=["a", "b", "aligned", "bit_error"])

    return run


def _near(p: AudioParams):
    """(a, b, offset, votes) of the rows of ``meetings`` that two recordings have in common: at each offset, around how
    many pairs of places of their landmarks the bits agree: a stretch of ``least_run`` integers, each within the bit
    errors, that meets the landmark. What a row brings along is its landmarks and ``least_run`` - 1 integers on either
    side (fewer at an end), which such a stretch needs no more of."""

    lead = p.least_run - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parted(whole)):
            begin = [batch.column(k).to_numpy() for k in (2, 3)]
            (x, at), (y, other) = ((raw.view("<u4"), offs // 4) for raw, offs in (buffers(batch.column(k)) for k in (4, 5)))
            (da, na), (db, nb), (ref, nr) = (_lists(batch.column(k)) for k in (6, 7, 8))
            own = _lists(batch.column(9))[0]
            heads = np.concatenate([[0], np.cumsum(nr)])
            # every place of one with every place of the other, each pair along all landmarks of the row at once
            row = np.repeat(np.arange(len(na)), na * nb)
            k = np.arange(len(row)) - np.repeat(np.cumsum(na * nb) - na * nb, na * nb)
            da, db = da[(np.cumsum(na) - na)[row] + k // nb[row]], db[(np.cumsum(nb) - nb)[row] + k % nb[row]]
            # where they stand in the place of the first landmark: integers that both have
            low = np.minimum.reduceat(ref, heads[:-1])[row] - lead if len(ref) else row
            high = np.maximum.reduceat(ref + own, heads[:-1])[row] + p.run + lead if len(ref) else row
            low = np.maximum(low, np.maximum(begin[0][row] - da, begin[1][row] - db))
            high = np.minimum(high, np.minimum(begin[0][row] + np.diff(at)[row] - da, begin[1][row] + np.diff(other)[row] - db))
            size = np.maximum(0, high - low)
            first = np.concatenate([[0], np.cumsum(size)])
            step = np.arange(first[-1]) - np.repeat(first[:-1], size)
            place = [np.repeat(starts[:-1][row] + low + d - b[row], size) + step for starts, d, b in ((at, da, begin[0]), (other, db, begin[1]))]
            good = np.bitwise_count(x[place[0]] ^ y[place[1]]) <= p.bit_errors
            # runs of good integers, cut where the next pair begins
            edge = np.ones(len(good) + 1, bool)
            edge[1:-1] = good[1:] != good[:-1]
            edge[first] = True
            cuts = np.flatnonzero(edge)
            length = np.diff(cuts)
            held = np.concatenate([[0], np.cumsum(np.repeat(good[cuts[:-1]] & (length >= p.least_run), length) if len(good) else good, dtype=np.int64)])
            # landmarks that such a run meets
            pair = np.repeat(np.arange(len(row)), nr[row])
            mark = heads[:-1][row][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(nr[row]) - nr[row], nr[row])
            span = [first[pair] + np.clip(ref[mark] + more - low[pair], 0, size[pair]) for more in (0, own[mark] + p.run)]
            votes = np.bincount(pair[held[span[1]] > held[span[0]]], minlength=len(row))
            keep = np.flatnonzero(votes)
            ids = [batch.column(c).take(pa.array(row[keep])) for c in (0, 1)]
            yield pa.RecordBatch.from_arrays([*ids, pa.array((da - db)[keep].astype(np.int32)), pa.array(votes[keep].astype(np.int64))], names=["a", "b", "offset", "votes"])

    return run


def _parted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of pairs in parts of about ``_SLICE`` / 8 integers that are compared, so that repeats take no more memory."""
    moves = [np.diff(batch.column(k).offsets.to_numpy()).astype(np.int64) for k in (6, 7)]
    part = np.cumsum(moves[0] * moves[1] * (buffers(batch.column(4))[1][1:] - buffers(batch.column(4))[1][:-1]) // 4) // (_SLICE >> 3)
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    yield from (batch.slice(x, y - x) for x, y in zip(cuts, cuts[1:]) if x < y)


def _lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all lists, one after another, and how many each has."""
    return col.flatten().to_numpy().astype(np.int64), np.diff(col.offsets.to_numpy()).astype(np.int64)


#: Landmarks whose first places lie in one stretch of so many integers can be one row.
_STRETCH = 64


def _bodies(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """n, packed, meets of the classes that share a landmark with another. Landmarks that are at the same distances from
    each other in the same classes are one meeting of these: a row of ``meets`` has its number, where the landmarks are
    in the class that comes first (``refs``, with the distances of their two runs, ``owns``) and by how much this one is
    moved against it (``moves``, several for repeats)."""
    # one shuffle; equal rows have equal landmarks, which count once; hashes that are equal by chance go with their distances
    marks = rows.select("node", F.explode("marks").alias("mark")).select("node", "mark.hash", "mark.pos", F.col("mark.own").cast("int").alias("own"))
    same = W.partitionBy("hash", "own")
    shared = marks.withColumn("one", F.min("node").over(same)).withColumn("last", F.max("node").over(same)).where("one <> last")
    shared = shared.select("hash", "own", "node", "one", "pos").distinct().withColumn("ref", F.min(F.when(F.col("node") == F.col("one"), F.col("pos"))).over(same))
    shared = shared.withColumn("move", F.col("pos") - F.col("ref"))
    told = [F.bit_xor(F.xxhash64("node", "move")).over(same), F.count("*").over(same)]
    shared = shared.withColumn("meet", F.xxhash64("one", *told, F.floor(F.col("ref") / _STRETCH)))
    each = shared.select("meet", "node", "move", "ref", "own").repartition("node").groupBy("node", "meet", F.floor(F.col("move") / _STRETCH))
    each = each.agg(F.array_sort(F.collect_set("move")).alias("moves"), F.array_sort(F.collect_set(F.struct("ref", "own"))).alias("marks"))
    meets = each.groupBy("node").agg(F.collect_list(F.struct("meet", "moves", F.col("marks.ref").alias("refs"), F.col("marks.own").alias("owns"))).alias("meets"))
    packed = rows.where("n_frames > 0").select("node", "packed").join(meets.hint("merge"), "node").dropDuplicates(["node"])
    return packed.join(classes.select("node", "n").hint("merge"), "node").select("n", "packed", "meets")


def meetings(bodies: DataFrame, params: AudioParams = AudioParams()) -> DataFrame:
    """meet, n, moves, refs, owns, begin, around: a row for each meeting of a class, with the integers around its
    landmarks, from place ``begin`` on."""
    p = params
    at = bodies.select("n", "packed", F.explode("meets").alias("m")).select("n", "packed", "m.*")
    begin = F.greatest(F.lit(0), F.array_min("moves") + F.array_min("refs") - (p.least_run - 1))
    end = F.array_max("moves") + F.array_max(F.zip_with("refs", "owns", lambda x, y: x + y)) + p.run + p.least_run - 1
    around = F.substring(F.col("packed"), begin * 4 + 1, (end - begin) * 4)
    return at.select("meet", "n", "moves", "refs", "owns", begin.alias("begin"), around.alias("around"))


def align(media: DataFrame, id_col: str, media_col: str, decode: Decoder = pcm16, params: AudioParams = AudioParams()) -> DataFrame:
    """doc_id, n_frames, component_id (the smallest id that links reach), links (of the recording's class, all of them),
    partner_id, offset (frames by which the recording runs behind its partner), votes, aligned, bit_error (of its best
    link, by votes; nulls without one); one row a recording."""
    p = params
    rows = stage(fingerprints(media, id_col, media_col, decode, p), "audio-marks")
    # the class is told by one of its rows: the smallest id, of which there may be several equal rows; numbers ascend with
    # the digests, so that ties fall the same way each time
    classes = rows.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("least"))
    classes = classes.orderBy("node").select("node", F.col("least.doc_id").alias("rep"), F.monotonically_increasing_id().alias("n"))
    classes = stage(classes, "audio-classes")
    bodies = stage(_bodies(rows, classes), "audio-bodies")
    placed = meetings(bodies, p)
    here = lambda x: placed.select("meet", *[F.col(c).alias(f"{c}_{x}") for c in placed.columns[1:]])
    # meetings whose numbers are equal by chance go with their landmarks
    met = here("a").join(here("b").hint("merge"), "meet").where("n_a < n_b and refs_a = refs_b and owns_a = owns_b")
    met = met.select("n_a", "n_b", "begin_a", "begin_b", "around_a", "around_b", "moves_a", "moves_b", "refs_a", "owns_a")
    votes = met.mapInArrow(_near(p), "a long, b long, offset int, votes long").repartition("a", "b")
    votes = votes.groupBy("a", "b", "offset").agg(F.sum("votes").alias("votes")).where(F.col("votes") >= p.least_votes)
    links = votes.groupBy("a", "b").agg(F.min(F.struct((-F.col("votes")).alias("less"), "offset", "votes")).alias("m"))
    links = stage(links.select("a", "b", "m.offset", "m.votes"), "audio-links")

    labels = connected(classes.select(F.col("n").alias("node")), links.select("a", "b"), "audio-groups").withColumnRenamed("node", "n")
    parts = stage(labels.join(classes.hint("merge"), "n"), "audio-labels")
    named = parts.groupBy("label").agg(F.min("rep").alias("component_id"))
    turned = links.select(F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("offset")).alias("offset"), "votes")
    best = links.unionByName(turned).groupBy("a").agg(F.count("*").alias("links"), F.min(F.struct((-F.col("votes")).alias("less"), "b", "offset", "votes")).alias("m"))
    best = stage(best.select("a", "links", "m.b", "m.offset", "m.votes"), "audio-best")
    # whole recordings meet for the best link of each, both ways at once: the one that runs behind without what is before
    # the other
    ahead = (F.col("offset") > 0) | (F.col("offset") == 0) & (F.col("a") < F.col("b"))
    pairs = best.select(F.when(ahead, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("b"), F.abs("offset").alias("offset")).distinct()
    both = pairs.join(bodies.select(F.col("n").alias("a"), F.col("packed").alias("x")).hint("merge"), "a").select("a", "b", F.expr("substring(x, offset * 4 + 1)").alias("x"))
    both = both.join(bodies.select(F.col("n").alias("b"), F.col("packed").alias("y")).hint("merge"), "b").select("a", "b", "x", "y", F.lit(0).alias("offset"))
    told = both.mapInArrow(_agreements(p), "a long, b long, aligned int, bit_error double")
    told = best.withColumn("x", F.least("a", "b")).withColumn("y", F.greatest("a", "b")).join(told.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "aligned", "bit_error").hint("merge"), ["x", "y"])
    told = told.join(classes.select(F.col("n").alias("b"), F.col("rep").alias("partner_id")).hint("merge"), "b").drop("b", "x", "y").withColumnRenamed("a", "n")
    found = parts.join(named.hint("merge"), "label").select("n", "node", "component_id").join(told.hint("merge"), "n", "left").drop("n")
    out = rows.select("doc_id", "n_frames", "node").join(stage(found, "audio-components").hint("merge"), "node", "left")
    alone = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_frames", alone.alias("component_id"), F.coalesce("links", F.lit(0)).alias("links"), "partner_id", "offset", "votes", "aligned", "bit_error")


# ---- the test tables hold no sound: texts are played as notes

_INSIDE, _FOLDED = word_mask(SPACE)


def notes(p: AudioParams = AudioParams()) -> Decoder:
    """Plays a text: a phrase ends after a word in four (by its hash, so that equal passages have equal phrases), and is
    a tone of one hop whose pitch its words choose."""
    t = np.arange(p.hop) / p.rate
    tones = np.sin(2 * np.pi * p.low * 2 ** (np.arange(24)[:, None] / 12) * t).astype(np.float32)

    def decode(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = words(raw, offs, _INSIDE)
        h = hashes(raw, w, _FOLDED)
        if not len(h):
            return np.zeros(0, np.float32), np.zeros(len(offs), np.int64)
        stop = (h >> np.uint64(40)) % np.uint64(4) == 0
        stop[w.first[1:][np.diff(w.first) > 0] - 1] = True
        heads = np.concatenate([[0], np.flatnonzero(stop)[:-1] + 1])
        pitch = mix64(np.add.reduceat(h, heads)) % np.uint64(24)
        first = np.searchsorted(heads, w.first)
        return tones[pitch.astype(np.int64)].ravel(), first * p.hop

    return decode
