"""Ordered folds: rules in which each decision depends on the ones before it.

``fold`` deals rows by project, sorts them within the tasks and hands each project's rows to a generator as a stream. A
generator that keeps a few numbers runs in constant memory, however many rows a project has; those that look at a whole
project (``borrow``, ``pause_chunks``) say so.

Times are integer milliseconds. Rows come as dictionaries in the order of ``order``; what is yielded are tuples without
the key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

Rule = Callable[[Iterable[dict]], Iterator[tuple]]
_ROWS_OUT = 4096


def fold(rows: DataFrame, rule: Rule, schema: str, key: str = "project", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The key and what ``rule`` yields for each key's rows in order; ``schema`` names the yielded columns."""
    kind = StructType([rows.schema[key], *StructType.fromDDL(schema)])
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (r for batch in batches for r in batch.to_pylist())
        held: list[tuple] = []
        for value, own in groupby(stream, key=lambda r: r[key]):
            for out in rule(own):
                held.append((value, *out))
                if len(held) == _ROWS_OUT:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, kind)


# ---- cutting and packing

def word_groups(rows: Iterable[dict], long_gap: int = 750, least: int = 5, many: int = 24, short_gap: int = 280) -> Iterator[tuple]:
    """Words (start_ms, end_ms, text) into segments: a cut at a long pause after five words, or at a short one after
    24. Yields (group, start_ms, end_ms, n, text); none is shorter than 150 ms."""
    group, held = 1, []
    for r in rows:
        if held:
            gap = r["start_ms"] - held[-1]["end_ms"]
            if (gap >= long_gap and len(held) >= least) or (gap >= short_gap and len(held) >= many):
                yield _group(group, held)
                group, held = group + 1, []
        held.append(r)
    if held:
        yield _group(group, held)


def _group(number: int, held: list[dict]) -> tuple:
    start = held[0]["start_ms"]
    return number, start, max(held[-1]["end_ms"], start + 150), len(held), " ".join(r["text"] or "" for r in held)


def pack_batches(size: int = 300, max_chars: int = 50_000) -> Rule:
    """Batches of at most ``size`` rows and ``max_chars`` characters (one longer row is a batch of its own). Yields (seq,
    batch)."""

    def rule(rows: Iterable[dict]) -> Iterator[tuple]:
        batch, n, chars = 1, 0, 0
        for r in rows:
            own = r["chars"]
            if n and (n >= size or chars + own > max_chars):
                batch, n, chars = batch + 1, 0, 0
            n, chars = n + 1, chars + own
            yield r["seq"], batch

    return rule


def speaker_turns(gap_ms: int = 850) -> Rule:
    """Rows with a voice (raw_ms not null) whose speaker is the one before them, and who begin within ``gap_ms`` of the
    end so far, join a turn. Yields (seq, turn, offset_ms): where the voice begins in the turn's recording, with a pause
    of at most ``gap_ms`` between two. The first row counts even without a voice."""

    def rule(rows: Iterable[dict]) -> Iterator[tuple]:
        turn, speaker, end, at = 0, None, 0, 0
        for r in rows:
            if turn and r["raw_ms"] is None:
                continue
            name = (r["speaker"] or "").strip().lower()
            gap = r["start_ms"] - end
            if turn and name and name == speaker and gap < gap_ms:
                at += min(max(gap, 0), gap_ms)
                end = max(end, r["end_ms"])
            else:
                turn, speaker, end, at = turn + 1, name, r["end_ms"], 0
            yield r["seq"], turn, at
            at += r["raw_ms"] or 0

    return rule


def clusters(tolerance: float) -> Rule:
    """Sorted values: each goes into the first cluster whose mean is within the tolerance. Yields (seq, cluster)."""

    def rule(rows: Iterable[dict]) -> Iterator[tuple]:
        found: list[list] = []  # sum, n
        for r in rows:
            v = r["value"]
            for i, (total, n) in enumerate(found):
                if abs(v - total / n) <= tolerance:
                    found[i] = [total + v, n + 1]
                    yield r["seq"], i + 1
                    break
            else:
                found.append([v, 1])
                yield r["seq"], len(found)

    return rule


# ---- merging and stitching

_STOPS = "。！？!?."
_MARKS = "，。！？,.!?"


def merge_fragments(gap_ms: int = 80, micro: int = 3, most: int = 20) -> Rule:
    """Joins fragments of at most three characters to their neighbour when there is hardly a gap, neither sentence has
    ended and the whole stays short. Yields (seq, start_ms, end_ms, text, confidence); a negative confidence is unknown."""

    def rule(rows: Iterable[dict]) -> Iterator[tuple]:
        held, n = None, 0
        for r in rows:
            cur = {"s": r["start_ms"], "e": r["end_ms"], "t": (r["text"] or "").strip(), "c": r["confidence"]}
            if held:
                a, b = held["t"].rstrip(_MARKS), cur["t"].rstrip(_MARKS)
                open_ = not held["t"] or held["t"][-1] not in _STOPS
                small = (0 < len(a) <= micro and open_) or (0 < len(b) <= micro and cur["t"][-1] not in _STOPS)
                if 0 <= cur["s"] - held["e"] <= gap_ms and open_ and small and len(a) + len(b) <= most:
                    known = held["c"] >= 0 and cur["c"] >= 0
                    held = {"s": held["s"], "e": max(held["e"], cur["e"]), "t": held["t"] + cur["t"], "c": round((held["c"] + cur["c"]) / 2, 4) if known else held["c"]}
                    continue
                n += 1
                yield n, held["s"], held["e"], held["t"], held["c"]
            held = cur
        if held:
            yield n + 1, held["s"], held["e"], held["t"], held["c"]

    return rule


def join_chunks(repeat_ms: int = 1500, trim_ms: int = 400, least_ms: int = 80) -> Rule:
    """Rows of overlapping chunks, already owned by one chunk each: drops a repeated text close to the one before, and
    settles an overlap by shortening the row before (a small one) or beginning later. Yields (seq, start_ms, end_ms,
    text)."""

    def rule(rows: Iterable[dict]) -> Iterator[tuple]:
        held, n = None, 0
        for r in rows:
            cur = [r["start_ms"], r["end_ms"], r["text"]]
            if held:
                if cur[2] == held[2] and abs(cur[0] - held[0]) < repeat_ms:
                    continue
                if cur[0] < held[1]:
                    if held[1] - cur[0] < trim_ms:
                        held[1] = max(held[0] + least_ms, cur[0])
                    else:
                        cur[0] = held[1]
                n += 1
                yield n, *held
            held = cur
        if held:
            yield n + 1, *held

    return rule


def split_overlaps(gap_ms: int = 20, least_ms: int = 300) -> Rule:
    """Overlapping neighbours part at the middle of their overlap, with a small gap; none gets shorter than ``least_ms``.
    Yields (seq, start_ms, end_ms)."""

    def rule(rows: Iterable[dict]) -> Iterator[tuple]:
        held = None
        for r in rows:
            s, e = r["start_ms"], r["end_ms"]
            if e <= s:
                e = s + 500
            if held:
                if s < held[2]:
                    middle = (held[2] + s) // 2
                    held[2] = max(held[1] + least_ms, middle - gap_ms // 2)
                    s = min(e - least_ms, middle + gap_ms // 2)
                yield tuple(held)
            held = [r["seq"], s, e]
        if held:
            yield tuple(held)

    return rule


def stitch(cut_ms: int = 2500, near_ms: int = 1500, beyond_ms: int = 5000, least_ms: int = 300) -> Rule:
    """Chunks (chunk, window_start, window_end of its overlap with the one before) into one stream. If the last row so
    far ends near the overlap's end it may be cut: the row of the new chunk that holds its text, begins like it or
    begins near it takes its place. Rows that end before the stream's end go; one that reaches into it is clipped.
    Keeps one chunk's rows at a time. Yields (seq, start_ms, end_ms, text)."""

    def rule(rows: Iterable[dict]) -> Iterator[tuple]:
        last, n = None, 0
        for _, own in groupby(rows, key=lambda r: r["chunk"]):
            new = [[r["start_ms"], r["end_ms"], r["text"] or "", r["window_end"]] for r in own]
            begin = 0
            if last:
                text = last[2].strip().lower()
                cut = last[1] >= new[0][3] - cut_ms
                for i, r in enumerate(new):
                    if r[0] > r[3] + beyond_ms:
                        break
                    other = r[2].strip().lower()
                    near = abs(last[0] - r[0]) <= near_ms
                    if cut and (text in other or (len(text) >= 3 and other.startswith(text[: max(3, len(text) // 2)])) or near):
                        last, begin = r, i + 1
                        break
                    if near or text == other:
                        begin = i + 1
            for r in new[begin:]:
                if last and r[1] <= last[1]:
                    continue
                if last and r[0] < last[1]:
                    if r[1] - last[1] < least_ms:
                        continue
                    r[0] = last[1] + 20
                if last:
                    n += 1
                    yield n, *last[:3]
                last = r
        if last:
            yield n + 1, *last[:3]

    return rule


def look_ahead(score: Callable[[str, str], float], most: int = 6, gap_ms: int = 1150, longer: int = 3, gain: float = 0.04) -> Rule:
    """A row takes in up to six that follow (small gaps, not much longer than its block's text) for as long as that makes
    it more like the block. Keeps seven rows. Yields (seq, last_seq, text, score)."""

    def rule(rows: Iterable[dict]) -> Iterator[tuple]:
        stream, queue = iter(rows), []

        def fill() -> None:
            while len(queue) <= most and (r := next(stream, None)) is not None:
                queue.append(r)

        fill()
        while queue:
            first = queue[0]
            best = (score(first["text"], first["block"]), 1, first["text"])
            text, end = first["text"], first["end_ms"]
            for i, r in enumerate(queue[1:], 2):
                text += r["text"]
                if r["start_ms"] - end > gap_ms or len(text) > len(first["block"]) + longer:
                    break
                end = r["end_ms"]
                if (s := score(text, first["block"])) >= best[0] + gain:
                    best = (s, i, text)
            yield first["seq"], queue[best[1] - 1]["seq"], best[2], best[0]
            del queue[: best[1]]
            fill()

    return rule


# ---- rules over a whole project

@dataclass(frozen=True)
class PauseCuts:
    target_ms: int = 180_000
    target_rows: int = 140
    least: int = 16


def pause_chunks(p: PauseCuts = PauseCuts()) -> Rule:
    """Chunks cut at natural pauses: near the place where a chunk is full, the best cut by gap, less 0.015 a row of
    distance, with two more for a real pause. Holds a project's times. Yields (chunk, first_seq, last_seq)."""

    def rule(rows: Iterable[dict]) -> Iterator[tuple]:
        t = [(r["seq"], r["start_ms"], r["end_ms"]) for r in rows]
        tail, at, chunk = max(10, p.least - 4), 0, 0
        while at < len(t):
            chunk += 1
            end = len(t)
            if end - at >= p.least + tail:
                full = _full(t, at, p)
                if full is not None and len(t) - full >= tail:
                    low, high = max(at + p.least, full - 12), min(len(t) - tail, full + 18)
                    gap = lambda i: t[i][1] - t[i - 1][2]
                    worth = lambda i: gap(i) - 15 * abs(i - full) + (2000 if gap(i) >= 850 else 0)
                    end = max(range(low, high + 1), key=lambda i: (worth(i), -i)) if low < high else max(at + p.least, min(len(t) - tail, full))
            yield chunk, t[at][0], t[end - 1][0]
            at = end

    return rule


def _full(t: list[tuple], at: int, p: PauseCuts) -> int | None:
    """Where a chunk that begins at ``at`` is full; long silences count as 800 ms."""
    active = max(200, t[at][2] - t[at][1])
    for k in range(at + 1, len(t)):
        gap = max(0, t[k][1] - t[k - 1][2])
        active += (gap if gap < 10_000 else 800) + max(100, t[k][2] - t[k][1])
        if k - at >= p.least and (active >= p.target_ms or k - at >= p.target_rows):
            return k
    return None


def borrow(ratio: float = 1.3) -> Rule:
    """Rows whose voice (raw_ms) is too long for their slot borrow time from the rows beside them, the neediest first:
    half from each side, then what is missing from either. What a row can spare shrinks as it lends. Holds a project's
    rows. Yields (seq, from_before, from_after)."""

    def rule(rows: Iterable[dict]) -> Iterator[tuple]:
        t = list(rows)
        need, spare = [0.0] * len(t), [0.0] * len(t)
        for i, r in enumerate(t):
            slot, raw = max(100, r["end_ms"] - r["start_ms"]), r["raw_ms"] or 0
            if raw <= 0:
                continue
            excess = max(0, round(raw - slot * 1.2))
            head = round(excess / 3)
            wanted = max(100, raw - min(100, head) - min(200, excess - head)) / ratio
            if wanted > slot:
                need[i] = wanted - slot
            else:
                spare[i] = max(0.0, slot - raw / ratio)
        got = [[0.0, 0.0] for _ in t]
        for i in sorted((i for i in range(len(t)) if need[i] > 5), key=lambda i: (-need[i], i)):
            sides = [(k, j) for k, j in ((0, i - 1), (1, i + 1)) if 0 <= j < len(t)]
            for share in (need[i] / len(sides), None) if sides else ():
                for k, j in sides:
                    left = need[i] - sum(got[i])
                    take = min(spare[j], left if share is None else share)
                    if take > 0 and left > 5:
                        got[i][k] += take
                        spare[j] -= take
        for r, (a, b) in zip(t, got):
            yield r["seq"], round(a), round(b)

    return rule


def sync_to_waveform(least_ms: int = 300) -> Rule:
    """Places the parts of a fitted voice (part_start and part_end within the raw recording, cut_ms taken off its head,
    speed_pct, slot_start) on the timeline, in order and none shorter than ``least_ms``. Yields (seq, start_ms,
    end_ms)."""

    def rule(rows: Iterable[dict]) -> Iterator[tuple]:
        end = None
        for r in rows:
            at = lambda x: r["slot_start"] + max(0, x - r["cut_ms"]) * 100 // r["speed_pct"]
            s = at(r["part_start"]) if end is None else max(end, at(r["part_start"]))
            e = max(s + least_ms, at(r["part_end"]))
            end = e
            yield r["seq"], s, e

    return rule
