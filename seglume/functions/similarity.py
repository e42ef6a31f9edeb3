"""How alike two texts are: plain functions, and pandas functions of columns over them."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F


#: Texts of fewer pairs of places than this are compared by the standard library.
SMALL = 1 << 12
_GRAM = 3


def _diagonals(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, length) of all common stretches of ``_GRAM`` or more characters that cannot be made longer."""
    grams = [sum(v[k : len(v) - _GRAM + 1 + k].astype(np.int64) << (21 * k) for k in range(_GRAM)) for v in (x, y)]
    order = np.argsort(grams[1], kind="stable")
    low, high = (np.searchsorted(grams[1], grams[0], side, sorter=order) for side in ("left", "right"))
    n = high - low
    i = np.repeat(np.arange(len(n)), n)
    j = order[np.repeat(low - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
    by = np.lexsort((i, j - i))
    i, j = i[by], j[by]
    first = np.ones(len(i), bool)
    first[1:] = (np.diff(i) != 1) | (np.diff(j) != 1)
    at = np.flatnonzero(first)
    return i[at], j[at], np.diff(np.append(at, len(i))) + _GRAM - 1


def matching_blocks(a: str, b: str) -> list[tuple[int, int, int]]:
    """(i, j, length) of what matches in order: the longest common stretch (the first of several), then the same on both
    sides of it. The blocks of ``SequenceMatcher`` without junk, from all diagonals at once instead of place by place."""

    def library(i: int, s: str, j: int, t: str) -> list[tuple[int, int, int]]:
        return [(i + m.a, j + m.b, m.size) for m in SequenceMatcher(None, s, t, autojunk=False).get_matching_blocks() if m.size]

    if len(a) * len(b) <= SMALL or min(len(a), len(b)) < _GRAM:
        return library(0, a, 0, b)
    x, y = (np.frombuffer(v.encode("utf-32-le", "surrogatepass"), np.uint32) for v in (a, b))
    found, open_ = [], [(0, len(a), 0, len(b), *_diagonals(x, y))]
    while open_:
        alo, ahi, blo, bhi, i, j, n = open_.pop()
        cut = np.maximum(0, np.maximum(alo - i, blo - j))
        i, j, n = i + cut, j + cut, n - cut
        n = np.minimum(n, np.minimum(ahi - i, bhi - j))
        keep = n >= _GRAM
        i, j, n = i[keep], j[keep], n[keep]
        if not len(n):
            found += library(alo, a[alo:ahi], blo, b[blo:bhi]) if alo < ahi and blo < bhi else []
            continue
        top = np.lexsort((j, i, -n))[0] if len(n) > 1 else 0
        p, q, size = int(i[top]), int(j[top]), int(n[top])
        found.append((p, q, size))
        before, after = (i < p) & (j < q), (i + n > p + size) & (j + n > q + size)
        open_ += [(alo, p, blo, q, i[before], j[before], n[before]), (p + size, ahi, q + size, bhi, i[after], j[after], n[after])]
    return sorted(found)


def matched(a: str, b: str) -> int:
    """Characters that match in order."""
    return sum(n for _, _, n in matching_blocks(a, b))


def ratio(a: str, b: str) -> float:
    """Twice the matching characters over all characters, matches in order (longest blocks first)."""
    return 2.0 * matched(a, b) / (len(a) + len(b)) if a or b else 0.0


#: Texts of up to so many characters are compared many pairs at a time if there are so many pairs at least, with so many
#: cells of their tables at once.
WIDE, MANY, _CELLS = 64, 16, 1 << 21


def _matched(x: np.ndarray, y: np.ndarray, a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> np.ndarray:
    """``matched`` of many pairs: a and b are (row of x or y, length) of each. All longest stretches at once, then all that
    stand before or after them."""
    total, pair = np.zeros(len(a[0]), np.int64), np.arange(len(a[0]))
    (at_a, n_a), (at_b, n_b) = (((row * v.shape[1]), n) for v, (row, n) in ((x, a), (y, b)))
    flat = [np.concatenate([v.ravel(), np.zeros(v.shape[1], v.dtype)]) for v in (x, y)]
    while len(pair):
        # characters down, pairs across; 0 and 1 are no characters, so what lies beyond a text is equal to nothing
        sides = []
        for k, (v, at, n) in enumerate(((flat[0], at_a, n_a), (flat[1], at_b, n_b))):
            place = np.arange(int(n.max()))[:, None]
            sides.append(np.where(place < n, v[at + place], v.dtype.type(k)))
        p, q = sides
        run = np.zeros((len(p), len(q), len(pair)), np.uint8)  # of the stretch that ends at both places
        for i in range(len(p)):
            same = p[i] == q
            run[i] = same
            if i:
                run[i, 1:] += run[i - 1, :-1] * same[1:]
        best = run.max(axis=1)
        end_a = best.argmax(axis=0)  # the first of several
        across = np.arange(len(pair))
        end_b = run[end_a, :, across].argmax(axis=1)
        size = best[end_a, across].astype(np.int64)
        np.add.at(total, pair, size)
        parts = [(pair, at_a, end_a + 1 - size, at_b, end_b + 1 - size), (pair, at_a + end_a + 1, n_a - end_a - 1, at_b + end_b + 1, n_b - end_b - 1)]
        pair, at_a, n_a, at_b, n_b = (np.concatenate(v) for v in zip(*[[v[(size > 0) & (part[2] > 0) & (part[4] > 0)] for v in part] for part in parts]))
    return total


def _coded(texts: list[list[str]]) -> list[np.ndarray]:
    """A row of numbers from 2 for each text of up to ``WIDE`` characters, of the smallest type that tells all apart."""
    short = [[t if len(t) <= WIDE else "" for t in side] for side in texts]
    raw = [np.frombuffer("".join(side).encode("utf-32-le", "surrogatepass"), np.uint32) for side in short]
    kinds = np.unique(np.concatenate(raw))
    kind, out = next(k for k in (np.uint8, np.uint16, np.uint32) if len(kinds) + 2 <= np.iinfo(k).max), []
    for side, chars in zip(short, raw):
        n = np.fromiter(map(len, side), np.int64, len(side))
        rows = np.zeros((len(side), max(1, int(n.max(initial=0)))), kind)
        rows[np.arange(rows.shape[1]) < n[:, None]] = np.searchsorted(kinds, chars) + 2
        out.append(rows)
    return out


def ratios(a: list[str], b: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``ratio`` of each a[i] with its b[j]."""
    n_a, n_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    out, x, y = np.zeros(len(i)), *_coded([a, b])
    short = (n_a[i] <= WIDE) & (n_b[j] <= WIDE) & (len(i) >= MANY)
    for k in np.flatnonzero(~short).tolist():
        out[k] = ratio(a[i[k]], b[j[k]])
    several = np.flatnonzero(short & (n_a[i] > 0) & (n_b[j] > 0))
    for lo in range(0, len(several), step := max(1, _CELLS // (x.shape[1] * y.shape[1]))):
        k = several[lo : lo + step]
        p, q = i[k], j[k]
        out[k] = 2.0 * _matched(x, y, (p, n_a[p]), (q, n_b[q])) / (n_a[p] + n_b[q])
    return out


def subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each position of ``a``."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & places.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def stretch(a: str, b: str) -> int:
    """Length of the longest common stretch."""
    best, before = 0, [0] * (len(b) + 1)
    for x in a:
        now = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            if x == y:
                now[j] = before[j - 1] + 1
                best = max(best, now[j])
        before = now
    return best


#: What two short texts count for at least, by what they share: (longest length, length of the shorter at
#: least, what is shared, floor). The first that holds counts.
FLOORS = (
    (6, 2, lambda a, b: a in b or b in a, 0.82),
    (5, 1, lambda a, b: stretch(a, b) >= 2, 0.75),
    (5, 1, lambda a, b: subsequence(a, b) >= 2, 0.68),
)
#: Texts of up to so many characters lose a fixed part for lengths more than one apart; longer ones lose by
#: the part of the longer length, beyond a share that is free.
SHORT, SHORT_LOSS, FREE_SHARE, LOSS = 5, 0.15, 0.25, 2.0


def length_factor(a: int, b: int) -> float:
    """What is left of a likeness after the difference of lengths."""
    apart, longest = abs(a - b), max(a, b)
    if longest <= SHORT:
        return 1.0 if apart <= 1 else 1.0 - SHORT_LOSS
    return min(1.0, max(0.0, 1.0 - LOSS * (apart / longest - FREE_SHARE)))


def piece_similarity(a: str | None, b: str | None) -> float:
    """``ratio`` by ``length_factor``; short texts are helped by what they share (``FLOORS``)."""
    if not a or not b or a == b:
        return float(bool(a) and a == b)
    likeness, (short, long_) = ratio(a, b), sorted(map(len, (a, b)))
    floor = next((least for most, shortest, shared, least in FLOORS if long_ <= most and short >= shortest and shared(a, b)), None)
    return likeness * length_factor(short, long_) if floor is None else max(likeness, floor)


def similarity_bound(a: str, b: str) -> float:
    """No less than ``piece_similarity``, without its search: matches in order are a common subsequence, so its longest
    bounds them (a machine word for 64 characters at a time)."""
    longest = max(len(a), len(b))
    if not a or not b or longest <= FLOORS[0][0]:
        return 1.0
    free = length_factor(len(a), len(b))
    return free * 2 * subsequence(a, b) / (len(a) + len(b)) if free else 0.0


#: Common characters that alone say nothing.
STOP_CHARACTERS = set("的了是我你他她它们在不有就也都这那啊吗呢吧")
#: Lengths of source and text at which a short match is tried.
SHORT_SOURCE, SHORT_TEXT, SOURCE_OF_SHORT_TEXT = 5, 4, 7
#: What two short texts must show, by the longer one's length: (up to this length, bar).
BARS = ((3, 1.5), (float("inf"), 2.5))
#: How much more the source after it must show to take a text away.
RIVAL = 1.5


def evidence(text: str, source: str) -> float:
    """What speaks for a text being its source: a point for each character in order, one more for each that follows its
    neighbour directly, half a point for a character that means something (of tiny texts also for equal ends)."""
    points = subsequence(text, source) + max(0, stretch(text, source) - 1)
    if not points:
        return 0.0
    telling = not STOP_CHARACTERS.issuperset(set(text) & set(source))
    ends = max(len(text), len(source)) <= BARS[0][0] and (text[0] == source[0] or text[-1] == source[-1])
    return points + 0.5 * (telling or ends)


def short_match(text: str, source: str, following: str | None = None, short: int = SHORT_SOURCE) -> bool:
    """Whether a short text may stand for the source that is its turn: enough ``evidence`` for their length, and not much
    more for the source after it."""
    if not text or not source or not (len(source) <= short or (len(text) <= SHORT_TEXT and len(source) <= SOURCE_OF_SHORT_TEXT)):
        return False
    own, longest = evidence(text, source), max(len(text), len(source))
    bar = next(bar for most, bar in BARS if longest <= most)
    return own >= bar and evidence(text, following or "") < own + RIVAL


def partial_ratio(a: str, b: str) -> float:
    """The best ``ratio`` of the shorter text with any stretch of its length of the longer one."""
    short, long_ = sorted((a, b), key=len)
    if not short:
        return 0.0
    if short in long_:
        return 1.0
    starts = {max(0, m.b - m.a) for m in SequenceMatcher(None, short, long_, autojunk=False).get_matching_blocks() if m.size}
    return max((ratio(short, long_[i : i + len(short)]) for i in starts), default=0.0)


#: Sounds that are easily confused, initials then finals, as (said, taken for).
CONFUSED_INITIALS = (("zh", "z"), ("ch", "c"), ("sh", "s"), ("n", "l"), ("f", "h"), ("r", "l"))
CONFUSED_FINALS = (("ang", "an"), ("eng", "en"), ("ing", "in"), ("uang", "uan"))


def sound_key(syllables: str) -> tuple[str, str]:
    """Syllables in Latin letters, spaced, with confusable sounds merged; and their initials."""
    out = []
    for s in syllables.lower().split():
        for said, taken in CONFUSED_INITIALS:
            if s.startswith(said):
                s = taken + s[len(said) :]
                break
        for said, taken in CONFUSED_FINALS:
            if s.endswith(said):
                s = s[: -len(said)] + taken
                break
        out.append(s)
    return " ".join(out), "".join(s[:1] for s in out)


def sound_similarity(a: str, b: str) -> float:
    """Seven parts the syllables, three parts their initials."""
    (x, i), (y, j) = sound_key(a), sound_key(b)
    return 0.7 * ratio(x, y) + 0.3 * ratio(i, j)


def blended(a: str, b: str, sounds: Callable[[str], str] = lambda x: " ".join(x)) -> float:
    """45 parts likeness, 40 parts sound, 15 parts length; ``sounds`` spells a text (each character by default)."""
    if not a or not b:
        return 0.0
    return 0.45 * ratio(a, b) + 0.4 * sound_similarity(sounds(a), sounds(b)) + 0.15 * min(len(a), len(b)) / max(len(a), len(b))


def of_columns(function: Callable[[str, str], float]) -> Callable[[Column, Column], Column]:
    """A function of two texts for columns; nulls count as empty."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float(function(x, y)) for x, y in zip(a.fillna(""), b.fillna(""))])

    return run
