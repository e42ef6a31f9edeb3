"""Phrases of a dictionary in texts: one pass over the texts, however many phrases there are.

An automaton holds all phrases in flat arrays: edges as sorted keys, for each node the node of its longest proper suffix
(where to go on when no edge fits) and the next shorter phrase that ends there. Texts are cut into lanes that overlap by
the longest phrase, and all lanes of a batch take each step together. The arrays are broadcast under a byte limit; a
dictionary beyond it becomes several automata, each with a pass of its own, before matches are chosen from all of them.

Of what is found, matches are chosen from the left: the longest phrase at a place, unless a safe phrase covers it and
more. Letters and digits that are not Han must not go on beside a match.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Code points from here on are no letters of words between spaces.
_HAN = 0x2E80
_LANE = 512
_BITS = 21


@cache
def _word_codes() -> np.ndarray:
    return np.array([chr(c).isalnum() for c in range(_HAN)] + [False])


def folded(text: str) -> str:
    """In lower case, each character by one."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


class Automaton:
    """All places of some phrases (of one character or more, as ``folded`` writes them)."""

    def __init__(self, phrases: Sequence[str]) -> None:
        edges: dict[int, int] = {}
        depth, word, below = [0], [-1], [[]]
        for k, phrase in enumerate(phrases):
            at = 0
            for code in map(ord, phrase):
                key = at << _BITS | code
                if (then := edges.get(key)) is None:
                    then = edges[key] = len(depth)
                    below[at].append((code, then))
                    depth.append(depth[at] + 1)
                    word.append(-1)
                    below.append([])
                at = then
            if at:
                word[at] = k
        suffix, shorter = [0] * len(depth), [0] * len(depth)
        for at in sorted(range(len(depth)), key=depth.__getitem__):
            for code, then in below[at]:
                back = suffix[at]
                while at and back and (back << _BITS | code) not in edges:
                    back = suffix[back]
                found = edges.get(back << _BITS | code, 0) if at else 0
                suffix[then] = found
                shorter[then] = found if word[found] >= 0 else shorter[found]
        keys = np.fromiter(edges, np.int64, len(edges))
        order = np.argsort(keys)
        self.keys, self.to = keys[order], np.fromiter(edges.values(), np.int32, len(edges))[order]
        self.suffix, self.shorter, self.word = (np.array(x, np.int32) for x in (suffix, shorter, word))
        self.length = np.array([len(x) for x in phrases], np.int32)
        self.longest = max(map(len, phrases), default=0)

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.keys, self.to, self.suffix, self.shorter, self.word, self.length))

    def _next(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(state), np.int32), np.arange(len(state))
        while len(open_):
            want = state[open_].astype(np.int64) << _BITS | code[open_]
            at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            hit = self.keys[at] == want
            out[open_[hit]] = self.to[at[hit]]
            open_ = open_[~hit & (state[open_] > 0)]
            state[open_] = self.suffix[state[open_]]
        return out

    def find(self, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, phrase) of all places in the texts between ``bounds`` of one array of code points."""
        none = np.zeros(0, np.int64)
        if not len(self.keys) or not len(codes):
            return none, none, none
        sizes = np.diff(bounds)
        lanes = -(-sizes // _LANE)
        text = np.repeat(np.arange(len(sizes)), lanes)
        own = bounds[text] + (np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * _LANE
        stop, begin = np.minimum(own + _LANE, bounds[text + 1]), np.maximum(own - self.longest + 1, bounds[text])
        order = np.argsort(begin - stop, kind="stable")
        own, stop, begin = own[order], stop[order], begin[order]
        active = np.searchsorted(begin - stop, -np.arange(int((stop - begin).max(initial=0))), "left")
        state, ends, nodes = np.zeros(len(own), np.int32), [], []
        says = (self.word >= 0) | (self.shorter > 0)
        for step, n in enumerate(active.tolist()):
            state[:n] = self._next(state[:n].copy(), codes[begin[:n] + step])
            hit = np.flatnonzero(says[state[:n]] & (begin[:n] + step >= own[:n]))
            ends.append(begin[hit] + step + 1)
            nodes.append(state[hit])
        end, node = np.concatenate(ends), np.concatenate(nodes)
        found = []
        while len(node):
            whole = self.word[node] >= 0
            found.append((end[whole], self.word[node[whole]]))
            more = self.shorter[node] > 0
            end, node = end[more], self.shorter[node[more]]
        end, phrase = (np.concatenate([f[k] for f in found]) if found else none for k in (0, 1))
        return end - self.length[phrase], end, phrase


def chosen(codes: np.ndarray, begin: np.ndarray, end: np.ndarray, safe: np.ndarray) -> np.ndarray:
    """Which of the places found (all within texts that lie one after another in ``codes``, in one text each) are matches;
    in order. ``safe`` marks those that only protect."""
    inside = np.concatenate([[False], _word_codes()[np.minimum(codes, _HAN)], [False]])  # one place on
    goes_on = (inside[begin] & inside[begin + 1]) | (inside[end] & inside[end + 1])
    guard = np.flatnonzero(safe)
    guard = guard[np.lexsort((end[guard], begin[guard]))]
    reach = np.maximum.accumulate(np.concatenate([[-1], end[guard]]))
    at = np.flatnonzero(~safe & ~goes_on)
    at = at[np.lexsort((-end[at], begin[at]))]
    at = at[np.concatenate([[True], np.diff(begin[at]) > 0])[: len(at)]]  # the longest at each place
    before = reach[np.searchsorted(begin[guard], begin[at], "left")] >= end[at]
    same = reach[np.searchsorted(begin[guard], begin[at], "right")] > end[at]
    out, free = [], -1
    for i in at[~(before | same)].tolist():
        if begin[i] >= free:
            out.append(i)
            free = end[i]
    return np.array(out, np.int64)


_FOUND = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("phrase", T.IntegerType())]))
_MATCHES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("categories", T.ArrayType(T.StringType()))]))


def _laid_out(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    parts = [folded(t) for t in texts]
    return _codes("".join(parts)), np.cumsum([0, *map(len, parts)])


def _places(automaton, first: int):
    @F.pandas_udf(_FOUND)
    def run(texts: pd.Series) -> pd.Series:
        codes, bounds = _laid_out(texts.fillna(""))
        begin, end, phrase = automaton.value.find(codes, bounds)
        out: list[list[dict]] = [[] for _ in range(len(texts))]
        text = np.searchsorted(bounds, begin, "right") - 1
        for i, a, b, k in zip(text.tolist(), (begin - bounds[text]).tolist(), (end - bounds[text]).tolist(), phrase.tolist()):
            out[i].append({"start": a, "end": b, "phrase": first + k})
        return pd.Series(out, index=texts.index, dtype=object)

    return run


def _choice(categories):
    @F.pandas_udf(_MATCHES)
    def run(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for text, places in zip(texts.fillna(""), found):
            rows = np.array([(x["start"], x["end"], x["phrase"]) for x in places], np.int64).reshape(-1, 3)
            safe = np.array([categories.value[k] is None for k in rows[:, 2].tolist()], bool)
            at = chosen(_codes(folded(text)), rows[:, 0], rows[:, 1], safe)
            out.append([{"start": a, "end": b, "text": text[a:b], "categories": categories.value[k]} for a, b, k in rows[at].tolist()])
        return pd.Series(out, index=texts.index, dtype=object)

    return run


def automata(phrases: Sequence[str], most_bytes: int) -> list[tuple[int, Automaton]]:
    """(place of its first phrase, automaton): one for all phrases if it is within the limit, else one for each half."""
    whole = Automaton(phrases)
    if whole.nbytes <= most_bytes or len(phrases) < 2:
        return [(0, whole)]
    half = len(phrases) // 2
    return automata(phrases[:half], most_bytes) + [(half + k, a) for k, a in automata(phrases[half:], most_bytes)]


def matches(rows: DataFrame, text: str, phrases: dict[str, Iterable[str]], safe: Iterable[str] = (), most_bytes: int = 64 << 20) -> DataFrame:
    """Adds ``matches`` (start, end, text, categories) of the phrases, each with its categories; ``safe`` phrases protect
    what lies within them. Phrases that are equal but for case are one, with the categories of both."""
    told: dict[str, set[str] | None] = {}
    for phrase, kinds in phrases.items():
        if phrase.strip():
            told.setdefault(folded(phrase.strip()), set()).update(kinds)
    guards = [x for x in dict.fromkeys(folded(s) for s in safe) if x]
    both = [x for x in guards if x in told]  # one that is safe and a phrase only protects what is shorter
    names = [*told, *(x for x in guards if x not in told)]
    kinds = [sorted(told[x]) if x in told else None for x in names]
    send = rows.sparkSession.sparkContext.broadcast
    parts = [_places(send(a), k)(F.col(text)) for k, a in automata(names, most_bytes)]
    found: Column = F.concat(*parts) if len(parts) > 1 else parts[0]
    if both:
        twins = {names.index(x): len(names) + i for i, x in enumerate(both)}
        kinds += [None] * len(both)
        double = F.create_map(*[F.lit(v) for pair in twins.items() for v in pair])
        again = F.transform(F.filter(found, lambda x: x["phrase"].isin(*twins)), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.element_at(double, x["phrase"]).alias("phrase")))
        found = F.concat(found, again)
    return rows.withColumn("matches", _choice(send(kinds))(F.col(text), found))
