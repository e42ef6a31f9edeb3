"""Monotone alignment of two text sequences: which source segments each item of a script was made of.

A group is a batch of a project (a bounded number of rows by ``pack_batches``), so groups are many and small; both sides
are cogrouped and aligned by one state machine, which walks the items in order:

* window: the next few unused sources, and runs of up to ``span`` of them;
* score: ``piece_similarity`` of the item's source text with the run's (0 where it cannot reach the threshold, which a bound
  tells without the search);
* verdict: ``clear`` at the threshold with a margin to the best run elsewhere, ``tie`` without the margin, ``low`` below;
* a clear run is taken; a tie is taken at the place whose turn it is; a low one is looked for further ahead once several
  items have failed (a strong match, by a margin), else waits;
* what stays unused between two items' sources goes to the item around it, to the shorter neighbour, or is flagged.

The result always keeps order and never uses a source twice; ``lineage.verify`` checks both.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from seglume.functions.similarity import piece_similarity, short_match, similarity_bound

KEY = ["project", "batch"]
SCHEMA = "project long, batch long, item long, src array<long>, score double, verdict string, flags array<string>, dropped array<long>"


@dataclass(frozen=True)
class AlignParams:
    window: int = 8
    span: int = 3
    clear: float = 0.58
    margin: float = 0.15
    failures: int = 3
    resync: float = 0.80
    resync_margin: float = 0.25
    #: A run between two items that goes to one of them is at most this long.
    absorb: int = 4
    #: Items that found nothing get a share of the sources left between trusted neighbours, if those are no more.
    sandwich: int = 10


@dataclass
class _Item:
    item: int
    text: str
    src: list[int]
    score: float = 0.0
    verdict: str = "low"
    flags: tuple[str, ...] = ()
    dropped: tuple[int, ...] = ()


def _runs(texts: list[str], begin: int, end: int, span: int) -> Iterator[tuple[int, int]]:
    for a in range(begin, end):
        for n in range(1, min(span, len(texts) - a) + 1):
            yield a, a + n


def _best(text: str, texts: list[str], begin: int, end: int, p: AlignParams, bar: float) -> tuple[float, int, int, float]:
    """Best score, its run, and the best score of a run that does not overlap it; scores below ``bar`` count as 0.

    Runs are scored from the highest ``similarity_bound`` down, and only as long as a bound can still change the result:
    reach the bar and the best so far, or, beside the best run, come nearer to it than any margin asks."""
    bounds = sorted(((similarity_bound(text, t), a, b) for a, b in _runs(texts, begin, end, p.span) if (t := "".join(texts[a:b]))), key=lambda x: (-x[0], x[1:]))
    known: dict[tuple[int, int], float] = {}

    def score(a: int, b: int) -> float:
        if (a, b) not in known:
            known[a, b] = piece_similarity(text, "".join(texts[a:b]))
        return known[a, b]

    top, at = 0.0, (begin, begin)
    for bound, a, b in bounds:
        if bound < max(top, bar):
            break
        own = score(a, b)
        if own >= bar and (own, -a, -b) > (top, -at[0], -at[1]):
            top, at = own, (a, b)
    if not top:
        return 0.0, begin, begin, 0.0
    other, near = 0.0, top - max(p.margin, p.resync_margin)
    for bound, a, b in bounds:
        if bound < max(other, near):
            break
        if b <= at[0] or a >= at[1]:
            other = max(other, score(a, b))
    return top, *at, other


def align_batch(items: list[tuple[int, str]], sources: list[tuple[int, str]], p: AlignParams = AlignParams()) -> list[_Item]:
    """Items (number, source text as the script quotes it) against sources (number, text), both in order."""
    texts, at, failed, out = [t for _, t in sources], 0, 0, []
    for number, text in items:
        row = _Item(number, text, [])
        score, a, b, other = _best(text, texts, at, min(len(texts), at + p.window), p, p.clear)
        if score >= p.clear:
            row.verdict = "clear" if score - other >= p.margin else "tie"
            if row.verdict == "tie" and a > at and piece_similarity(text, texts[at]) >= p.clear:
                a, b = at, at + 1  # the one whose turn it is
        elif at < len(texts) and short_match(text, texts[at], texts[at + 1] if at + 1 < len(texts) else None):
            score, a, b, row.verdict = max(score, p.clear), at, at + 1, "clear"
        elif failed >= p.failures:
            score, a, b, other = _best(text, texts, at, len(texts), p, p.resync)
            row.verdict = "clear" if score >= p.resync and score - other >= p.resync_margin else "low"
        row.score = score
        if row.verdict == "low":
            failed += 1
            row.flags = ("LOW_MATCH",)
        else:
            failed, row.src = 0, list(range(a, b))
            row.flags = ("TIE",) if row.verdict == "tie" and score < p.resync else ()
            at = b
        out.append(row)
    _share(out, len(texts), p)
    _settle(out, texts, p)
    for row in out:
        row.src = [sources[i][0] for i in row.src]
        row.dropped = tuple(sources[i][0] for i in row.dropped)
    return out


def _share(rows: list[_Item], n: int, p: AlignParams) -> None:
    """Items without sources between two that have some divide what lies between, by length."""
    i = 0
    while i < len(rows):
        if rows[i].src:
            i += 1
            continue
        j = i
        while j < len(rows) and not rows[j].src:
            j += 1
        low = rows[i - 1].src[-1] + 1 if i else 0
        high = rows[j].src[0] if j < len(rows) else n
        free = high - low
        if j - i <= p.sandwich and j - i <= free <= p.sandwich * p.span:
            total, spent = sum(max(1, len(r.text)) for r in rows[i:j]), 0
            for k, r in enumerate(rows[i:j]):
                spent += max(1, len(r.text))
                end = low + max(k + 1, min(free - (j - i - k - 1), round(free * spent / total)))
                begin = rows[i + k - 1].src[-1] + 1 if k else low
                r.src, r.verdict, r.flags = list(range(begin, max(begin + 1, end))), "shared", ("soft:SANDWICH",)
        i = j


def _settle(rows: list[_Item], texts: list[str], p: AlignParams) -> None:
    """Sources between two items: into the shorter of the two if they are few, else flagged at the one before."""
    own = [r for r in rows if r.src]
    if not own:
        return
    ends = [None, *own], [*own, None]
    for left, right in zip(*ends):
        low, high = left.src[-1] + 1 if left else 0, right.src[0] if right else len(texts)
        gap = list(range(low, high))
        if not gap:
            continue
        if len(gap) <= p.absorb:
            size = lambda r: len("".join(texts[i] for i in r.src)) / max(1, len(r.text))
            if right is None or (left is not None and size(left) <= size(right)):
                left.src += gap
            else:
                right.src = gap + right.src
        else:
            target = left or right
            target.dropped += tuple(gap)
            target.flags += ("DROPPED_CHUNK",)


def align(items: DataFrame, segs: DataFrame, params: AlignParams = AlignParams()) -> DataFrame:
    """items: project, batch, item, zh (the quoted source); segs: project, batch, seq, text. One row an item."""

    def run(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("item"), b.sort_values("seq")
        found = align_batch(list(zip(a["item"].tolist(), a["zh"].fillna("").tolist())), list(zip(b["seq"].tolist(), b["text"].fillna("").tolist())), params)
        rows = [(key[0], key[1], r.item, r.src, r.score, r.verdict, list(r.flags), list(r.dropped)) for r in found]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    # as many tasks as the session's shuffles have: rows are few and the work on each is long, so sizes say too little
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = items.select("project", "batch", "item", "zh").repartition(tasks, *KEY).groupBy(*KEY)
    right = segs.select("project", "batch", "seq", "text").repartition(tasks, *KEY).groupBy(*KEY)
    return left.cogroup(right).applyInPandas(run, SCHEMA)


def pieces(items: DataFrame) -> DataFrame:
    """project, item, place, piece: the parts of a quoted source between slashes, normalised, without empty ones."""
    from seglume.functions.text import key_text

    parts = F.transform(F.split(F.coalesce("zh", F.lit("")), "/"), lambda x: key_text(x))
    return items.select("project", "item", F.posexplode(F.filter(parts, lambda x: x != "")).alias("place", "piece"))


def trusted(flags: str = "flags", src: str = "src", score: str = "score") -> F.col:
    """An anchor: it has sources, no hard flag, and a good score."""
    from seglume.operators.lineage import HARD

    return (F.size(src) > 0) & ~F.exists(flags, lambda f: f.rlike(HARD)) & (F.col(score) >= 0.7)


def split_at_gaps(items: DataFrame, segs: DataFrame, gap_ms: int = 850) -> DataFrame:
    """Items (project, item, src, text) that span a silent gap part there, text and sources alike: project, item, part,
    src, text. Sources of an item are few; the text is cut by a small function."""
    from seglume.functions.parsing import cut_at_gap
    from seglume.operators.lineage import edges

    rows = edges(items).join(segs.select("project", "seq", "start_ms", "end_ms", F.length("text").alias("chars")), ["project", "seq"])
    own = rows.groupBy("project", "item").agg(F.sort_array(F.collect_list(F.struct("seq", "start_ms", "end_ms", "chars"))).alias("own")).join(items.select("project", "item", "text"), ["project", "item"])

    @F.pandas_udf("array<struct<src:array<long>,text:string>>")
    def cut(own: pd.Series, text: pd.Series) -> pd.Series:
        out = []
        for segs_, body in zip(own, text.fillna("")):
            rest, parts, held = body, [], []
            left = [dict(x) if not isinstance(x, dict) else x for x in segs_]
            for i, s in enumerate(left):
                held.append(s)
                nxt = left[i + 1] if i + 1 < len(left) else None
                if nxt and nxt["start_ms"] - s["end_ms"] >= gap_ms:
                    two = cut_at_gap(rest, sum(x["chars"] for x in held), sum(x["chars"] for x in left[i + 1 :]))
                    if two:
                        parts.append({"src": [x["seq"] for x in held], "text": two[0]})
                        rest, held = two[1], []
            parts.append({"src": [x["seq"] for x in held], "text": rest})
            out.append(parts)
        return pd.Series(out, dtype=object)

    return own.select("project", "item", F.posexplode(cut("own", "text")).alias("part", "p")).select("project", "item", "part", "p.src", "p.text")
