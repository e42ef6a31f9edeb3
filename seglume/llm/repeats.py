"""Repeated passages by bucket-pointer refinement of suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts earlier: in a document with a smaller id, or
before it in the same one. Suffixes fall into buckets by their first q bytes; a bucket of one is done, and the others are
refined by the bucket identifiers of later offsets: an identifier for 93 bytes is made of those for 37 bytes at offsets
0, 37 and 56, one for 100 bytes of those for 93 at 0 and 7, and so on down. An identifier is a hash of what it stands
for, so it is the same on every executor and no sorted array of all suffixes is needed.

Nor is a row a byte. Windows of ``length`` bytes that follow each other share an anchor, the place in them whose first
bytes hash least; equal windows have equal anchors at equal distances, whatever stands around them. So a row is an anchor
with the windows that are its own (a cell of distances). Its bucket holds the bytes that all windows of the cell have in
common (core), and finer, all bytes that its windows cover (context):

* a core that is found once: none of the windows is anywhere else;
* rows with equal contexts: all windows of all but the earliest are repeated;
* the earliest rows of a bucket with several contexts are split into smaller cells and go through the same again, down to
  single windows. Of windows in later rows nothing is lost: the earliest row with the same context has them all.

Identifiers are 64 bits and rows are compared within a core only. A frequent passage spreads: counts and earliest rows
are sums with map-side reduction, and the joins on cores have one row a core on the other side, which Spark may split.

Nulls: a null text is empty; a null id comes before all others. Rows with one id order by a checksum of the text; of
rows that are equal in both, one is judged by what comes before it and the others are copies of it. Texts shorter than
``length`` stay whole. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seglume.llm.textbytes import buffers, gram_hashes, map_texts, mix64, slices
from seglume.storage import stage


@dataclass(frozen=True)
class RepeatParams:
    length: int = 100
    #: Distances of a cell at each level, each a part of the one before it; 1 at last, at most 64.
    cells: tuple[int, ...] = (64, 8, 1)
    #: Windows that are hashed at once.
    chunk: int = 1 << 18

    @property
    def depths(self) -> tuple[int, ...]:
        """Bytes that all windows of a cell have in common."""
        return tuple(self.length - cell + 1 for cell in self.cells)


_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE_BITS = 20
_ROWS = ("core", "ctx", "place")


def bucket(grams: np.ndarray, depths: tuple[int, ...], level: int, at: np.ndarray) -> np.ndarray:
    """Identifiers of the buckets of ``depths[level]`` bytes at some places, from identifiers at later offsets."""
    if not level:
        return grams[at]
    d = depths[level - 1]
    return _refined(grams, depths, level - 1, at, np.full(len(at), depths[level]), range(d, depths[level], d))


def _refined(grams: np.ndarray, depths: tuple[int, ...], level: int, at: np.ndarray, length: np.ndarray, steps: range) -> np.ndarray:
    """Identifiers of ``length`` bytes from those of ``depths[level]``, at offsets a depth apart and at the end."""
    out = mix64(bucket(grams, depths, level, at) + length.astype(np.uint64))
    for step in steps:
        out = mix64(out * _STEP + bucket(grams, depths, level, at + np.minimum(step, length - depths[level])))
    return out


def context(grams: np.ndarray, p: RepeatParams, level: int, anchor: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Identifiers of all that the windows at distances ``near`` to ``far`` before an anchor cover, and of the distances."""
    d = p.depths[level]
    out = _refined(grams, p.depths, level, anchor - far, far - near + p.length, range(d, p.length + p.cells[level] - 1, d))
    return mix64(out ^ (near * 64 + far + 1).astype(np.uint64))


def place(anchor: np.ndarray, near: np.ndarray, far: np.ndarray, level: int) -> np.ndarray:
    """An anchor, its windows and the level in one number, which orders like the anchor."""
    return ((anchor * 64 + near) * 64 + far) * 4 + level


def of_place(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 14, at >> 8 & 63, at >> 2 & 63


def anchors(grams: np.ndarray, ends: np.ndarray, p: RepeatParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, near, far) of all windows that end where their text goes on (``ends``: a text's end for each window), in
    order; of equal hashes the first place is the anchor."""
    cell, n = p.cells[0], len(ends)
    low = np.uint64((1 << _PLACE_BITS) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span < cell:
        step = min(span, cell - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    anchor = (least[:n] & low).astype(np.int64)
    begin = np.arange(n)
    inside = begin + p.length <= ends
    cut = np.ones(n + 1, bool)
    cut[1:-1] = (anchor[1:] != anchor[:-1]) | (ends[1:] != ends[:-1]) | (inside[1:] != inside[:-1])
    first, last = np.flatnonzero(cut[:-1] & inside), np.flatnonzero(cut[1:] & inside)
    return anchor[first], anchor[first] - last, anchor[first] - first


def _first_level(p: RepeatParams, cores_only: bool):
    """Rows of anchors of (doc_id, mark, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, raw, offs in slices(batch.column(2)):
                for c in range(0, max(0, len(raw) - p.length + 1), p.chunk):
                    part = raw[c : c + p.chunk + p.length - 1]
                    n = len(part) - p.length + 1
                    text = np.searchsorted(offs, np.arange(c, c + n), "right") - 1
                    grams = gram_hashes(part, p.depths[0])
                    at, near, far = anchors(grams, offs[text + 1] - c, p)
                    if cores_only:
                        yield pa.RecordBatch.from_arrays([pa.array(grams[at].view(np.int64))], names=["core"])
                        continue
                    own = text[at - far]
                    rows = pa.array(own + a)
                    ctx = context(grams, p, 0, at, near, far)
                    cols = [grams[at].view(np.int64), ctx.view(np.int64), place(at + c - offs[own], near, far, 0)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cols), batch.column(0).take(rows), batch.column(1).take(rows)], names=[*_ROWS, "doc_id", "mark"])

    return run


def _next_level(p: RepeatParams, level: int):
    """Rows of the smaller cells of open rows, of (doc_id, mark, text, places)."""
    cell, depth = p.cells[level], p.depths[level]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = buffers(batch.column(2))
            for i, places in enumerate(batch.column(3)):
                at, near, far = of_place(np.sort(np.asarray(places.values.to_numpy(zero_copy_only=False), np.int64)))
                text = raw[offs[i] : offs[i + 1]]
                for chunk in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at // p.chunk)) + 1):
                    low = max(0, int(at[chunk[0]]) - p.cells[0])
                    grams = gram_hashes(text[low : int(at[chunk[-1]]) + 2 * p.length], p.depths[0])
                    parts = far[chunk] // cell - near[chunk] // cell + 1
                    of = np.repeat(chunk, parts)
                    k = near[of] // cell + np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
                    first, last, x = np.maximum(near[of], k * cell), np.minimum(far[of], k * cell + cell - 1), at[of] - low
                    core = bucket(grams, p.depths, level, x - k * cell)
                    # the cell is part of the core: equal bytes at another distance are another row's
                    core = mix64(core + k.astype(np.uint64)) if cell > 1 else mix64(core)
                    ctx = context(grams, p, level, x, first, last) if cell > 1 else core
                    one = pa.array(np.full(len(of), i))
                    cols = [core.view(np.int64), ctx.view(np.int64), place(at[of], first, last, level)]
                    yield pa.RecordBatch.from_arrays([*map(pa.array, cols), batch.column(0).take(one), batch.column(1).take(one)], names=[*_ROWS, "doc_id", "mark"])

    return run


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["mark"].eqNullSafe(b["mark"]) & a["doc_id"].eqNullSafe(b["doc_id"])


def _sorted_out(rows: DataFrame, cores: DataFrame | None, label: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows whose core is found again; the earliest row of each context; of those the ones whose bucket has several."""
    cores = stage((cores if cores is not None else rows.select("core")).groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"), label)
    live = stage(rows.join(cores, "core"), label)
    groups = stage(live.groupBy("core", "ctx").agg(F.min(F.struct("doc_id", "mark", "place")).alias("first")).select("core", "first.*"), label)
    several = groups.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")
    return live, groups, groups.join(several, "core").select("doc_id", "mark", "place")


def repeated_places(texts: DataFrame, p: RepeatParams) -> DataFrame:
    """(doc_id, mark, places) of (doc_id, mark, text): the rows of each document whose windows all start earlier elsewhere."""
    kind = dict(texts.dtypes)["doc_id"]
    schema = f"core long, ctx long, place long, doc_id {kind}, mark long"
    long_ = texts.where(F.octet_length("text") >= p.length)
    live, groups, open_ = _sorted_out(map_texts(long_, _first_level(p, False), schema), map_texts(long_, _first_level(p, True), "core long"), "repeats-0")
    found = [(live, groups)]
    for level in range(1, len(p.cells)):
        by_doc = stage(open_.groupBy("doc_id", "mark").agg(F.collect_list("place").alias("places")), f"repeats-open-{level}")
        rows = long_.join(by_doc, _same(long_, by_doc)).select(long_["doc_id"], long_["mark"], "text", "places")
        live, groups, open_ = _sorted_out(stage(map_texts(rows, _next_level(p, level), schema), f"repeats-{level}"), None, f"repeats-{level}")
        found.append((live, groups))
    every = None
    for live, groups in found:
        both = live.select("doc_id", "mark", "place", F.lit(False).alias("first")).unionByName(groups.select("doc_id", "mark", "place", F.lit(True).alias("first")))
        every = both if every is None else every.unionByName(both)
    # a document's own rows: their number is bounded by its length
    held = every.groupBy("doc_id", "mark").agg(*[F.collect_list(F.when(F.col("first") == first, F.col("place"))).alias(name) for name, first in (("live", False), ("firsts", True))])
    return held.select("doc_id", "mark", F.array_except("live", "firsts").alias("places")).where(F.size("places") > 0)


def _cut(p: RepeatParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = buffers(batch.column(2))
            view, rows = memoryview(raw), []
            for i, places in enumerate(batch.column(3)):
                text = view[int(offs[i]) : int(offs[i + 1])]
                kept, removed, spans, end = sha256(), 0, 0, 0
                if places.is_valid:
                    anchor, near, far = of_place(np.asarray(places.values.to_numpy(zero_copy_only=False), np.int64))
                    begins, ends = anchor - far, anchor - near + p.length
                    order = np.argsort(begins, kind="stable")
                    reach = np.maximum.accumulate(ends[order])
                    fresh = np.ones(len(order), bool)
                    fresh[1:] = begins[order][1:] > reach[:-1]
                    at = np.flatnonzero(fresh)
                    for b, e in zip(begins[order][at].tolist(), reach[np.append(at[1:] - 1, len(order) - 1)].tolist()):
                        kept.update(text[end:b])
                        removed, spans, end = removed + e - b, spans + 1, e
                kept.update(text[end:])
                rows.append((len(text), removed, spans, kept.hexdigest()))
            cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["doc_id", "mark", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: RepeatParams = RepeatParams()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; one row a document."""
    p = params
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(body).alias("mark"), body.alias("text"))
    places = stage(repeated_places(texts, p), "repeats-places")
    kind = dict(texts.dtypes)["doc_id"]
    rows = texts.join(places, _same(texts, places), "left").select(texts["doc_id"], texts["mark"], "text", "places")
    judged = map_texts(rows, _cut(p), f"doc_id {kind}, mark long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    # equal rows: one as judged, the others are copies of it
    counted = judged.groupBy(*judged.columns).agg(F.count("*").alias("rows"))
    each = counted.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    copy = (F.col("k") > 1) & (F.col("n_bytes") >= p.length)
    gone = lambda c, value: F.when(copy, value).otherwise(F.col(c)).alias(c)
    return each.select("doc_id", "n_bytes", gone("n_removed", F.col("n_bytes")), gone("n_spans", F.lit(1).cast("long")), gone("kept_sha256", F.lit(sha256().hexdigest())))
