"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated by temperature.

1. Word vectors. Units are runs of letters, of digits or of marks, in their case, hashed to ``bins``. Each context unit
   has a fixed random index vector (two hashes pick two rows of signs); a bin's vector is the sum of the index vectors
   of all units that stand next to it, over every document of the table. Tasks emit one partial sum a bin, so what is
   gathered is bins x dims numbers, whatever the table's size.
2. A document is pooled from its units' vectors (``pool``); a text without units is all zeros.
3. The network (tanh layer, logistic output) learns on every labelled document, never one of the held-out third. Their
   pooled rows go into blocks of about ``block_rows``, and each step of L-BFGS asks all blocks for their part of the loss
   and of its gradient; parts are added as whole numbers, so that no order of tasks changes the sum. A fifth of the rows
   (by a hash of the id) is left out of the fit and sets the temperature that calibrates the probabilities.

Scores use nothing but the text. Nulls: a null text is empty and is scored; a null id is never labelled; labels that
are null are ignored, and of several labels of a document the mean counts. Without labels every score is 0.5. Repeated
rows stay. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seglume.llm.textbytes import SPACE, Words, hashes, map_texts, slices
from seglume.storage import stage


@dataclass(frozen=True)
class QualityParams:
    bins: int = 4096
    dims: int = 32
    block_rows: int = 4096
    hidden: int = 24
    #: Most steps of the fit; it ends earlier where a step gains less than ``gain`` of the loss.
    steps: int = 60
    gain: float = 1e-4
    memory: int = 10
    decay: float = 1e-4
    seed: int = 7


_CLASS = np.array([0 if i in SPACE else 1 if i >= 128 or chr(i).isalpha() else 2 if chr(i).isdigit() else 3 for i in range(256)], np.int8)
_AS_IS = np.arange(256, dtype=np.uint8)
_INDEX = 256


def units(raw: np.ndarray, offs: np.ndarray) -> Words:
    """Runs of one class within a text."""
    if not len(raw):
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64))
    c = _CLASS[raw]
    new = np.empty(len(raw), bool)
    new[0] = True
    new[1:] = c[1:] != c[:-1]
    new[offs[offs < len(raw)]] = True
    edges = np.flatnonzero(new)
    ends = np.append(edges[1:], len(raw))
    keep = c[edges] > 0
    starts = edges[keep]
    return Words(starts, ends[keep], np.searchsorted(starts, offs))


def _bins(raw: np.ndarray, offs: np.ndarray, p: QualityParams) -> tuple[np.ndarray, np.ndarray, Words]:
    w = units(raw, offs)
    h = hashes(raw, w, _AS_IS)
    return (h % np.uint64(p.bins)).astype(np.int64), h, w


def _signs(p: QualityParams) -> np.ndarray:
    return np.random.default_rng(p.seed).choice(np.array([-1.0, 1.0]), (2, _INDEX, p.dims))


def _partial_vectors(p: QualityParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros((2, p.bins * _INDEX))
        for batch in batches:
            for _, _, raw, offs in slices(batch.column(0), 1 << 20):
                b, h, w = _bins(raw, offs, p)
                if len(b) < 2:
                    continue
                text = w.text_of()
                same = text[1:] == text[:-1]
                left, right = b[:-1][same], b[1:][same]
                for k, shift in enumerate((20, 40)):
                    i = (h >> np.uint64(shift) & np.uint64(_INDEX - 1)).astype(np.int64)
                    met[k] += np.bincount(left * _INDEX + i[1:][same], minlength=p.bins * _INDEX)
                    met[k] += np.bincount(right * _INDEX + i[:-1][same], minlength=p.bins * _INDEX)
        signs = _signs(p)
        sums = sum(met[k].reshape(p.bins, _INDEX) @ signs[k] for k in range(2))
        seen = np.flatnonzero(met[0].reshape(p.bins, _INDEX).any(axis=1))
        cols = [pa.array(seen, pa.int32()), *[pa.array(sums[seen, i]) for i in range(p.dims)]]
        yield pa.RecordBatch.from_arrays(cols, names=["bin", *[f"v{i}" for i in range(p.dims)]])

    return run


def word_vectors(docs: DataFrame, text_col: str = "text", params: QualityParams = QualityParams()) -> np.ndarray:
    """bins x dims, rows of length one: a table whose size no data changes, so it may come to the driver."""
    p = params
    names = [f"v{i}" for i in range(p.dims)]
    part = map_texts(docs.select(F.col(text_col).cast("string").alias("text")), _partial_vectors(p), "bin int, " + ", ".join(f"{n} double" for n in names))
    out = np.zeros((p.bins, p.dims))
    for r in part.groupBy("bin").agg(*[F.sum(n).alias(n) for n in names]).collect():
        out[r[0]] = r[1:]
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(length > 0, length, 1)).astype(np.float32)


def width(p: QualityParams) -> int:
    return 3 * p.dims + 1


def pool(raw: np.ndarray, offs: np.ndarray, vectors: np.ndarray, p: QualityParams) -> np.ndarray:
    """Of each text: the means of its units' vectors, of their squares and of the products of neighbours (these tell
    repeated units from others), and the logarithm of the number of units."""
    b, _, w = _bins(raw, offs, p)
    n, d = w.per_text(), p.dims
    out = np.zeros((len(n), width(p)), np.float32)
    out[:, -1] = np.log1p(n)
    full = np.flatnonzero(n)
    if len(full):
        rows, heads = vectors[b], w.first[:-1][full]
        out[full, :d] = np.add.reduceat(rows, heads, axis=0) / n[full, None]
        # a text's last unit has no next one
        near = np.empty_like(rows)
        near[:-1] = rows[:-1] * rows[1:]
        near[w.first[1:][full] - 1] = 0
        out[full, 2 * d : 3 * d] = np.add.reduceat(near, heads, axis=0) / n[full, None]
        np.square(rows, out=rows)
        out[full, d : 2 * d] = np.add.reduceat(rows, heads, axis=0) / n[full, None]
    return out


@dataclass(frozen=True)
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -30, 30)))


def _totals(blocks: DataFrame, part, size: int) -> np.ndarray:
    """The sums over all rows of ``part(x, y, left_out)``, which gives ``size`` sums of a block's rows, each a share of a
    mean. They are added as whole numbers of 2 ** -46, so any order gives the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1)):
                marks = np.frombuffer(y.as_buffer(), np.uint8)
                rows = np.frombuffer(x.as_buffer(), "<f4").reshape(len(marks), -1).astype(np.float64)
                total += np.rint(part(rows, (marks & 1).astype(np.float64), marks > 1) * 2.0**46).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["i", "v"])

    out = np.zeros(size)
    for i, v in blocks.select("x", "y").mapInArrow(run, "i int, v long").groupBy("i").agg(F.sum("v")).collect():
        out[i] = v / 2.0**46
    return out


def _shapes(d: int, p: QualityParams) -> list[tuple[int, ...]]:
    return [(d, p.hidden), (p.hidden,), (p.hidden,), (1,)]


def _parts(flat: np.ndarray, d: int, p: QualityParams) -> list[np.ndarray]:
    shapes = _shapes(d, p)
    return [x.reshape(s) for x, s in zip(np.split(flat, np.cumsum([int(np.prod(s)) for s in shapes])[:-1]), shapes)]


def _lbfgs(loss, at: np.ndarray, p: QualityParams) -> np.ndarray:
    """Where ``loss`` (which gives value and gradient) is least, by steps along the gradient as the last ``memory`` steps
    have bent it, each halved until it gains."""
    value, slope = loss(at)
    moved: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(p.steps):
        way, shares = -slope, []
        for s, y in reversed(moved):
            shares.append(s @ way / (s @ y))
            way = way - shares[-1] * y
        if moved:
            s, y = moved[-1]
            way = way * (s @ y) / (y @ y)
        for (s, y), share in zip(moved, reversed(shares)):
            way = way + (share - y @ way / (s @ y)) * s
        down, step = slope @ way, 1.0 if moved else min(1.0, 1 / max(1e-12, float(np.linalg.norm(slope))))
        if down >= 0:
            break
        for _ in range(20):
            after, new = loss(at + step * way)
            if after <= value + 1e-4 * step * down:
                break
            step /= 2
        else:
            break
        s, y = step * way, new - slope
        if s @ y > 1e-12 * float(y @ y):
            moved = [*moved, (s, y)][-p.memory :]
        gained = value - after
        at, value, slope = at + s, after, new
        if gained < p.gain * max(value, 1e-3):
            break
    return at


def fit(blocks: DataFrame, n: int, left_out: int, p: QualityParams = QualityParams()) -> Network:
    """Of ``n`` rows in blocks, ``left_out`` of them set the temperature, the rest the weights."""
    d = width(p)
    rng = np.random.default_rng(p.seed)
    start = [rng.normal(0, d**-0.5, (d, p.hidden)), np.zeros(p.hidden), rng.normal(0, p.hidden**-0.5, p.hidden), np.zeros(1)]
    if not n:
        return Network(np.zeros(d), np.ones(d), start[0], start[1], start[2] * 0, 0.0, 1.0)
    mean = _totals(blocks, lambda x, y, out: x.sum(axis=0) / n, d)
    scale = np.sqrt(_totals(blocks, lambda x, y, out: ((x - mean) ** 2).sum(axis=0) / n, d)) + 1e-3
    used = n - left_out

    def loss(flat: np.ndarray) -> tuple[float, np.ndarray]:
        w1, b1, w2, b2 = _parts(flat, d, p)

        def part(x: np.ndarray, y: np.ndarray, out: np.ndarray) -> np.ndarray:
            a, t = ((x - mean) / scale)[~out], y[~out]
            hidden = np.tanh(a @ w1 + b1)
            logit = hidden @ w2 + b2
            err = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - t) / used
            down = err[:, None] * w2 * (1 - hidden**2)
            return np.concatenate([(a.T @ down).ravel(), down.sum(axis=0), hidden.T @ err, [err.sum()], [np.logaddexp(0, np.where(t > 0.5, -logit, logit)).sum() / used]])

        total = _totals(blocks, part, len(flat) + 1)
        shrunk = np.concatenate([w1.ravel(), b1 * 0, w2, b2 * 0])
        return float(total[-1] + p.decay / 2 * (shrunk @ shrunk)), total[:-1] + p.decay * shrunk

    w1, b1, w2, b2 = _parts(_lbfgs(loss, np.concatenate([x.ravel() for x in start]), p), d, p)
    net = Network(mean, scale, w1, b1, w2, float(b2[0]), 1.0)
    if not left_out:
        return net
    tried = np.geomspace(0.25, 8, 101)

    def losses(x: np.ndarray, y: np.ndarray, out: np.ndarray) -> np.ndarray:
        signed = np.where(y[out] > 0.5, -1, 1) * net.logit(x[out])
        return np.logaddexp(0, signed / tried[:, None]).sum(axis=1) / left_out

    best = tried[int(np.argmin(_totals(blocks, losses, len(tried))))]
    return Network(mean, scale, w1, b1, w2, float(b2[0]), float(best))


def held_out(id_col: str | Column) -> Column:
    """A third of all ids, by the checksum of the id as text."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _block(p: QualityParams):
    """A row for all rows of a block: their pooled rows, and of each its label and (2) whether it is left out of the fit."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        x = b"".join(table.column("x").to_pylist())
        return pa.table({"x": pa.array([x], pa.binary()), "y": pa.array([table.column("mark").to_numpy().astype(np.uint8).tobytes()], pa.binary())})

    return run


def train(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", params: QualityParams = QualityParams()) -> Network:
    """Fits the network to every labelled document that is not held out."""
    p = params
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).where("doc_id is not null and y is not null").where(~held_out("doc_id"))
    known = known.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.concatenate([pool(raw, offs, vectors, p) for _, _, raw, offs in slices(batch.column(1))] or [np.zeros((0, width(p)), np.float32)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x.astype("<f4")], pa.binary())], names=["doc_id", "x"])

    # pooled rows are a small part of their texts, so these meet the labels, not the texts
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pooled = map_texts(texts.where("doc_id is not null").where(~held_out("doc_id")), run, "doc_id long, x binary")
    # of repeated ids the least row counts
    rows = stage(pooled.join(known, "doc_id").groupBy("doc_id").agg(F.min("x").alias("x"), F.first("y").alias("y")), "quality-rows")
    fifth = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 4
    n, left_out = rows.agg(F.count("*"), F.count_if(fifth)).first()
    if n < 50:
        left_out = 0
    mark = F.col("y") + F.when(fifth & F.lit(left_out > 0), 2).otherwise(0)
    block = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(p.seed)), F.lit(max(1, -(-n // p.block_rows))))
    blocks = rows.select("doc_id", "x", mark.alias("mark"), block.alias("block")).groupBy("block").applyInArrow(_block(p), "x binary, y binary")
    return fit(stage(blocks, "quality-blocks"), n, left_out, p)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", params: QualityParams = QualityParams()) -> DataFrame:
    """doc_id, held_out, score, predicted; one row a document."""
    scored = score_texts(docs, labels, [id_col], id_col, text_col, label_col, params)
    return scored.select(F.col("c0").cast("long").alias("doc_id"), held_out("c0").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def score_texts(docs: DataFrame, labels: DataFrame, keep: list[str], id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", params: QualityParams = QualityParams()) -> DataFrame:
    """The columns ``keep`` as c0, c1, ... (no name of the input can clash) and score."""
    p = params
    vectors = word_vectors(docs, text_col, p)
    net = train(docs, labels, vectors, id_col, text_col, label_col, p)
    carried = [F.col(k).alias(f"c{i}") for i, k in enumerate(keep)]
    if text_col in keep and dict(docs.dtypes)[text_col] == "string":  # the text goes to Python once
        chosen, body = docs.select(*carried), keep.index(text_col)
    else:
        chosen, body = docs.select(*carried, F.col(text_col).cast("string").alias("body")), len(keep)
    names = [*chosen.columns[: len(keep)], "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.concatenate([net.score(pool(raw, offs, vectors, p)) for _, _, raw, offs in slices(batch.column(body))] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names) - 1], pa.array(score, pa.float64())], names=names)

    return map_texts(chosen, run, chosen.drop("body").schema.add("score", "double"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: QualityParams = QualityParams()) -> DataFrame:
    """The documents that the classifier does not reject, with all their columns."""
    scored = score_texts(docs, labels, docs.columns, id_col, text_col, params=params).where("score >= 0.5")
    return scored.select(*[F.col(f"c{i}").alias(k) for i, k in enumerate(docs.columns)])
