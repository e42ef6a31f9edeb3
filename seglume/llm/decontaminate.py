"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words are counted over the whole table (``bins`` numbers in the end).
2. The latent space: passages of 64 words, of all documents and of the benchmark, are the rows of one TF-IDF table. Its
   leading ``rank`` right singular vectors come from a distributed randomised SVD: power iterations, in which every task
   multiplies its rows and the products (bins x rank) are added up; only they reach the driver. The first iterations, from
   a seeded random projection, need not see all rows (about ``fit_passages``, drawn by a hash of the text, and as many of
   the benchmark): they say where the last one begins, which goes over all rows and gives the vectors. Words that stand in the same passages get alike vectors there, so a passage in other words is
   near the item that it paraphrases. Every row of the table is searched in that space.
3. Benchmark items are cut into passages of at most 64 words and dealt to blocks of about ``block`` passages. All
   documents are cut into overlapping windows of 16, 32 and 64 words, folded into the latent space, and compared by
   cosine with the passages of their own scale; ``cosine`` makes a candidate, if ``told`` of the passage's words, and of
   their weight, can be around it.
4. Beside that, windows that follow the passages' lengths are searched by plain counts, with no weights: a passage is a
   candidate where ``loose`` of its words are in the window, whatever their frequency. Each stretch as long as step 5
   looks at lies in one window, so no passage that its first two rules would accept is lost for its frequent words, its
   length or its neighbours.
5. A candidate is aligned at every offset at which enough of its words can still agree, and the longest common
   subsequence of passage and aligned stretch decides: ``near`` of the passage's words; or ``loose`` of them if the
   answer (the passage's last words) is there too, which tells paraphrases from chance; or ``told`` of them, and of their
   weight, with the answer, if the latent cosine is at least ``cosine``: a paraphrase by other words. A passage of few
   words repeated is in any prose as a subsequence; ``near`` of its words must agree place by place.

Blocks go over the documents in as many passes as ``broadcast_bytes`` needs, one after another, each pass's rows written
before the next one's tables are made, so what tasks and the driver hold is bounded.

Nulls: a null text (of a document or an item) is empty and matches nothing; a null id is kept. Items of fewer than
``least_words`` words match where all their words stand in order and unbroken. Repeated rows match each. Texts are searched whole. Empty
tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seglume.llm.textbytes import MARKS, hashes, map_texts, slices, word_mask, words
from seglume.storage import stage

SCALES = (16, 32, 64)
#: Window lengths of the search by counts, in steps of about 1.25, before room for insertions.
SIZES = (8, 10, 13, 16, 20, 25, 32, 40, 50, 64)


@dataclass(frozen=True)
class LeakParams:
    bins: int = 1 << 15
    block: int = 256
    rank: int = 48
    oversample: int = 8
    #: The fit over all rows begins where one over about so many passages of documents, and of the benchmark, ended.
    fit_passages: int = 20_000
    fit_tasks: int = 4
    cosine: float = 0.9
    near: float = 0.6
    loose: float = 0.5
    told: float = 0.4
    answer: float = 0.75
    least_words: int = 8
    broadcast_bytes: int = 64 << 20
    seed: int = 5


_INSIDE, _FOLDED = word_mask(MARKS)


def _words(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = words(raw, offs, _INSIDE)
    return hashes(raw, w, _FOLDED), w.first


# ---- document frequencies

#: Texts whose bins are told apart at once.
_TEXTS = 32


def _frequencies(p: LeakParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs, passages = np.zeros(p.bins, np.int64), 0, 0
        last = np.zeros(_TEXTS * p.bins, np.int32)
        for batch in batches:
            docs += batch.num_rows
            for a, b, raw, offs in slices(batch.column(0)):
                h, first = _words(raw, offs)
                bins, text = _bins(h, p), np.repeat(np.arange(b - a), np.diff(first))
                for i in range(0, b - a, _TEXTS):
                    own = slice(first[i], first[min(i + _TEXTS, b - a)])
                    # of a text's equal words the one that was written last counts
                    key, number = (text[own] - i) * p.bins + bins[own], np.arange(own.stop - own.start, dtype=np.int32)
                    last[key] = number
                    total += np.bincount(bins[own][last[key] == number], minlength=p.bins)
                passages += int((-(-np.diff(first) // SCALES[-1])).sum())
        bins = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([*bins, _DOCS, _PASSAGES], pa.int32()), pa.array([*total[bins], docs, passages], pa.int64())], names=["bin", "n"])

    return run


_DOCS, _PASSAGES = -1, -2


def word_weights(docs: DataFrame, text_col: str = "text", params: LeakParams = LeakParams()) -> tuple[np.ndarray, int]:
    """Inverse document frequency by bin over all documents (``bins`` numbers, whatever the table's size; zero for a word
    that is in all of them), and how many passages the documents have."""
    p = params
    rows = map_texts(docs.select(F.col(text_col).cast("string").alias("text")), _frequencies(p), "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    count, other = np.zeros(p.bins), {_DOCS: 0, _PASSAGES: 0}
    for b, n in rows:
        if b < 0:
            other[b] = n
        else:
            count[b] = n
    return np.log((other[_DOCS] + 1) / (count + 1)).astype(np.float32), other[_PASSAGES]


# ---- the latent space

def _bins(h: np.ndarray, p: LeakParams) -> np.ndarray:
    return (h % np.uint64(p.bins)).astype(np.int64)


def _passage_rows(raw: np.ndarray, offs: np.ndarray, idf: np.ndarray, p: LeakParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bins, weights, sizes): the TF-IDF rows of length one of the passages of a slice's texts, one after another."""
    h, first = _words(raw, offs)
    n = np.diff(first)
    place = np.arange(len(h)) - np.repeat(first[:-1], n)
    row = np.repeat(np.cumsum(-(-n // SCALES[-1])) + n // -SCALES[-1], n) + place // SCALES[-1]
    key, times = np.unique(row * p.bins + _bins(h, p), return_counts=True)
    bin_, row = key % p.bins, key // p.bins
    w = times * idf[bin_]
    on = w > 0
    bin_, row, w = bin_[on], row[on], w[on]
    starts = np.flatnonzero(np.diff(row, prepend=-1)) if len(row) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(row)))
    length = np.sqrt(np.add.reduceat(w**2, starts)) if len(row) else np.zeros(0)
    return bin_.astype(np.int32), (w / np.repeat(length, sizes)).astype(np.float32), sizes


def _fit_rows(idf: np.ndarray, p: LeakParams):
    """The TF-IDF rows of a text's passages, as (bins, weights)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, weights, ends = [], [], [0]
            for _, _, raw, offs in slices(batch.column(0)):
                own, w, sizes = _passage_rows(raw, offs, idf, p)
                bins.append(own)
                weights.append(w)
                ends.extend((ends[-1] + np.cumsum(sizes)).tolist())
            flat = [np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((bins, np.int32), (weights, np.float32))]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in flat], names=["bins", "weights"])

    return run


#: Rows that ``_whole`` multiplies at once, by the bins that they have.
_ROWS = 16


#: Passages (some 400 bytes each) that a task of ``whole_space`` multiplies.
_TASK_PASSAGES = 150_000


def _whole(q: np.ndarray, idf: np.ndarray, p: LeakParams):
    """As ``_product``, of the texts themselves: no table of all passages is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(q.shape, np.float32)
        for batch in batches:
            for _, _, raw, offs in slices(batch.column(0)):
                bins, weights, sizes = _passage_rows(raw, offs, idf, p)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                for i in range(0, len(sizes), _ROWS):
                    x, y = ends[i], ends[min(i + _ROWS, len(sizes))]
                    own, at = np.unique(bins[x:y], return_inverse=True)
                    rows = np.zeros((min(_ROWS, len(sizes) - i), len(own)), np.float32)
                    rows[np.repeat(np.arange(len(rows)), sizes[i : i + _ROWS]), at] = weights[x:y]
                    total[own] += rows.T @ (rows @ q[own])
        yield _chunks(total)

    return run


_CHUNK = 4096


def _product(q: np.ndarray):
    """Of a task's rows A: A' A q, in chunks of bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(q.shape, np.float32)
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, weights = (batch.column(i).flatten().to_numpy(zero_copy_only=False) for i in range(2))
            n = np.diff(batch.column(0).offsets.to_numpy())
            row = np.repeat(np.arange(len(n)), n)
            y = np.zeros((len(n), q.shape[1]), np.float32)
            full = np.flatnonzero(n)
            if len(full):
                y[full] = np.add.reduceat(q[bins] * weights[:, None], (np.cumsum(n) - n)[full], axis=0)
                order = np.argsort(bins, kind="stable")
                heads = np.flatnonzero(np.diff(bins[order], prepend=-1))
                total[bins[order][heads]] += np.add.reduceat(y[row[order]] * weights[order, None], heads, axis=0)
        yield _chunks(total)

    return run


def _chunks(total: np.ndarray) -> pa.RecordBatch:
    parts = range(0, len(total), _CHUNK)
    return pa.RecordBatch.from_arrays([pa.array([*range(len(parts))], pa.int32()), pa.array([total[i : i + _CHUNK].tobytes() for i in parts], pa.binary())], names=["chunk", "data"])


def _added(table: pa.Table) -> pa.Table:
    data = sum(np.frombuffer(x.as_buffer(), np.float32) for x in table.column("data"))
    return pa.table({"chunk": table.column("chunk")[:1].cast(pa.int32()), "data": pa.array([data.tobytes()], pa.binary())})


def _sum(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    out = np.zeros(shape)
    for chunk, data in parts.groupBy("chunk").applyInArrow(_added, "chunk int, data binary").collect():
        own = np.frombuffer(bytes(data), np.float32).reshape(-1, shape[1])
        out[chunk * _CHUNK : chunk * _CHUNK + len(own)] = own
    return out


def _leading(rows: DataFrame, p: LeakParams) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, values): the leading right singular vectors of a table of TF-IDF rows, ``oversample`` more than the rank,
    and the squares of their values, by a randomised SVD in three passes."""
    times = lambda q: _sum(rows.mapInArrow(_product(q), "chunk int, data binary"), q.shape)
    q = np.random.default_rng(p.seed).standard_normal((p.bins, min(p.rank + p.oversample, p.bins))).astype(np.float32)
    for _ in range(2):
        q = np.linalg.qr(times(q))[0].astype(np.float32)
    small = q.T @ times(q)
    value, vector = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-value)
    return (q @ vector[:, order]).astype(np.float32), value[order]


def latent_space(rows: DataFrame, params: LeakParams = LeakParams()) -> np.ndarray:
    """(bins, rank): the leading right singular vectors of the table of TF-IDF rows."""
    vectors, value = _leading(rows, params)
    return (vectors * (value > 1e-6))[:, : params.rank].astype(np.float32)


def whole_space(texts: DataFrame, start: np.ndarray, idf: np.ndarray, params: LeakParams = LeakParams(), passages: int = 0) -> np.ndarray:
    """(bins, rank): the leading right singular vectors of the TF-IDF rows of all passages of ``texts``, from the product
    of all of them with the orthonormal columns ``start`` (one more power iteration, and the small problem of Nystroem).
    What a task returns is as large as the product, however few its rows are; so there are no more tasks than ``passages``
    (about how many there are) and the cluster's cores ask for."""
    p = params
    tasks = max(texts.sparkSession.sparkContext.defaultParallelism, -(-passages // _TASK_PASSAGES))
    z = _sum(map_texts(texts.select("text").coalesce(tasks), _whole(start, idf, p), "chunk int, data binary"), start.shape)
    small = start.T.astype(np.float64) @ z
    value, vector = np.linalg.eigh((small + small.T) / 2)
    on = value > max(1e-6, 1e-7 * value.max(initial=0))
    u, s, _ = np.linalg.svd(z @ (vector[:, on] / np.sqrt(value[on])), full_matrices=False)
    out = np.zeros((p.bins, p.rank), np.float32)
    n = min(p.rank, int((s**2 > 1e-6).sum()))
    out[:, :n] = u[:, :n]
    return out


# ---- the benchmark's passages

@dataclass
class Basis:
    """One block: its passages, their places in the latent space (of length one), and their scales."""

    passages: list[tuple[int, np.ndarray]]  # (item, hashes)
    latent: np.ndarray
    scale: np.ndarray


def _passages(p: LeakParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, part, hs = [], [], []
            ids = batch.column(0).to_pylist()
            for a, b, raw, offs in slices(batch.column(1)):
                h, first = _words(raw, offs)
                for k in range(b - a):
                    own = h[first[k] : first[k + 1]]
                    if not len(own):
                        continue
                    starts = [0] if len(own) <= SCALES[-1] else [*range(0, len(own) - SCALES[-1], SCALES[-1] // 2), len(own) - SCALES[-1]]
                    for j, s in enumerate(starts):
                        items.append(ids[a + k])
                        part.append(j)
                        hs.append(own[s : s + SCALES[-1]].view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(part, pa.int32()), pa.array(hs, pa.list_(pa.int64()))], names=["item", "part", "words"])

    return run


def fit_block(items: list[int], passages: list[np.ndarray], idf: np.ndarray, space: np.ndarray, p: LeakParams) -> Basis:
    latent = np.stack([(space[at] * idf[at, None]).sum(axis=0) for at in (_bins(h, p) for h in passages)])
    norm = np.linalg.norm(latent, axis=1, keepdims=True)
    scale = np.array([min(s for s in SCALES if s >= len(h)) for h in passages])
    return Basis(list(zip(items, passages)), latent / np.where(norm > 0, norm, 1), scale)


def _fit(idf: np.ndarray, space: np.ndarray, p: LeakParams):
    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("item", "part", "words", "block"))), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        basis = fit_block([r[0] for r in rows], [np.array(r[2], np.int64).view(np.uint64) for r in rows], idf, space, p)
        data = pickle.dumps(basis)
        return pa.table({"block": pa.array([rows[0][3]], pa.int64()), "bytes": pa.array([len(data)], pa.int64()), "basis": pa.array([data], pa.binary())})

    return run


# ---- search

def lcs(masks: dict[int, int], n: int, region: list[int]) -> int:
    """Length of the longest common subsequence: ``masks`` has the positions of each word among the ``n`` of a passage."""
    full = (1 << n) - 1
    v, get = full, masks.get
    for w in region:
        m = get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


@dataclass
class Search:
    basis: Basis
    idf: np.ndarray
    space: np.ndarray
    p: LeakParams

    def __post_init__(self) -> None:
        b = self.basis
        self.masks, self.places = [], []
        for _, h in b.passages:
            masks, places = {}, {}
            for i, w in enumerate(h.tolist()):
                masks[w] = masks.get(w, 0) | 1 << i
                places.setdefault(w, []).append(i)
            self.masks.append(masks)
            self.places.append(places)
        lengths = np.array([len(h) for _, h in b.passages])
        self.words = np.unique(np.concatenate([h for _, h in b.passages]))
        self.known = np.zeros(1 << 18, bool)
        self.known[(self.words >> np.uint64(46)).astype(np.int64)] = True
        self.need = np.where(lengths < self.p.least_words, lengths, np.ceil(self.p.loose * lengths - 1e-9)).astype(np.int64)
        self.repeats = [2 * len(np.unique(h)) < len(h) for _, h in b.passages]
        self.placed = np.array(self.repeats) | (lengths < self.p.least_words)  # these must agree place by place
        # (size, passages, the words in any of them, which of them have each word, as often as they do: heads by word, passages)
        self.classes = []
        # which words each passage has, its weight, and what of a stretch must be in it
        self.has = np.zeros((len(lengths), len(self.words)), bool)
        for i, (_, h) in enumerate(b.passages):
            self.has[i, np.searchsorted(self.words, h)] = True
        own = [(i * len(self.words) + int(np.searchsorted(self.words, np.uint64(w))), mask) for i, m in enumerate(self.masks) for w, mask in m.items()]
        own = np.array(sorted(own), np.uint64)
        self.bits = own[:, 0].astype(np.int64), own[:, 1].copy()  # by passage and word, where in the passage it stands
        self.weight = self.idf[_bins(self.words, self.p)]
        self.weighted = np.concatenate([self.space * self.idf[:, None], np.zeros((1, self.space.shape[1]), np.float32)])
        self.total = np.array([self.weight[np.searchsorted(self.words, h)].sum() for _, h in b.passages])
        self.lengths = lengths
        self.times = np.zeros((len(self.words), len(lengths)), np.float32)  # how often each passage has each word
        for i, (_, h) in enumerate(b.passages):
            np.add.at(self.times[:, i], np.searchsorted(self.words, h), 1)
        size = np.array(SIZES)[np.searchsorted(SIZES, lengths)]
        for s in np.unique(size).tolist():
            mine = np.flatnonzero(size == s)
            counts = np.zeros((len(self.words), len(mine)), np.uint8)
            for k, i in enumerate(mine.tolist()):
                np.add.at(counts[:, k], np.searchsorted(self.words, b.passages[i][1]), 1)
            w, c = np.nonzero(counts)
            w, c = np.repeat(w, counts[w, c]), np.repeat(c, counts[w, c])
            self.classes.append((s, mine, counts.any(axis=1), (np.searchsorted(w, np.arange(len(self.words) + 1)), c)))

    def looked_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that any passage has, and which words they are."""
        at = np.flatnonzero(self.known[(h >> np.uint64(46)).astype(np.int64)])
        word = np.minimum(np.searchsorted(self.words, h[at]), len(self.words) - 1)
        ok = self.words[word] == h[at]
        return at[ok], word[ok]

    def counted(self, h: np.ndarray, first: np.ndarray, at: np.ndarray, word: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(text, window start, window end, passage) of all windows that hold as many of a passage's words as it needs."""
        out = []
        if not len(at):
            return out
        n = np.diff(first)
        # the same word's place before in the same text: a window counts a word once
        text = np.searchsorted(first, at, "right") - 1
        key = text * len(self.words) + word
        order = np.argsort(key, kind="stable")
        before = np.full(len(at), -1)
        again = key[order[1:]] == key[order[:-1]]
        before[order[1:][again]] = at[order[:-1][again]]
        # places in their text; the one before is at -1 where there is none
        place, earlier = at - first[text], np.where(before >= 0, before - first[text], -1)
        # a text that has too few of a passage's words has no such window
        some = np.unique(text)
        enough = np.zeros((len(n), len(self.need)), bool)
        for i in range(0, len(some), 256):
            own = some[i : i + 256]
            k = slice(np.searchsorted(text, own[0]), np.searchsorted(text, own[-1], "right"))
            present = np.zeros((len(own), len(self.words)), np.float32)
            present[np.searchsorted(own, text[k]), word[k]] = 1
            enough[own] = present @ self.times >= self.need
        for size, mine, used, (heads, of_passage) in self.classes:
            able = enough[:, mine].any(axis=1)
            need, step = self.need[mine], size // 4
            span = size + 2 * (size // 5 + 2) + step
            k = np.where(able, -(-n // step), 0)
            base = np.cumsum(k) - k
            of = np.repeat(np.arange(len(n)), k)
            start = first[:-1][of] + (np.arange(len(of)) - base[of]) * step
            end = np.minimum(start + span, first[1:][of])
            # the windows that count a place: those it is in, but for those with its word before
            enter = np.maximum(np.maximum((place - span) // step, earlier // step) + 1, 0)
            leave = place // step + 1
            mark = np.flatnonzero(used[word] & (enter < leave) & able[text])
            here, what = at[mark], word[mark]
            enter, leave = (v[mark] + base[text[mark]] for v in (enter, leave))
            for i in range(0, len(start), 8192):
                size_ = min(8192, len(start) - i)
                x, y = np.searchsorted(here, start[i]), np.searchsorted(here, end[i + size_ - 1])
                w = what[x:y]
                m = heads[w + 1] - heads[w]
                each = np.repeat(heads[w] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                col = of_passage.take(each)
                # what a window counts is what enters up to it less what has left
                cells = [np.bincount(np.repeat(np.clip(v[x:y] - i, 0, size_) * len(mine), m) + col, minlength=(size_ + 1) * len(mine)) for v in (enter, leave)]
                sums = np.cumsum((cells[0] - cells[1]).reshape(-1, len(mine))[:size_].astype(np.int16), axis=0, dtype=np.int16)
                r, c = np.divmod(np.flatnonzero(sums >= need.astype(np.int16)), len(mine))
                out.extend(zip(of[i + r].tolist(), start[i + r].tolist(), end[i + r].tolist(), mine[c].tolist()))
        return out

    def cosine(self, h: np.ndarray, passage: int) -> float:
        """Cosine of a stretch with a passage in the latent space; none of its words weighs anything: 0."""
        at = _bins(h, self.p)
        z = self.idf[at] @ self.space[at]
        norm = float(np.linalg.norm(z))
        return float(z @ self.basis.latent[passage]) / norm if norm > 0 else 0.0

    def in_place(self, region: np.ndarray, passage: int) -> tuple[float, float, int, int]:
        """As ``verify`` for passages that must agree place by place: (share, answer, first word, end word) in region."""
        h = self.basis.passages[passage][1]
        n = len(h)
        exact = n < self.p.least_words
        edge = np.zeros(0 if exact else n - 1, np.uint64)
        wide = np.concatenate([edge, region, edge])
        if len(wide) < n:
            return 0.0, 0.0, 0, 0
        agree = np.lib.stride_tricks.sliding_window_view(wide, n) == h
        top = int(agree.sum(axis=1).argmax())
        if exact:
            return (1.0, 1.0, top, top + n) if agree[top].all() else (0.0, 0.0, 0, 0)
        share = int(agree[top].sum()) / n
        x = max(0, top - len(edge))
        return share, 0.0, x, min(len(region), top - len(edge) + n)

    def folded(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sums, text, begin) of the latent vectors of each text's stretches of half the least scale: one row more than
        stretches, sums of all before; where each stretch's text is and its first word."""
        step = SCALES[0] // 2
        n = np.diff(first)
        k = -(-n // step)
        text = np.repeat(np.arange(len(n)), k)
        begin = first[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(k) - k, k)) * step
        sums = np.zeros((len(text) + 1, self.space.shape[1]))
        if len(text):
            # a stretch that its text ends early is filled up with a word of no weight
            bins = np.full(len(text) * step, self.p.bins)
            ends = np.append(begin[1:], len(h))
            bins[np.arange(len(h)) + np.repeat(np.arange(len(text)) * step - begin, ends - begin)] = _bins(h, self.p)
            own = self.weighted.take(bins, axis=0).reshape(len(text), step, -1).sum(axis=1)
            np.cumsum(own, axis=0, out=sums[1:])
        return sums, text, begin

    def candidates(self, first: np.ndarray, at: np.ndarray, word: np.ndarray, folds: tuple[np.ndarray, np.ndarray, np.ndarray]) -> list[tuple[int, int, int, float]]:
        """(text, window start, passage, cosine) of all windows of a slice at or over the threshold, if enough of the
        passage's words are around."""
        b, (sums, text, begin), out = self.basis, folds, []
        if not len(text) or not len(at):
            return out
        last = np.searchsorted(text, text, "right")  # of each stretch's text, one after the last stretch
        inner = np.arange(len(text)) - np.searchsorted(text, text)
        for size in SCALES:
            mine = np.flatnonzero(b.scale == size)
            span = size * 2 // SCALES[0]  # stretches in a window; it begins at every second half of that
            every = np.flatnonzero(inner % (span // 2) == 0)
            if not len(mine):
                continue
            for i in range(0, len(every), 4096):
                w = every[i : i + 4096]
                z = sums[np.minimum(w + span, last[w])] - sums[w]
                norm = np.linalg.norm(z, axis=1)
                cos = (z / np.where(norm > 0, norm, 1)[:, None]).astype(np.float32) @ b.latent[mine].T
                r, c = np.nonzero(cos >= self.p.cosine)
                n, start = self.lengths[mine[c]], begin[w[r]]
                lo = np.searchsorted(at, np.maximum(first[text[w[r]]], start - n))
                hi = np.searchsorted(at, np.minimum(first[text[w[r]] + 1], start + size + n))
                ok = (hi - lo) >= self.p.told * n
                r, c, lo, hi, n, start = (x[ok] for x in (r, c, lo, hi, n, start))
                for j in range(0, len(r), 8192):
                    k = slice(j, j + 8192)
                    m = hi[k] - lo[k]
                    rows = np.repeat(lo[k] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                    held = self.has[np.repeat(mine[c[k]], m), word[rows]]
                    heads = np.cumsum(m) - m
                    enough = np.add.reduceat(held, heads, dtype=np.int64) >= self.p.told * n[k]
                    enough &= np.add.reduceat(held * self.weight[word[rows]], heads) >= self.p.told * self.total[mine[c[k]]] - 1e-6
                    for x in np.flatnonzero(enough) + j:
                        out.append((int(text[w[r[x]]]), int(start[x]), int(mine[c[x]]), float(cos[r[x], c[x]])))
        return out

    def longest(self, at: np.ndarray, word: np.ndarray, start: np.ndarray, end: np.ndarray, passage: np.ndarray) -> np.ndarray:
        """``lcs`` of many stretches, each with its passage, at once: a word of each after another."""
        out = np.zeros(len(passage), np.int64)
        for i in range(0, len(passage), 2048):
            k = slice(i, i + 2048)
            lo, hi = np.searchsorted(at, start[k]), np.searchsorted(at, end[k])
            m = hi - lo
            rows = np.repeat(lo - (np.cumsum(m) - m), m) + np.arange(m.sum())
            of = np.repeat(np.arange(len(m)), m)
            key = word[rows]
            on = self.has[passage[k][of], key]
            of, key = of[on], passage[k][of[on]] * len(self.words) + key[on]
            m = np.bincount(of, minlength=len(lo))
            masks = np.zeros((m.max(initial=0), len(lo)), np.uint64)
            masks[np.arange(len(of)) - np.repeat(np.cumsum(m) - m, m), of] = self.bits[1][np.searchsorted(self.bits[0], key)]
            v = np.full(len(lo), 2**64 - 1, np.uint64)
            for row in masks:
                u = v & row
                v = (v + u) | (v - u)
            n = self.lengths[passage[k]]
            out[k] = n - np.bitwise_count(v & np.uint64(2**64 - 1) >> (64 - n).astype(np.uint64))
        return out

    def told(self, h: np.ndarray, passage: int) -> float:
        """The share of a passage's weight on words that are in a stretch."""
        own = self.basis.passages[passage][1]
        weight = self.idf[_bins(own, self.p)]
        return float(weight[np.isin(own, h)].sum()) / max(1e-9, float(weight.sum()))

    def verify(self, h: np.ndarray, a: int, b: int, start: int, passage: int) -> tuple[float, float, int, int]:
        """(share of the passage in its best alignment, share of its answer there, first word, end word)."""
        words_ = self.basis.passages[passage][1]
        n = len(words_)
        lo, hi = max(a, start - n), min(b, start + int(self.basis.scale[passage]) + n)
        if self.placed[passage]:
            share, answer, x, y = self.in_place(h[lo:hi], passage)
            return share, answer, lo + x - a, lo + y - a
        masks, places, p = self.masks[passage], self.places[passage], self.p
        region = h[lo:hi].tolist()
        votes: dict[int, int] = {}
        held = np.zeros(len(region) + 1, np.int64)
        for j, w in enumerate(region):
            for i in places.get(w, ()):
                votes[j - i] = votes.get(j - i, 0) + 1
            held[j + 1] = w in places
        held = np.cumsum(held)
        kept = [w for w in region if w in places]
        slack, tail = n // 5 + 2, max(3, n // 5)
        # no stretch has a longer common subsequence than it has words of the passage
        offsets = np.arange(-n, len(region) + 1)
        x, y = np.maximum(0, offsets - slack), np.minimum(len(region), offsets + n + slack)
        most = held[np.maximum(x, y)] - held[x]
        best, top, known = (0.0, 0.0, 0, 0), (0, 0), {}
        for k in np.lexsort((offsets, -np.array([votes.get(o, 0) for o in offsets.tolist()]), -most)).tolist():
            if most[k] < max(top[0], p.told * n - 1e-9):
                break
            words_there = int(held[x[k]]), int(held[y[k]])  # the same for many offsets
            if words_there not in known:
                known[words_there] = lcs(masks, n, kept[slice(*words_there)])
            same = known[words_there]
            own = (same, votes.get(int(offsets[k]), 0))
            if own > top:
                top, best = own, (same / n, 0.0, int(x[k]), int(y[k]))
        if not best[0]:
            return best
        end: dict[int, int] = {}
        for i, w in enumerate(words_[-tail:].tolist()):
            end[w] = end.get(w, 0) | 1 << i
        return best[0], lcs(end, tail, region[best[2] : best[3]]) / tail, lo + best[2] - a, lo + best[3] - a

    def slice(self, raw: np.ndarray, offs: np.ndarray) -> list[tuple[int, int | None, float, float, float, int, int]]:
        """(text, item, cosine, share, answer, first word, end word): the best match of each text and item."""
        p = self.p
        h, first = _words(raw, offs)
        found, done = {}, {}
        at, word = self.looked_up(h)
        tried: list = self.candidates(first, at, word, self.folded(h, first))
        counted = self.counted(h, first, at, word)
        if counted:
            _, start, end, passage = np.array(counted).T
            # no stretch in the window has a longer common subsequence than the window
            tried += [(*counted[i][:2], counted[i][3], None) for i in np.flatnonzero(self.longest(at, word, start, end, passage) >= self.need[passage]).tolist()]
        if tried:
            text, start, passage = np.array([x[:3] for x in tried]).T
            n = self.lengths[passage]
            same = self.longest(at, word, np.maximum(first[text], start - n), np.minimum(first[text + 1], start + self.basis.scale[passage] + n), passage)
            tried = [tried[i] for i in np.flatnonzero(self.placed[passage] | (same >= p.told * n - 1e-9)).tolist()]
        for text, start, passage, cos in tried:
            a = int(first[text])
            share, answer, x, y = self.verify(h, a, int(first[text + 1]), start, passage)
            if share < p.told:
                continue
            if (text, passage, x, y) not in done:
                done[text, passage, x, y] = self.cosine(h[a + x : a + y], passage)
            cos = max(done[text, passage, x, y], cos or 0.0)
            if share >= p.near or (answer >= p.answer and (share >= p.loose or (cos >= p.cosine and self.told(h[a + x : a + y], passage) >= p.told))):
                key = (text, self.basis.passages[passage][0])
                row = (share, cos, answer, x, y)
                if key not in found or row > found[key]:
                    found[key] = row
        return [(t, item, cos, share, answer, x, y) for (t, item), (share, cos, answer, x, y) in found.items()]


_MATCH = "doc_id long, item_id long, cosine double, lcs_share double, answer_share double, first_word long, end_word long"


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", params: LeakParams = LeakParams()) -> DataFrame:
    """One row for each document and benchmark item that is in it."""
    return _found(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), benchmark, item_col, item_text_col, params)


def _found(texts: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, params: LeakParams) -> DataFrame:
    """``matches`` of (doc_id, text), with a doc_id of any type."""
    p, spark, schema = params, texts.sparkSession, _MATCH.replace("long", dict(texts.dtypes)["doc_id"], 1)
    # rows are told apart by their texts as well: ids may be null or repeated
    rows = texts.select(F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")).alias("doc_id"), "text")
    idf, n = word_weights(texts, "text", p)
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text"))
    passages = stage(map_texts(items, _passages(p), "item long, part int, words array<long>"), "leak-passages")
    count = passages.count()
    if not count:
        return spark.createDataFrame([], schema)
    drawn = lambda rows, k: rows.where(F.pmod(F.xxhash64("text"), F.lit(max(1, -(-k // p.fit_passages)))) == 0).select("text")
    sample = drawn(texts, n).unionByName(drawn(items, count)).repartition(p.fit_tasks, F.xxhash64("text"))
    start, value = _leading(stage(map_texts(sample, _fit_rows(idf, p), "bins array<int>, weights array<float>"), "leak-fit"), p)
    # what the start has no direction for begins anywhere
    start = np.where(value > 1e-6, start, np.random.default_rng(p.seed).standard_normal(start.shape))
    space = whole_space(texts.select("text").unionByName(items.select("text")), np.linalg.qr(start)[0].astype(np.float32), idf, p, n + count)
    blocks = max(1, -(-count // p.block))
    passages = passages.withColumn("block", F.pmod(F.xxhash64("item", "part", "words"), F.lit(blocks)))
    fitted = stage(passages.groupBy("block").applyInArrow(_fit(idf, space, p), "block long, bytes long, basis binary"), "leak-bases")

    out, groups = [], _groups([tuple(r) for r in fitted.select("block", "bytes").orderBy("block").collect()], p.broadcast_bytes)
    for group in groups:
        bases = [pickle.loads(bytes(r[0])) for r in fitted.where(F.col("block").isin(group)).orderBy("block").select("basis").collect()]
        part = map_texts(rows, _search(bases, idf, space, p), _MATCH.replace("long", dict(rows.dtypes)["doc_id"], 1))
        out.append(part if len(groups) == 1 else stage(part.withColumn("group", F.lit(len(out))), "leak-found"))
    every = reduce(DataFrame.unionByName, out)
    rest = [x.split()[0] for x in _MATCH.split(", ")][1:]
    if len(groups) > 1:
        # each pass has found what a row holds of its items, rows that are equal as often as they are there
        best = lambda m: F.max_by(m, F.struct("lcs_share", "cosine", "first_word"))
        every = every.groupBy("doc_id", "item_id", "group").agg(best(F.struct(*rest[1:])).alias("m"), F.count("*").alias("copies")).select("doc_id", "item_id", "copies", "m.*")
        every = every.groupBy("doc_id", "item_id").agg(best(F.struct(*rest[1:])).alias("m"), F.max("copies").alias("copies"))
        every = every.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc_id", "item_id", "m.*")
    return every.select("doc_id.doc_id", *rest)


def _groups(sizes: list[tuple[int, int]], most: int) -> list[list[int]]:
    groups, held = [], 0
    for block, size in sizes:
        if not groups or held + size > most:
            groups.append([])
            held = 0
        groups[-1].append(block)
        held += size
    return groups


def _search(bases: list[Basis], idf: np.ndarray, space: np.ndarray, p: LeakParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Search(b, idf, space, p) for b in bases]
        for batch in batches:
            best: dict[tuple, tuple] = {}
            for a, _, raw, offs in slices(batch.column(1)):
                for s in searches:
                    for text, *r in s.slice(raw, offs):
                        key, own = (a + text, r[0]), (r[2], r[1], r[4])  # share, cosine, first word
                        if key not in best or own > best[key][0]:
                            best[key] = (own, (a + text, *r))
            rows = [row for _, row in best.values()]
            ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
            kinds = (pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
            cols = [pa.array([r[i + 1] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([ids, *cols], names=[x.split()[0] for x in _MATCH.split(", ")])

    return run


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: LeakParams = LeakParams()) -> DataFrame:
    """The documents in which no benchmark item is, with all their columns. Rows that share an id share the verdict; a
    row with a null id has the verdict of its own text."""
    text = F.col(text_col).cast("string")
    key = F.coalesce(F.concat(F.lit("s"), F.col(id_col).cast("string")), F.concat(F.lit("n"), F.md5(text)), F.lit("n"))
    found = _found(docs.select(key.alias("doc_id"), text.alias("text")), benchmark, "item_id", "text", params)
    bad = stage(found.select(F.col("doc_id").alias("_bad")).distinct(), "leak-ids")  # its size is known then
    return docs.join(bad, key == bad["_bad"], "left_anti")
