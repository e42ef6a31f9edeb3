"""Words of Arrow string columns as numpy arrays: no Python string per word, one pass per slice of a batch.

A slice holds whole texts, about ``SLICE_BYTES`` of them (one longer text is a slice by itself), so memory in a task
does not depend on how many rows Arrow puts into a batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE_BYTES = 256 << 10
#: Rows of an Arrow batch of texts; Spark's own limit (10,000) makes batches of tens of megabytes on both sides.
BATCH_ROWS = 1000
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def map_texts(rows: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` over rows with texts, in batches of at most ``BATCH_ROWS`` (a session's smaller limit stays)."""
    conf, key = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return rows.mapInArrow(run, schema)


def word_mask(outside: list[int], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Tables of 256: is a byte part of a word, and the byte in lower case (A-Z only)."""
    inside = np.ones(256, bool)
    inside[outside] = False
    folded = np.arange(256, dtype=np.uint8)
    if lower:
        folded[65:91] += 32
    return inside, folded


#: Words between white space.
SPACE = [0x20, *range(0x09, 0x0E)]
#: Words of letters, digits and all that is not ASCII.
MARKS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def slices(col: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts."""
    raw, offs = buffers(col)
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + size, "right")) - 1)
        yield a, b, raw[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


@dataclass
class Words:
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # per text, the index of its first word; one more at the end

    def per_text(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(raw: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> Words:
    n = len(raw)
    if not n:
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64))
    on = inside.take(raw)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = on[:-1]
    before[offs[offs < n]] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = on[1:]
    after[offs[offs > 0] - 1] = False
    starts = np.flatnonzero(on & ~before)
    ends = np.flatnonzero(on & ~after) + 1
    return Words(starts, ends, np.searchsorted(starts, offs))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            inverse = np.uint64(pow(int(_P), -1, 1 << 64))
            _powers[0] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _P, np.uint64)]), dtype=np.uint64)
            _powers[1] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, inverse, np.uint64)]), dtype=np.uint64)
    return _powers[0], _powers[1]


def mix64(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def hashes(raw: np.ndarray, w: Words, folded: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word that depends on its bytes only (prefix sums of a polynomial)."""
    n = len(raw)
    up, down = _power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    own = (folded.astype(np.uint64) + np.uint64(1)).take(raw)
    own *= up[:n]
    np.cumsum(own, out=sums[1:])
    return mix64((sums.take(w.ends) - sums.take(w.starts)) * down.take(w.starts))


def gram_hashes(raw: np.ndarray, size: int) -> np.ndarray:
    """``hashes`` of the ``size`` bytes at each place."""
    n = len(raw)
    if n < size:
        return np.zeros(0, np.uint64)
    up, down = _power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return mix64((sums[size:] - sums[:-size]) * down[: n - size + 1])


def hash_words(words_: list[str]) -> np.ndarray:
    """``hashes`` of given words, already in the wanted case."""
    col = pa.array(words_, pa.string())
    raw, offs = buffers(col)
    w = Words(offs[:-1], offs[1:], np.arange(len(offs)))
    return hashes(raw, w, np.arange(256, dtype=np.uint8))
