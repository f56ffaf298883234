"""Columnar text primitives shared by the training-data operators.

Arrow string columns are read as one byte buffer and cut into words, hashed and
shingled with numpy, so the cost is a few vector passes over the bytes and no
Python object is made per word.  A *word* is ``[^\\x20\\x09-\\x0D]+``; a null text
has no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled by one vector pass; bounds a worker's memory whatever the batch.
SLICE_BYTES = 2 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
KEEP = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xBF58476D1CE4E5B9)
_M3 = np.uint64(0x94D049BB133111EB)
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (public splitmix constants)."""
    x = x ^ (x >> _U(30))
    x = x * _M2
    x ^= x >> _U(27)
    x = x * _M3
    x ^= x >> _U(31)
    return x


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def text_bytes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes (padded by 8) and the n + 1 offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return np.zeros(8, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    size = int(off[-1] - off[0])
    out = np.zeros(size + 8, np.uint8)
    if size:
        out[:size] = np.frombuffer(data, np.uint8)[off[0] : off[-1]]
        if lower:
            out[:size] = _LOWER[out[:size]]
    return out, off - off[0]


@dataclass
class Words:
    """Words of several texts: byte spans, the row of each, and the n + 1 offsets of the rows."""

    data: np.ndarray
    rows: np.ndarray  # byte offsets of the rows
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # word offsets of the rows

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        view = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))
        size = self.ends - self.starts
        h = size.astype(np.uint64) * _M1
        at, left, idx = self.starts, size, None
        while len(at):
            x = view[at] & KEEP[np.minimum(left, 8)]
            if idx is None:
                h = mix64(h ^ x)
            else:
                h[idx] = mix64(h[idx] ^ x)
            more = np.flatnonzero(left > 8)
            idx = more if idx is None else idx[more]
            at, left = at[more] + 8, left[more] - 8
        return h


def cut_words(column: pa.Array, lower: bool = False) -> Words:
    data, rows = text_bytes(column, lower)
    n = int(rows[-1])
    solid = np.empty(n + 2, dtype=bool)
    solid[0] = solid[-1] = False
    np.logical_not(_SPACE[data[:n]], out=solid[1:-1])
    body = solid[1:-1]
    before = solid[:-2].copy()
    before[rows[:-1][rows[:-1] < n]] = False
    starts = np.flatnonzero(body & ~before)
    after = solid[2:].copy()
    cut = rows[1:]
    after[cut[cut > 0] - 1] = False
    ends = np.flatnonzero(body & ~after) + 1
    return Words(data, rows, starts, ends, np.searchsorted(starts, rows))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word hashes (len(h) - k + 1 of them, rows not yet heeded).

    Runs are doubled (1, 2, 4 ... words) and joined by the bits of k, so k costs log2(k) passes.
    """
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc, acc_len, run, run_len, left = None, 0, h, 1, k
    mult = lambda words: _U(pow(0xD1342543DE82EF95, words, 1 << 64))
    while left:
        if left & 1:
            acc = run if acc is None else acc[: len(h) - acc_len - run_len + 1] * mult(run_len) + run[acc_len : acc_len + len(h) - acc_len - run_len + 1]
            acc_len += run_len
        left >>= 1
        if left:
            m = len(run) - run_len
            run = run[:m] * mult(run_len) + run[run_len : run_len + m]
            run_len *= 2
    return mix64(acc[:n])


def within_rows(first: np.ndarray, k: int) -> np.ndarray:
    """Mask over window starts 0 .. words - k: those whose k words lie in one row."""
    n = int(first[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.ones(n + k, bool)
    ends = first[1:][first[1:] > 0]
    for back in range(1, k):
        at = ends - back
        ok[at[at >= 0]] = False
    return ok[:n]


def covered(starts: np.ndarray, k: int, n: int) -> np.ndarray:
    """Mask over n words: those covered by a k-word window at one of the starts."""
    step = np.bincount(starts, minlength=n + 1) - np.bincount(starts + k, minlength=n + 1)
    return np.cumsum(step)[:n] > 0


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over the rows given by offsets; empty rows give 0."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows of about `limit` text bytes (one long row at least)."""
    if batch.num_rows == 0:
        return
    size = np.asarray(pc.binary_length(batch.column(column)).fill_null(0)).astype(np.int64)
    total = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        base = int(total[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to
