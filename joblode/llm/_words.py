"""Vectorised words, windows and hashes over Arrow string columns (numpy, no per-word Python)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = U(0x9E3779B97F4A7C15)
_BACK = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.int64).astype(U) | U(1)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd base modulo 2**64, and their inverses."""
    global _powers
    if _powers is None or len(_powers[0]) < n:
        n = max(n, 1 << 16)
        up, down = np.full(n, _STEP), np.full(n, _BACK)
        up[0] = down[0] = 1
        _powers = np.cumprod(up), np.cumprod(down)
    return _powers


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser: every output bit depends on every input bit."""
    h = h ^ U(salt)
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of values[i:i+width] for every i (not yet mixed; len(values)-width+1 of them)."""
    if len(values) < width:
        return np.zeros(0, U)
    up, down = powers(len(values))
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return (sums[width:] - sums[:-width]) * down[: len(sums) - width]


class Text:
    """Bytes of some rows, with the offset of each row."""

    def __init__(self, column: pa.Array):
        column = column.fill_null("") if column.null_count else column
        if column.type != pa.string():
            column = column.cast(pa.string())
        offsets, data = column.buffers()[1:3]
        self.n = len(column)
        at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + self.n + 1] if self.n else np.zeros(1, np.int32)
        self.data = (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[at[0] : at[-1]]
        self.at = (at - at[0]).astype(np.int64)

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """Number of set flags (one for each byte) in each row."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.at[1:]] - sums[self.at[:-1]]


class Words:
    """start, end, row and hash of each word; first: index of each row's first word (rows+1 of them)."""

    def __init__(self, text: Text, space: np.ndarray = SPACE, hashes: bool = True):
        gap = space[text.data]
        before, after = np.ones(len(gap), bool), np.ones(len(gap), bool)
        before[1:], after[:-1] = gap[:-1], gap[1:]
        edge = text.at[1:-1][(text.at[1:-1] < len(gap)) & (text.at[1:-1] > 0)]
        before[edge], after[edge - 1] = True, True
        self.start = np.flatnonzero(~gap & before)
        self.end = np.flatnonzero(~gap & after) + 1
        self.first = np.searchsorted(self.start, text.at)
        self.row = np.repeat(np.arange(text.n), np.diff(self.first))
        if hashes:
            self.sums = byte_sums(text.data)
            self.hash = self.hashed(self.start, self.end)

    def hashed(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * powers(len(self.sums))[1][start] + (end - start).astype(U))

    def index(self) -> np.ndarray:
        """Index of each word in its row."""
        return np.arange(len(self.start)) - self.first[self.row]


def byte_sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * powers(len(data) + 1)[0][: len(data)], out=sums[1:])
    return sums


def windows(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unmixed hash of each run of ``width`` words, and whether the run lies in one row."""
    h = rolling(words.hash, width)
    return h, words.row[: len(h)] == words.row[width - 1 :] if len(h) else np.zeros(0, bool)


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``limit`` bytes of text each (one longer row stands alone)."""
    col = batch.column(batch.schema.get_field_index(column))
    size = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0)).astype(np.int64)
    begin = total = 0
    for i, n in enumerate(size):
        if total and total + n > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += int(n)
    if begin < batch.num_rows:
        yield batch.slice(begin)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each maximal run of set flags."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edge[::2], edge[1::2]


def cover(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Flags of the n places that some [start, end) covers."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, np.minimum(end, n), -1)
    return np.cumsum(step)[:n] > 0
