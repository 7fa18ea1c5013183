"""The words of a batch of texts as arrays: places, lines and hashes, without a Python object for each word.

Hashes of runs of words are differences of one running polynomial sum, so a run of any length costs the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_BACK = pow(_BASE, -1, 1 << 64)
#: Bytes of a word that are hashed with those of all words at once; longer words one by one.
SHORT = 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, U)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=U)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]."""
    size = end - start
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    with np.errstate(over="ignore"):
        out = size.astype(U) * _ODD
        for at in range(0, SHORT, 8):
            live = np.flatnonzero(size > at) if at else slice(None)
            if at and not len(live):
                break
            rest = size[live] - at
            lot = eight[start[live] + at]
            part = rest < 8
            lot = np.where(part, lot & ((U(1) << (U(8) * np.where(part, rest, 0).astype(U))) - U(1)), lot)
            out[live] = mixed(out[live] * _ODD + lot)
    for k in np.flatnonzero(size > SHORT).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]].tobytes())
    return out


class Words:
    """Of all words in a column of texts: ``doc`` (row), ``start`` and ``end`` (code points in the text), ``h`` (hash);
    ``first`` and ``last``: the words from and up to which each line with words goes.  ``chars``: length of each text."""

    def __init__(self, column: pa.Array):
        column = column.fill_null("").cast(pa.large_binary())
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
        raw = column.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        size = len(data)
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        edge = np.zeros(size + 1, bool)  # a text starts here
        edge[offsets] = True
        before = np.ones(size + 1, bool)  # what stands before is no part of the same word
        before[1:] = blank
        before |= edge
        start = np.flatnonzero(~blank & before[:-1])
        end = np.flatnonzero(~blank & np.r_[blank[1:] | edge[1:-1], True]) + 1 if size else start
        points = np.zeros(size + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=points[1:])
        breaks = np.zeros(size + 1, np.int64)
        np.cumsum(data == 10, out=breaks[1:])
        self.doc = np.searchsorted(offsets, start, side="right") - 1
        self.chars = np.diff(points[offsets])
        base = points[offsets[self.doc]]
        self.start, self.end = points[start] - base, points[end] - base
        self.h = hashes(data, start, end)
        line = breaks[start]
        new = np.ones(len(start), bool)
        new[1:] = (line[1:] != line[:-1]) | (self.doc[1:] != self.doc[:-1])
        self.first = np.flatnonzero(new)
        self.last = np.r_[self.first[1:], len(start)] if len(start) else self.first
        with np.errstate(over="ignore"):
            self._sum = np.r_[U(0), np.cumsum(self.h * _powers(_BASE, len(start))[: len(start)], dtype=U)]
        self._back = _powers(_BACK, len(start))

    def __len__(self) -> int:
        return len(self.h)

    def run(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hashes of the words from a up to b."""
        with np.errstate(over="ignore"):
            return mixed((self._sum[b] - self._sum[a]) * self._back[a] + (b - a).astype(U) * _ODD)

    def runs(self, size: int) -> np.ndarray:
        """Hashes of ``size`` words from each word on, over all ends of lines and texts."""
        a = np.arange(max(0, len(self) - size + 1))
        return self.run(a, a + size)

    def line(self) -> np.ndarray:
        """The line of each word."""
        return np.repeat(np.arange(len(self.first)), self.last - self.first)


def slices(batches, text: str, most: int = 1 << 20, rows: int = 1024):
    """Arrow batches in slices of about a MB of text: a longer text is a slice of its own."""
    for batch in batches:
        size = np.cumsum(np.r_[0, np.array([x or 0 for x in pc.binary_length(batch.column(text)).to_pylist()], np.int64)])
        at = 0
        while at < batch.num_rows:
            to = min(max(at + 1, int(np.searchsorted(size, size[at] + most, side="right")) - 1), at + rows, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to
