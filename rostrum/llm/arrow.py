"""Words of Arrow text columns as numpy arrays.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return, which is also a run of such characters, as texts are UTF-8. Word hashes are
64-bit polynomials over the bytes, computed with running sums, so that no Python object
exists per word. Work goes in slices of rows of a few megabytes, whatever the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2_000_000
WINDOW_BYTES = 262_144

_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_SHINGLE = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


_UP = _powers(_BASE, WINDOW_BYTES + 1)
_DOWN = _powers(_INVERSE, WINDOW_BYTES + 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finishing step of a 64-bit hash (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, ends, body = column.buffers()
    offsets = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


@dataclass
class Words:
    """Words of the rows ``first`` to ``last`` of a batch; places are in ``data``."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray

    @property
    def bounds(self) -> np.ndarray:
        """Number of words before each row of the slice, and in all."""
        return np.searchsorted(self.starts, self.offsets)

    @property
    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.last - self.first), np.diff(self.bounds))

    def text(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes; a longer row is a run of its own."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end; a row's end also ends a word."""
    inside = ~SPACE[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.empty(len(data), bool)
    fresh[0] = True
    np.logical_not(inside[:-1], out=fresh[1:])
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    fresh[cuts] = True
    starts = np.flatnonzero(fresh & inside)
    last = np.empty(len(data), bool)
    last[-1] = True
    last[:-1] = fresh[1:]
    last[:-1] |= ~inside[1:]
    ends = np.flatnonzero(last & inside) + 1
    return starts, ends


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each span; ``fold`` lower-cases A-Z."""
    table = _FOLDED if fold else _BYTE
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        a = starts[k]
        j = int(np.searchsorted(ends, a + WINDOW_BYTES, "right"))
        if j == k:  # one word beyond the window
            out[k] = _long_word(table[data[a : ends[k]]])
            k += 1
            continue
        b = ends[j - 1]
        sums = np.empty(b - a + 1, np.uint64)
        sums[0] = 0
        np.cumsum(table[data[a:b]] * _UP[: b - a], out=sums[1:])
        s, e = starts[k:j] - a, ends[k:j] - a
        out[k:j] = (sums[e] - sums[s]) * _DOWN[s]
        k = j
    return mix(out)


def _long_word(values: np.ndarray) -> np.uint64:
    total, scale = 0, 1
    for a in range(0, len(values), WINDOW_BYTES):
        part = values[a : a + WINDOW_BYTES]
        total = (total + scale * int((part * _UP[: len(part)]).sum(dtype=np.uint64))) % 2**64
        scale = scale * pow(_BASE, len(part), 2**64) % 2**64
    return np.uint64(total)


def words(column: pa.Array, fold: bool = True, most: int = SLICE_BYTES) -> Iterator[Words]:
    """The words of a text column, by slices of rows."""
    data, offsets = utf8(column)
    for first, last in slices(offsets, most):
        a, b = offsets[first], offsets[last]
        part, cuts = data[a:b], offsets[first : last + 1] - a
        starts, ends = spans(part, cuts)
        yield Words(first, last, part, cuts, starts, ends, hash_spans(part, starts, ends, fold))


def shingles(w: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` words and their number before each row (and in all).

    A row of fewer words has its whole sequence as one; a row without words has none.
    """
    bounds = w.bounds
    counts = np.diff(bounds)
    sizes = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(ends[-1], np.uint64)
    total = len(w.hashes)
    if total >= n:
        m = total - n + 1
        acc = w.hashes[:m] * _SHINGLE[0]
        for k in range(1, n):
            acc += w.hashes[k : k + m] * _SHINGLE[k]
        long = counts >= n
        take = np.repeat(bounds[:-1][long] - ends[:-1][long], sizes[long])
        spot = np.flatnonzero(np.repeat(long, sizes))
        out[spot] = acc[spot + take]
    for r in np.flatnonzero((counts > 0) & (counts < n)):
        part = w.hashes[bounds[r] : bounds[r + 1]]
        out[ends[r]] = (part * _SHINGLE[: len(part)]).sum(dtype=np.uint64) + np.uint64(len(part))
    return mix(out), ends


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of runs ``starts[k] : starts[k] + sizes[k]``, one after the other."""
    total = int(sizes.sum())
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    return shift + np.arange(total)
