"""Words and word shingles of whole Arrow batches, hashed with numpy.

A word's hash is a polynomial over its bytes, taken from prefix sums modulo
2**64 and mixed; a shingle's hash combines those of its words.  Work goes in
slices of half a MB of text, so memory is bounded by a slice and the longest
single text; what a worker keeps for later slices is bounded by a slice alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _byte_codes() -> np.ndarray:
    """A code for each byte, the same for A-Z and a-z."""
    low = np.arange(256)
    low[65:91] += 32
    return mix((low.astype(np.uint64) + _U(1)) * _U(_BASE))


_CODES = _byte_codes()
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse; those of a slice are kept, a longer text has its own."""
    if _powers and n <= len(_powers[0]):
        return _powers[0], _powers[1]
    size = max(n, SLICE_BYTES + 1)
    made = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, _INVERSE)]
    if size == SLICE_BYTES + 1:
        _powers[:] = made
    return made[0], made[1]


def slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about SLICE_BYTES; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    if not len(column):
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row) of each word, and where each row's words start (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:]))
    power, inverse = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODES[data] * power[:n], out=total[1:])
    found = mix((total[ends + 1] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    first = np.searchsorted(starts, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return found, row, first


def sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles, ascending within each row, and where each row's start.

    A row with fewer words has its whole sequence as one shingle; a row
    without words has none.
    """
    w, _, first = words(data, offsets)
    counts = np.diff(first)
    c = _U(0xD6E8FEB86659FD93)
    h = np.zeros(max(0, len(w) - k + 1), np.uint64)
    for i in range(k):
        h = h * c + w[i : i + len(h)]
    h = mix(h)
    per_row = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(per_row)])
    out = np.empty(at[-1], np.uint64)
    for r in np.flatnonzero(counts):
        a, b, s = first[r], first[r + 1], at[r]
        if b - a >= k:
            part = out[s : at[r + 1]]
            part[:] = h[a : b - k + 1]
            part.sort()
        else:
            x = np.full(1, 0x632BE59BD9B4E019, np.uint64)
            for i in range(a, b):
                x = mix(x * c + w[i : i + 1])
            out[s] = x[0]
    if len(out):
        new = np.ones(len(out), bool)
        new[1:] = out[1:] != out[:-1]
        new[at[:-1][per_row > 0]] = True
        at = np.concatenate([[0], np.cumsum(new)])[at]
        out = out[new]
    return out, at
