"""Texts of an Arrow batch as one byte array, and the words in it, without a Python object per word.

Words are runs of bytes other than space and \\t \\n \\v \\f \\r. Their hashes have 64 bits and see A-Z as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 2 << 20  # bytes of text handled at once; a longer text is a chunk of its own

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets (rows + 1); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def chunks(raw: np.ndarray, offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows of about limit bytes."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 4096)
        steps = np.ones(size, np.uint64)
        back = np.ones(size, np.uint64)
        steps[1:], back[1:] = np.uint64(_BASE), np.uint64(_INVERSE)
        _powers[:] = [np.multiply.accumulate(steps), np.multiply.accumulate(back)]
    return _powers[0], _powers[1]


def words(raw: np.ndarray, offsets: np.ndarray, cut: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte after the last, row) of every word; `cut` flags the bytes between words."""
    n = len(raw)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~cut[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < n]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = inside[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes: differences of one running sum over powers of a fixed odd number."""
    power, back = _power_tables(len(raw) + 1)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    np.multiply(raw, power[: len(raw)], out=sums[1:])
    sums[1:] += power[: len(raw)]
    np.cumsum(sums[1:], out=sums[1:])
    return mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hashes(LOWER[raw], start, end)


def shingles(hashes: np.ndarray, row: np.ndarray, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of k words of a row; a row with fewer words has its whole sequence as one,
    a row without words none."""
    n = len(hashes)
    out = np.zeros(max(0, n - k + 1), np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(3) + hashes[j : n - k + 1 + j]) if len(out) else out
    same = row[k - 1 :] == row[: n - k + 1] if len(out) else np.zeros(0, bool)
    counts = np.bincount(row, minlength=rows) if n else np.zeros(rows, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if not len(short):
        return out[same], row[: len(out)][same]
    begin = np.concatenate([[0], np.cumsum(counts)])[:-1]
    extra = np.zeros(len(short), np.uint64)
    for j in range(k - 1):
        has = counts[short] > j
        at = np.minimum(begin[short] + j, n - 1)
        extra = np.where(has, mix(extra * np.uint64(5) + hashes[at] + np.uint64(j + 1)), extra)
    h, r = np.concatenate([out[same], extra]), np.concatenate([row[: len(out)][same], short])
    order = np.argsort(r, kind="stable")
    return h[order], r[order]
