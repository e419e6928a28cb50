"""Words of an Arrow batch by other rules than white space, hashed in blocks, so that a long text needs no long tables."""

from __future__ import annotations

import numpy as np

from .textbytes import CHUNK, LOWER, span_hashes, words


def separators(inside: bytes | None = None, outside: bytes = b"") -> np.ndarray:
    """A flag per byte: what cuts words. Give the ASCII bytes inside words, or those outside; other bytes are inside."""
    cut = np.zeros(256, bool)
    if inside is not None:
        cut[:128] = True
        cut[np.frombuffer(inside, np.uint8)] = False
    cut[np.frombuffer(outside, np.uint8)] = True
    return cut


def hashed(raw: np.ndarray, offsets: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, byte after the last, row) of every word, A-Z as a-z."""
    start, end, row = words(raw, offsets, cut)
    out = np.empty(len(start), np.uint64)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + CHUNK, "right")))
        a, b = start[lo], end[hi - 1]
        out[lo:hi] = span_hashes(LOWER[raw[a:b]], start[lo:hi] - a, end[lo:hi] - a)
        lo = hi
    return out, start, end, row
