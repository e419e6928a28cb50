"""Cuts texts into the pieces that byte-level BPE works on, over a whole byte array at once.

The rule is that of the public byte-level pre-tokenizer: the endings 's 't 're 've 'm 'll 'd; an optional
space with letters, with digits or with other signs; white space, of which the last character stays with
the next piece if it is a space and is a piece of its own otherwise. The text of the end mark is one piece.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import regex

from .textbytes import mix

END_MARK = b"<|endoftext|>"

_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the first n bytes of eight

_WHITE, _LETTER, _DIGIT, _OTHER, _MARK = 0, 1, 2, 3, 4


@functools.cache
def kinds() -> np.ndarray:
    """The kind of every code point."""
    table = np.full(0x110000, _OTHER, np.uint8)
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    whole = "".join(points)
    for kind, what in ((_LETTER, r"\p{L}+"), (_DIGIT, r"\p{N}+"), (_WHITE, r"\p{White_Space}+")):
        for m in regex.finditer(what, whole):
            at = [i if i < 0xD800 else i + 0x800 for i in (m.start(), m.end() - 1)]
            table[at[0] : at[1] + 1] = kind
    return table


def _byte_kinds(raw: np.ndarray) -> np.ndarray:
    """The kind of the character that each byte belongs to."""
    table = kinds()
    out = table[:256][raw]
    lead = np.flatnonzero(raw >= 0xC0)
    if len(lead):
        b0 = raw[lead].astype(np.int32)
        size = 2 + (b0 >= 0xE0) + (b0 >= 0xF0)
        point = np.where(size == 2, b0 & 31, np.where(size == 3, b0 & 15, b0 & 7))
        last = len(raw) - 1
        for j in (1, 2, 3):
            point = np.where(size > j, (point << 6) | (raw[np.minimum(lead + j, last)] & 63), point)
        kind = table[np.minimum(point, 0x10FFFF)]
        out[lead] = kind
        for j in (1, 2, 3):
            has = size > j
            out[np.minimum(lead[has] + j, last)] = kind[has]
    return out


def boundaries(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of all pieces; pieces lie without gaps and never cross a row."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64)
    kind = _byte_kinds(raw)
    forced = np.zeros(n + 1, bool)  # a row or an end mark begins or ends here
    forced[offsets] = True
    marks = _marks(raw, offsets)
    for at in marks:
        kind[at : at + len(END_MARK)] = _MARK
        forced[[at, at + len(END_MARK)]] = True
    first = np.ones(n, bool)
    first[1:] = (kind[1:] != kind[:-1]) | forced[1:n]

    white = kind == _WHITE
    # runs of signs that follow white space of the same row: its last character is a matter of its own
    after = np.flatnonzero(first[1:] & white[:-1] & ~white[1:] & ~forced[1:n]) + 1
    space = raw[after - 1] == 32
    first[after[space]] = False
    first[after[space] - 1] = True
    odd = after[~space] - 1
    while len(odd):  # the first byte of that character
        tail = (raw[odd] & 0xC0) == 0x80
        first[odd[~tail]] = True
        odd = odd[tail] - 1

    quote = np.flatnonzero((raw == 39) & first & (kind == _OTHER))
    if len(quote):
        gone = np.concatenate([raw, np.zeros(3, np.uint8)])
        one, two = gone[quote + 1], gone[quote + 2]
        free1 = ~forced[np.minimum(quote + 1, n)]
        free2 = free1 & ~forced[np.minimum(quote + 2, n)]
        short = free1 & np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = free2 & (((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108)))
        for which, size in ((short, 2), (long, 3)):
            at = quote[which]
            first[at + 1] = False
            end = at + size
            first[end[end < n]] = True
    return np.flatnonzero(first)


def _marks(raw: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Places of the end mark; one that would cross rows is none."""
    if not (raw == END_MARK[1]).any():
        return []
    data, out, at = raw.tobytes(), [], 0
    while (at := data.find(END_MARK, at)) >= 0:
        row = int(np.searchsorted(offsets, at, "right"))
        if at + len(END_MARK) <= offsets[row]:
            out.append(at)
            at += len(END_MARK)
        else:
            at += 1
    return out


def distinct(raw: np.ndarray, first: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The different pieces and, for every piece, which of them it is. Pieces of up to 24 bytes are grouped by
    a hash of three words of eight bytes and compared with the first of the group; longer ones and, should a hash have
    clashed, all others are grouped as Python strings."""
    size = np.diff(np.append(first, len(raw)))
    loads = np.lib.stride_tricks.as_strided(np.concatenate([raw, np.zeros(32, np.uint8)])[: len(raw) + 24].view(np.uint8), (len(raw) + 17, 8), (1, 1)).view(np.uint64)[:, 0] if len(raw) else None
    parts, key = [], size.astype(np.uint64)
    for at in (0, 8, 16):
        has = np.clip(size - at, 0, 8)
        parts.append(loads[np.where(has > 0, first + at, 0)] & _MASKS[has])
        key = mix(key + parts[-1])
    long = np.flatnonzero(size > 24)
    data = raw.tobytes()
    if len(long):
        numbers: dict[bytes, int] = {}
        for i in long.tolist():
            text = data[first[i] : first[i] + size[i]]
            key[i] = numbers.setdefault(text, len(numbers))
    which, seen = pd.factorize(key)
    where = np.empty(len(seen), np.int64)
    where[which[::-1]] = np.arange(len(first) - 1, -1, -1)  # the first piece of each group
    like = where[which]
    same = (size == size[like]).all() and all((p == p[like]).all() for p in parts)
    begin, end = first[where], first[where] + size[where]
    if same:
        return [data[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)], which
    which, seen = pd.factorize(np.array([data[a : a + n] for a, n in zip(first.tolist(), size.tolist(), strict=True)], object))
    return seen.tolist(), which


def spread(counts: np.ndarray, starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a sequence of items (which), the places of all their parts in a flat array in which item i has
    counts[i] parts from starts[i]; also the number of parts before each item, total last."""
    sizes = counts[which]
    ends = np.zeros(len(which) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    places = np.arange(ends[-1], dtype=np.int64)
    places += np.repeat(starts[which] - ends[:-1], sizes)
    return places, ends
