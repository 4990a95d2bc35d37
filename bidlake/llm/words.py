"""Words of whole texts as 64-bit hashes, by array operations over a block of documents."""

from __future__ import annotations

import numpy as np

from .common import mix

#: Odd multiplier of the polynomial word hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the table is kept and grows as needed."""
    table = _POWERS.get(base)
    if table is None or len(table) < n:
        size = 1 << max(16, int(n).bit_length())
        table = np.full(size, base, np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        _POWERS[base] = table
    return table[:n]


def byte_class(is_word) -> np.ndarray:
    """A table of 256 flags: which bytes belong to words."""
    return np.fromiter((bool(is_word(b)) for b in range(256)), bool, 256)


#: Lower-cases A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lowered(raw: np.ndarray) -> np.ndarray:
    return LOWER[raw]


def word_bounds(raw: np.ndarray, offsets: np.ndarray, classes: np.ndarray):
    """Byte spans [start, end) of all words, and for each document the index of its first
    word (one more entry than documents). No word crosses documents."""
    n = len(raw)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = classes[raw]
    step = np.diff(inside)
    starts, ends = step[:-1] == 1, step[1:] == -1
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    both = cut[(inside[cut + 1] == 1) & (inside[cut] == 1)]
    starts[both] = True
    ends[both - 1] = True
    begin = np.flatnonzero(starts[:n])
    end = np.flatnonzero(ends[:n]) + 1
    return begin, end, np.searchsorted(begin, offsets)


def word_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, equal for equal bytes."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    n = len(raw)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=total[1:])
    value = (total[end] - total[begin]) * powers(INVERSE, n + 1)[begin]
    return mix(value ^ (end - begin).astype(np.uint64))
