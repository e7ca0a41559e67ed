"""Sets of word shingles as sorted 64-bit hashes, computed with array operations.

Words are runs of bytes other than blank, tab, line feed, vertical tab, form feed and carriage
return, with A-Z lower-cased. A word's hash is a polynomial over its bytes, a shingle's hash one over
its words, both modulo 2^64 and mixed.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

_BYTE = np.arange(1, 257, dtype=U)
_BYTE[65:91] = _BYTE[97:123]
_BYTE[[9, 10, 11, 12, 13, 32]] = 0
_powers = {BASE: np.ones(1, U), INVERSE: np.ones(1, U)}


def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of a base, from a table that grows with the longest text seen."""
    if len(_powers[base]) < n:
        steps = np.full(max(n, 1 << 16), base, U)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=U)
    return _powers[base][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole word (fixed constants of a public 64-bit finaliser)."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def word_hashes(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    values = _BYTE[raw]
    inside = values != 0
    starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]])) if len(raw) else np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros(0, U)
    # a word at any place hashes alike, as the power of its first byte is divided out
    sums = np.add.reduceat(values * powers(BASE, len(raw)), starts)
    return mixed(sums * powers(INVERSE, len(raw))[starts])


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words make one shingle, no words none."""
    words = word_hashes(text)
    if not len(words):
        return words
    # the width enters the hash, so a short text's one shingle equals no full one
    n = min(width, len(words))
    out = np.full(len(words) - n + 1, n, U)
    for i in range(n):
        out = out * U(BASE) + words[i : i + len(out)]
    return np.unique(mixed(out))
