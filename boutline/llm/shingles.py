"""Word shingles of a text as 64-bit hashes, computed with array operations."""

from __future__ import annotations

import numpy as np

_BLANK = np.zeros(256, np.bool_)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
BASE = 0x100000001B3 * 0x9E3779B1 % (1 << 64) | 1
_INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 16)
        for k, base in enumerate((BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums; the hash of data[s:e] is ``mix((p[e] - p[s]) * inverse[s])``."""
    forward, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * forward[: len(data)], out=out[1:])
    return out


def word_hashes(text: str) -> np.ndarray:
    """Hash of every word (a run without ASCII blanks, A-Z lower-cased) in order."""
    data = _LOWER[np.frombuffer(text.encode(), np.uint8)]
    inside = np.empty(len(data) + 2, np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = ~_BLANK[data]
    turns = np.diff(inside)
    starts, ends = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
    p = prefix_sums(data)
    return mix((p[ends] - p[starts]) * powers(len(p))[1][starts] + (ends - starts).astype(np.uint64))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``width`` words; fewer words are one shingle; no words give an empty set."""
    w = word_hashes(text) if text else np.empty(0, np.uint64)
    if not len(w):
        return w
    k = min(width, len(w))
    out = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + w[i : len(w) - k + 1 + i])
    return np.unique(out)
