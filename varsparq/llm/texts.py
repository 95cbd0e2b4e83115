"""Hashes of words and shingles of a text in numpy, a whole text at a time."""

from __future__ import annotations

import numpy as np

#: Fixed values of a 64-bit finaliser (two multiplications and three shifts), and the base of the word hash.
MIX_1, MIX_2, BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_powers = np.ones(1, np.uint64)
_white = np.zeros(256, bool)
_white[[32, *range(9, 14)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_1
    x ^= x >> np.uint64(27)
    x *= MIX_2
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> np.ndarray:
    """The first n powers of BASE modulo 2**64."""
    global _powers
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 256)
        _powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, BASE & _MASK, np.uint64))])
    return _powers[:n]


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of the words (runs without blank, tab, line or page breaks)."""
    data = np.frombuffer(text, np.uint8)
    edge = np.diff(np.concatenate([[True], _white[data], [True]]).astype(np.int8))
    return data, np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text, in order."""
    data, starts, ends = word_bounds(text)
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    at = np.arange(len(data))  # the place of each byte in its word
    at[starts[0] :] -= np.repeat(starts, np.diff(np.append(starts, len(data))))
    part = (data.astype(np.uint64) + np.uint64(1)) * powers(int(at.max()) + 1)[at]
    part[_white[data]] = 0
    return mix(np.add.reduceat(part, starts) + length.astype(np.uint64))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``words`` words, A-Z lower-cased.

    A text with fewer words is one shingle; one without words has none.
    """
    h = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(h):
        return h
    n = max(1, len(h) - words + 1)
    width = min(words, len(h))
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = mix(out * MIX_2 + h[k : k + n])
    return np.unique(out)
