"""64-bit hashes of words, word n-grams and character n-grams, for a text at a time in numpy. Equal strings have equal hashes, whatever the text around them."""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LETTER = np.zeros(256, bool)
_LETTER[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _upto(n: int) -> list[np.ndarray]:
    """The first n powers of the odd base and of its inverse."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_ODD, _INVERSE)):
            _powers[i] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(2 * n, base))])
    return _powers


def words(lower: str) -> np.ndarray:
    """Of each run of a-z and 0-9, in order."""
    b = np.frombuffer(lower.encode("utf-8", "surrogatepass"), np.uint8)
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = _LETTER[b]
    edges = np.flatnonzero(np.diff(inside))
    start, end = edges[::2], edges[1::2]
    up, down = _upto(len(b) + 1)
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(b * up[: len(b)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start])


def word_grams(hashed: np.ndarray, n: int) -> np.ndarray:
    """Of each run of n words."""
    count = max(len(hashed) - n + 1, 0)
    h = np.zeros(count, np.uint64)
    for i in range(n):
        h = h * _ODD + hashed[i : i + count]
    return mix(h) if n > 1 else h


def char_grams(text: str, low: int, high: int) -> np.ndarray:
    """Of all runs of ``low`` to ``high`` characters; of the whole text for each of these lengths that it lacks; none of empty text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    if not len(codes):
        return codes
    out, h = [], np.zeros(len(codes), np.uint64)
    for n in range(1, high + 1):
        if n <= len(codes):
            count = len(codes) - n + 1
            h = h[:count] * _ODD + codes[n - 1 :]
        if n >= low:
            out.append(h)
    return mix(np.concatenate(out))
