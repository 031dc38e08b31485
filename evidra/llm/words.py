"""Words of Arrow string batches as numpy arrays: no Python object for each word.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r, so words of UTF-8 bytes are words of code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_K = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text whose words are hashed together (a longer word is a block by itself).
_BLOCK = 1 << 20
_STEP = 0x2545F4914F6CDD1D


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS: list[np.ndarray] = []
_VALUES: dict[int, np.ndarray] = {}


def _powers(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64, at least ``n`` of each."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(10, (n - 1).bit_length())
        made = [np.full(size, x, np.uint64) for x in (_STEP, pow(_STEP, -1, 1 << 64))]
        for x in made:
            x[0] = 1
        _POWERS[:] = [np.cumprod(x) for x in made]
    return _POWERS


def _byte_values(seed: int) -> np.ndarray:
    if seed not in _VALUES:
        _VALUES[seed] = mix(np.arange(1, 257, dtype=np.uint64) * _K ^ np.uint64(seed * 0x9FB21C65 + 1))
    return _VALUES[seed]


@dataclass
class Words:
    """``data``: all bytes; document i is ``data[offsets[i]:offsets[i + 1]]``; word j is ``data[starts[j]:ends[j]]`` of document ``doc[j]``."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """Number of the first word of each document, and the number of words at the end."""
        return np.searchsorted(self.doc, np.arange(len(self.offsets)))

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word: the sum of its bytes' random values times powers of an odd number, from prefix sums over blocks of text."""
        out = np.empty(len(self.starts), np.uint64)
        values = _byte_values(seed)
        done = 0
        while done < len(out):
            lo = int(self.starts[done])
            to = max(done + 1, int(np.searchsorted(self.ends, lo + _BLOCK, side="right")))
            hi = int(self.ends[to - 1])
            power, inverse = _powers(hi - lo)
            total = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(values[self.data[lo:hi]] * power[: hi - lo], out=total[1:])
            at, end = self.starts[done:to] - lo, self.ends[done:to] - lo
            out[done:to] = (total[end] - total[at]) * inverse[at]
            done = to
        return mix(out ^ mix((self.ends - self.starts).astype(np.uint64) * _K + np.uint64(seed)))

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a value for each byte, by document."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def words_of(column: pa.Array, lower: bool = False) -> Words:
    data, offsets = text_bytes(column)
    if lower:
        data = _FOLD[data]
    inside = ~_SPACE[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(offsets[1:], starts, side="right"))


def windows(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``n`` words within a document, and the number of its first word."""
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(h) - n + 1
    g = np.zeros(m, np.uint64)
    for k in range(n):
        g = (g + h[k : k + m]) * np.uint64(0x9FB21C651E98DF25)
        g ^= g >> np.uint64(28)
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return mix(g[at]), at


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``most`` bytes of text (a longer text is a piece by itself), so that arrays stay small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offs = text_bytes(batch.column(column))[1]
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()  # a worker that waits for its next task holds no freed arrays
