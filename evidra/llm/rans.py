"""Static range asymmetric numeral system over numpy lanes.

A payload is a run of blocks that decode by themselves: each begins with a checkpoint (number of ids, lanes, their states,
length) and a checksum of its ids. Id i of a block goes through lane ``i % lanes``; a step handles one id of each lane.
States stay in [2^31, 2^63) and shed 32 bits at a time.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LOW = np.uint64(1 << 31)
HALF = np.uint64(32)
MAGIC = b"RNS1"
_HEAD = struct.Struct("<4sIHHIII")  # magic, ids, lanes, spare, words, crc of ids, crc of the body


class Table:
    """Frequencies scaled to a sum of ``2^bits``: at least 1 for each id that occurs. More than ``2^bits / 2`` ids take more bits, up to 30."""

    def __init__(self, counts: np.ndarray, bits: int = 18) -> None:
        counts = np.asarray(counts, np.int64)
        seen = np.flatnonzero(counts)
        bits = max(bits, len(seen).bit_length() + 1)
        if bits > 30:
            raise ValueError("too many ids for this table")
        self.bits, size = bits, 1 << bits
        freq = np.zeros(len(counts), np.int64)
        if len(seen):
            free = size - len(seen)
            exact = counts[seen] / counts[seen].sum() * free
            part = np.floor(exact).astype(np.int64)
            extra = np.lexsort((seen, -(exact - part)))[: free - part.sum()]
            part[extra] += 1
            freq[seen] = part + 1
        self.freq = freq.astype(np.uint64)
        self.start = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(counts), dtype=np.uint32), freq)
        self.limit = self.freq << np.uint64(63 - bits)


def encode_block(ids: np.ndarray, table: Table, lanes: int = 1024) -> bytes:
    n = len(ids)
    lanes = max(1, min(lanes, n // 64))
    bits = np.uint64(table.bits)
    state, out = np.full(lanes, LOW), []
    f, c, most = table.freq[ids], table.start[ids], table.limit[ids]
    for at in range((n - 1) // lanes * lanes, -1, -lanes):
        to = min(n, at + lanes)
        x, g = state[: to - at], f[at:to]
        full = x >= most[at:to]
        if full.any():
            out.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
            x[full] >>= HALF
        q = x // g
        x[:] = (q << bits) + (x - q * g) + c[at:to]
    words = np.concatenate(out[::-1]) if out else np.zeros(0, "<u4")
    body = state.astype("<u8").tobytes() + words.tobytes()
    return _HEAD.pack(MAGIC, n, lanes, 0, len(words), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body


def block_size(data: bytes, at: int) -> int:
    """Bytes of the block that begins there: a reader can skip to the next checkpoint."""
    magic, _, lanes, _, words, _, _ = _HEAD.unpack_from(data, at)
    if magic != MAGIC:
        raise ValueError("not a block")
    return _HEAD.size + 8 * lanes + 4 * words


def decode_block(data: bytes, at: int, table: Table) -> np.ndarray:
    _, n, lanes, _, n_words, crc, body_crc = _HEAD.unpack_from(data, at)
    body = data[at + _HEAD.size : at + block_size(data, at)]
    if zlib.crc32(body) != body_crc:
        raise ValueError("checksum of a block's bytes differs")
    state = np.frombuffer(body, "<u8", lanes).copy()
    words = np.frombuffer(body, "<u4", n_words, 8 * lanes).astype(np.uint64)
    bits, mask, p = np.uint64(table.bits), np.uint64((1 << table.bits) - 1), 0
    ids = np.empty(n, np.uint32)
    for i in range(0, n, lanes):
        to = min(n, i + lanes)
        x = state[: to - i]
        slot = x & mask
        s = table.symbol[slot.astype(np.int64)]
        ids[i:to] = s
        x[:] = table.freq[s] * (x >> bits) + slot - table.start[s]
        low = np.flatnonzero(x < LOW)
        if len(low):
            x[low] = (x[low] << HALF) | words[p : p + len(low)]
            p += len(low)
    if zlib.crc32(ids.tobytes()) != crc:
        raise ValueError("checksum of a block's ids differs")
    return ids


def encode(ids: np.ndarray, table: Table, block: int = 1 << 18) -> bytes:
    return b"".join(encode_block(ids[i : i + block], table) for i in range(0, len(ids), block))


def decode(data: bytes, table: Table) -> np.ndarray:
    out, at = [], 0
    while at < len(data):
        out.append(decode_block(data, at, table))
        at += block_size(data, at)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)
