"""Bloom filters of long keys: built on the executors, of checked size, tested by numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evidra.llm.words import mix

#: Words of a chunk, which is a row to the driver, and places that a task packs at a time.
CHUNK, HELD = 1 << 13, 1 << 20


@dataclass(frozen=True)
class Bloom:
    words: np.ndarray  # uint64
    probes: int

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for at in positions(keys, len(self.words), self.probes):
            found &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def positions(keys: np.ndarray, words: int, probes: int) -> Iterator[np.ndarray]:
    a = mix(keys.view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
    b = mix(a ^ np.uint64(0x14057B7EF767814F)) | np.uint64(1)
    for i in range(probes):
        yield (a + np.uint64(i) * b) % np.uint64(64 * words)


def build(keys: DataFrame, n: int, bits_per_key: int = 12, probes: int = 6, most_words: int = 1 << 23) -> Bloom:
    """A filter of the first column of ``keys`` (long), sized for ``n`` keys but never above ``most_words`` words: beyond, more other keys pass.

    Tasks send the places of their keys, packed by chunk of the filter, and a chunk is filled by one task: the driver gets its bytes, never a row for each word."""
    words = max(16, min(most_words, n * bits_per_key // 64 + 1))

    def packed(places: list[np.ndarray]) -> pa.RecordBatch:
        at = np.unique(np.concatenate(places))
        chunk = at // np.uint64(64 * CHUNK)
        some, start = np.unique(chunk, return_index=True)
        inside = np.split((at - chunk * np.uint64(64 * CHUNK)).astype(np.uint32), start[1:])
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([x.tobytes() for x in inside], pa.binary())], ["chunk", "places"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held += positions(b.column(0).to_numpy(zero_copy_only=False), words, probes)
                size += probes * b.num_rows
            if size > HELD:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    def fill(group: pa.Table) -> pa.Table:
        bits = np.zeros(64 * CHUNK, bool)
        for x in group["places"]:
            bits[np.frombuffer(x.as_buffer(), np.uint32)] = True
        return pa.table([pa.array([group["chunk"][0].as_py()], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], ["chunk", "bits"])

    out = np.zeros(-(-words // CHUNK) * CHUNK, np.uint64)
    for b in keys.mapInArrow(send, "chunk int, places binary").groupBy("chunk").applyInArrow(fill, "chunk int, bits binary").toArrow().to_batches():
        for chunk, bits in zip(b.column("chunk").to_pylist(), b.column("bits"), strict=True):
            out[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(bits.as_buffer(), np.uint64)
    return Bloom(out[:words], probes)
