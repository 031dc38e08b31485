"""Token-id files: whole documents' ids in ascending id order, coded by a static range asymmetric numeral system (``rans``).

The texts are sorted by range of id and encoded once, to frames of whole documents with plain ids; these give the counts
of ids over all documents for the shared table, and are then coded frame by frame. A frame holds its documents' ids and lengths, their coded
blocks, and its place, so any frame, and any block in it, can be decoded by itself. Frames are rows of a Parquet table, whose commit
protocol covers lost executors. Reading needs the coded frames and the counts only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidra.llm.common import shared_dir, written
from evidra.llm.rans import Table, decode, encode
from evidra.llm.word_tokens import word_tokens
from evidra.llm.words import slices

FRAMES = "part int, seq long, before long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"


def _narrow(ids: np.ndarray) -> bytes:
    """Plain ids of a frame: a byte of width, then ids of 2 or 4 bytes."""
    return b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\x04" + ids.astype("<u4").tobytes()


def _plain(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, f"<u{payload[0]}", offset=1)


def plain_frames(docs: DataFrame, path: str, end_id: int, frame_ids: int) -> DataFrame:
    """Frames with plain ids, sorted by id over all partitions."""

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before, size = TaskContext.get().partitionId(), 0, 0, 0
        held: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        tokens = word_tokens(path)

        def frame() -> pa.RecordBatch:
            doc_ids, lengths = pa.concat_arrays([x for _, x, _ in held]), np.concatenate([x for _, _, x in held])
            one = pa.array([0, len(lengths)], pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq]), pa.array([before]), pa.array([size]), pa.ListArray.from_arrays(one, doc_ids), pa.ListArray.from_arrays(one, pa.array(lengths)), pa.array([_narrow(np.concatenate([x for x, _, _ in held]))])], ["part", "seq", "before", "n_ids", "doc_ids", "lengths", "payload"])

        for b in slices(batches, most=8_000_000):
            ids, at = tokens.encode(b.column("text"), end_id)
            done = 0
            while done < b.num_rows:  # whole documents, until a frame has its ids
                to = max(done + 1, int(np.searchsorted(at, at[done] + frame_ids - size)))
                to = min(to, b.num_rows)
                held.append((ids[at[done] : at[to]], b.column("doc_id").slice(done, to - done), np.diff(at[done : to + 1])))
                size += int(at[to] - at[done])
                done = to
                if size >= frame_ids:
                    yield frame()
                    seq, before, size = seq + 1, before + size, 0
                    held.clear()
        if held:
            yield frame()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie")).repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return ordered.select("doc_id", "text").mapInArrow(frames, FRAMES)


def count_ids(plain: DataFrame) -> np.ndarray:
    """How often each id occurs: at most one row for each id and task is shuffled, one for each id comes back."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for b in batches:
            for payload in b.column("payload"):
                got = np.bincount(_plain(payload.as_py()), minlength=len(total))
                got[: len(total)] += total
                total = got
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["token", "n"])

    got = plain.select("payload").mapInArrow(counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(got["token"].max()) + 1 if len(got) else 1, np.int64)
    out[got["token"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.int64)
    return out


def write_token_files(docs: DataFrame, out: str, path: str, end_id: int, frame_ids: int = 1 << 20) -> None:
    """Writes coded frames to ``out/frames`` and the table's counts to ``out/counts``; plain frames are a table of the shared folder.

    Null text counts as empty (its ids are the end id alone); null ids come first; rows with one id stand in the order of their texts'
    hashes; very long texts make a frame of their own; an empty table makes no frames. Other columns aren't read.
    """
    spark = docs.sparkSession
    plain = written(plain_frames(docs, path, end_id, frame_ids), "plain-frames", "zstd")
    counts = count_ids(plain)
    spark.createDataFrame([(int(i), int(counts[i])) for i in np.flatnonzero(counts)], "token long, n long").coalesce(1).write.parquet(f"{out}/counts")
    table = spark.sparkContext.broadcast(Table(counts))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                own = b.slice(r, 1)
                payload = encode(_plain(own.column("payload")[0].as_py()), table.value)
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in range(6)), pa.array([payload])], own.schema.names)

    plain.mapInArrow(code, FRAMES).write.option("compression", "uncompressed").parquet(f"{out}/frames")


def read_token_files(spark: SparkSession, out: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32; each block's checksums are compared on the way."""
    got = spark.read.schema("token long, n long").parquet(f"{out}/counts").toPandas()
    counts = np.zeros(int(got["token"].max()) + 1 if len(got) else 1, np.int64)
    counts[got["token"].to_numpy(dtype=np.int64)] = got["n"].to_numpy(dtype=np.int64)
    table = spark.sparkContext.broadcast(Table(counts))
    frames = spark.read.schema(FRAMES).parquet(f"{out}/frames")
    # One row for each part: as many as the writer had tasks.
    totals = frames.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                part, before, doc_ids, lengths, payload = (b.column(c)[r].as_py() for c in ("part", "before", "doc_ids", "lengths", "payload"))
                data = memoryview(decode(payload, table.value).astype("<u4", copy=False)).cast("B")
                to = np.cumsum(np.asarray(lengths, np.int64))
                at = to - lengths
                crc = [zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(at, to, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(at), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(at + before), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], ["part", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = frames.select("part", "before", "doc_ids", "lengths", "payload").mapInArrow(documents, "part int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(base, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, path: str, end_id: int, name: str) -> DataFrame:
    out = f"{shared_dir(docs.sparkSession)}/{name}"
    write_token_files(docs, out, path, end_id)
    return read_token_files(docs.sparkSession, out)
