"""Vectors in dense files outside the tables: rows of little-endian 32-bit floats, found by an index of (file, row) with a digest of each row's bytes."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from evidra.operators.issues import issues, union
from evidra.sources.io import settled

BLOCK = 4 << 20  # bytes of a file held at a time
SHARE = 64 << 20  # bytes of a file for one task


def _at(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder (a path or an address) and the folder's path in it."""
    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _batch(names: list[str], rows: np.ndarray, *columns: pa.Array) -> pa.RecordBatch:
    digests = pa.array([hashlib.sha256(r.tobytes()).hexdigest() for r in rows], pa.string())
    return pa.RecordBatch.from_arrays([*columns, digests], names=names)


@dataclass
class Rows(InputPartition):
    file: str
    first: int
    count: int

    def __post_init__(self):
        super().__init__((self.file, self.first))


class DenseRows(DataSource):
    """Rows of dense files: file, row (from 0 in each), vector, digest. Options: path (a folder), files (names, a line each), dim. Tasks read byte ranges; a part of a row at a file's end is no row."""

    @classmethod
    def name(cls) -> str:
        return "dense_rows"

    def schema(self) -> str:
        return "file string, row long, vector array<float>, digest string"

    def reader(self, schema) -> DataSourceReader:
        return DenseReader(self.options)


class DenseReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.width = options["path"].rstrip("/"), 4 * int(options["dim"])
        self.files = [f for f in options["files"].split("\n") if f]

    def partitions(self) -> list[InputPartition]:
        system, folder = _at(self.path)
        each = max(1, SHARE // self.width)
        found = [(f, system.get_file_info(f"{folder}/{f}")) for f in self.files]
        sizes = [(f, info.size // self.width) for f, info in found if info.type == fs.FileType.File]
        return [Rows(f, at, min(each, n - at)) for f, n in sizes for at in range(0, n, each)] or [Rows("", 0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if not part.count:
            return
        system, folder = _at(self.path)
        each = max(1, BLOCK // self.width)
        with system.open_input_file(f"{folder}/{part.file}") as f:
            for at in range(part.first, part.first + part.count, each):
                n = min(each, part.first + part.count - at)
                rows = np.frombuffer(f.read_at(n * self.width, at * self.width), "<f4").reshape(n, -1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel().astype(np.float32)))
                yield _batch(["file", "row", "vector", "digest"], rows, pa.array([part.file] * n, pa.string()), pa.array(np.arange(at, at + n)), lists)


def _write(batches, folder: str, dim: int) -> Iterator[pa.RecordBatch]:
    system, path = _at(folder)
    system.create_dir(path, recursive=True)
    name, row = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.f32", 0
    with system.open_output_stream(f"{path}/{name}") as out:
        for batch in batches:
            n = batch.num_rows
            rows = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(n, dim)
            out.write(rows.tobytes())
            yield _batch(["key", "file", "row", "digest"], rows, batch.column("key"), pa.array([name] * n, pa.string()), pa.array(np.arange(row, row + n)))
            row += n


def sink_dense(df: DataFrame, key: str, vector: str, dim: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """Writes vectors to dense files in a folder that all executors reach, a file for each task: (index: key, file, row, digest, written; issues for rows of another length or with null entries, left out).

    A task that is run again writes a file of its own, and the index names one file of each task: what a lost task left is read by nobody.
    """
    fits = F.coalesce((F.size(vector) == dim) & ~F.exists(vector, lambda x: x.isNull()), F.lit(False))
    rows = df.where(fits).select(F.col(key).alias("key"), F.transform(vector, lambda x: x.cast("float")).alias("v"))
    kind = df.schema[key].dataType.simpleString()
    index = settled(rows.mapInArrow(partial(_write, folder=folder, dim=dim), f"key {kind}, file string, row long, digest string"), "index")
    return index, issues(df.where(~fits), "dense", "wrong_length", vector, F.col(key), detail=F.size(vector))


def scan_dense(spark: SparkSession, index: DataFrame, folder: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """(vectors: key, vector; issues) of an index (key, file, row, digest) into dense files. A pointer to no row, a row whose bytes have changed, a row that two keys point to and a row that no key
    points to are issues; vectors are those of pointers without one of the first two. Only the names of files come to the driver; rows meet pointers in a join by file and row."""
    spark.dataSource.register(DenseRows)
    files = "\n".join(sorted(r["file"] for r in index.where("file IS NOT NULL").select("file").distinct().toLocalIterator()))
    rows = spark.read.format("dense_rows").option("path", folder).option("files", files).option("dim", dim).load()
    pointers = index.select("key", "file", "row", F.col("digest").alias("declared"))
    both = settled(rows.withColumn("here", F.lit(True)).join(pointers.withColumn("wanted", F.lit(True)), ["file", "row"], "full_outer"), "dense")
    at = F.concat_ws(":", "file", "row")
    twice = both.where("wanted AND here").groupBy("file", "row").agg(F.count("*").alias("n"), F.min("key").alias("key")).where("n > 1")
    found = union([
        issues(both.where("here IS NULL"), "dense", "missing_row", "row", F.col("key"), detail=at),
        issues(both.where("here AND wanted AND NOT (declared <=> digest)"), "dense", "changed_row", "digest", F.col("key"), detail=at),
        issues(twice, "dense", "repeated_pointer", "row", F.col("key"), detail=at),
        issues(both.where("wanted IS NULL"), "dense", "unreferenced_row", "row", at),
    ])
    return both.where("here AND wanted AND declared = digest").select("key", "vector"), found
