"""Vectors of Arrow columns, and which of them can be compared."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite_vector(v: Column) -> Column:
    """A vector with at least one number and none that is null or not finite."""
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def good_vector(v: Column) -> Column:
    """A finite vector other than zero."""
    return finite_vector(v) & F.exists(v, lambda x: x != 0)


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def sample_by_length(own: DataFrame, most: int, salt: int) -> dict[int, tuple[int, np.ndarray]]:
    """By length of ``own``'s vectors (key, dim, embedding): their number, and those that a hash of the key draws, about ``most`` of each length, in one job for all lengths."""
    counts = {r["dim"]: r["count"] for r in own.groupBy("dim").count().collect()}  # a row for each length
    limits = own.sparkSession.createDataFrame([(d, min(1.0, most / n)) for d, n in counts.items()], "dim int, share double")
    draw = F.pmod(F.xxhash64("key", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    drawn = own.join(F.broadcast(limits), "dim").withColumn("draw", draw).where(F.col("draw") < F.col("share")).orderBy("dim", "draw").select("dim", "embedding").toArrow()
    dims = drawn["dim"].to_numpy()
    at = {d: np.flatnonzero(dims == d) for d in counts}
    return {d: (n, matrix(drawn["embedding"].take(pa.array(at[d]))) if len(at[d]) else np.zeros((0, d))) for d, n in counts.items()}
