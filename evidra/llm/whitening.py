"""Whitening of vectors: covariances by polarisation of exact squares.

Numbers become integers x, so that every sum is exact. First the sums S of the fit list give whole-number centres m = S div n (remainder r); then each task adds up the squares of the centred
values y = x - m of every dimension and of every sum of two dimensions. With n * y - r = n * x - S, those are the squares of exactly centred values:
sum (n * x - S)^2 = n^2 * sum y^2 - n * r^2. The covariance of two dimensions is half the variance of their sum less both variances, the division being the only rounding. The matrix of
d (d + 1) / 2 numbers is decomposed in one task; rows are then projected where they lie. Sums are Python or 64-bit integers, shuffled as two decimals, so they never overflow.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import written
from evidra.llm.vectors import finite_vector

#: Sums are shuffled as high * SPLIT + low. Rows of a block whose squares 64 bits hold, if centred values are below NARROW.
SPLIT, BLOCK, NARROW = 10**30, 512, 1 << 25
_SUMS = "dim int, i int, high decimal(38,0), low decimal(38,0)"


def _ints(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _by_length(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    dims = b.column("dim").to_numpy()
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        yield int(d), at, b.take(pa.array(at))


def _emit(sums: dict[int, list[int]]) -> pa.RecordBatch:
    rows = [(d, i, *divmod(int(v), SPLIT)) for d, values in sums.items() for i, v in enumerate(values)]
    whole = [[decimal.Decimal(r[c]) for r in rows] for c in (2, 3)]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), *(pa.array(w, pa.decimal128(38, 0)) for w in whole)], ["dim", "i", "high", "low"])


def _total(parts: DataFrame) -> DataFrame:
    return parts.groupBy("dim", "i").agg(F.sum("high").cast("decimal(38,0)").alias("high"), F.sum("low").cast("decimal(38,0)").alias("low"))


def _sums(got: DataFrame) -> dict[int, list[int]]:
    """By length the sums, in order: some thousand numbers for each length."""
    out: dict[int, list[int]] = {}
    for r in sorted(got.collect()):
        out.setdefault(r["dim"], []).append(int(r["high"]) * SPLIT + int(r["low"]))
    return out


def centred(x: np.ndarray, centre: list[int]) -> np.ndarray:
    """``x`` less whole numbers: 64-bit integers if they hold what follows, else Python's."""
    if len(x) and max(abs(int(x.min())), abs(int(x.max())), *map(abs, centre)) < 1 << 61:
        return x - np.array(centre, np.int64)
    return x.astype(object) - np.array(centre, object)


def squares(y: np.ndarray) -> list[int]:
    """Sums over the rows of y_i^2 for each dimension, then of (y_i + y_j)^2 for each pair i < j."""
    d = y.shape[1]
    total = np.zeros(d * (d + 1) // 2, object)
    for at in range(0, len(y), BLOCK):
        rows = y[at : at + BLOCK]
        if rows.dtype == object and len(rows) and max(map(abs, rows.ravel())) < NARROW:
            rows = rows.astype(np.int64)
        if rows.dtype != object and np.abs(rows).max(initial=0) >= NARROW:
            rows = rows.astype(object)
        own = [(rows * rows).sum(0)]
        columns = np.ascontiguousarray(rows.T)
        for i in range(d - 1):
            both = columns[i + 1 :] + columns[i]
            own.append((both * both).sum(1) if both.dtype == object else np.einsum("ij,ij->i", both, both))
        total += np.concatenate(own).astype(object)
    return total.tolist()


def covariance(sums: list[int], remainders: list[int], n: int) -> np.ndarray:
    """The covariances (divisor n) from ``squares`` of values centred at whole numbers: each is one exact fraction, rounded once."""
    d = len(remainders)
    of = lambda q, r: n * n * q - n * r * r  # noqa: E731  sum of (n x - S)^2
    own = [of(q, r) for q, r in zip(sums, remainders, strict=False)]
    out, k = np.zeros((d, d)), d
    for i in range(d):
        out[i, i] = own[i] / n**3
        for j in range(i + 1, d):
            out[i, j] = out[j, i] = (of(sums[k], remainders[i] + remainders[j]) - own[i] - own[j]) / (2 * n**3)
            k += 1
    return out


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues by falling size, unit eigenvectors as rows, and each eigenvalue's share of the trace; an eigenvalue that rounding can't tell from 0 has none (0)."""
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:most]
    values, vectors = values[order], vectors[:, order].T
    values = np.where(values > len(v) * np.finfo(float).eps * max(values.max(initial=0.0), 0.0), values, 0.0)
    trace = np.trace(v)
    return values, vectors, values / trace if trace > 0 else np.zeros(len(values))


def whiten(vectors: DataFrame, most: int = 16, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: each vector on the first ``most`` components of the fit list, every distinct vector x = floor(scale * c) + shift once.

    Rows whose vector is null, empty or holds null or non-finite numbers are left out. ``deviation`` is the exact sum of (n * x - S)^2 (decimal; null above 38 digits); ``identity_error`` the largest
    absolute entry of the covariance, less the identity, of the whitened fit list, as measured over it. Vectors of each length are a fit list of their own, and shorter ones have fewer components.
    Equal vectors count once in the fit and each have their rows; repeated and null ids are rows of their own; a component without variance has ``whitened`` null and ``explained`` 0 (all of them if there is one distinct vector: then ``identity_error`` is 0).
    Numbers beyond what 64 bits hold become the largest or smallest that they do. An empty table gives no rows; other columns aren't read.
    """
    spark = vectors.sparkSession
    v = F.col("embedding")
    edge = float(1 << 62)
    entry = lambda c: F.greatest(F.lit(-edge), F.least(F.lit(edge), F.floor(scale * c.cast("double")).cast("double"))).cast("long") + F.lit(shift).cast("long")
    rows = vectors.where(finite_vector(v)).select("vec_id", F.transform(v, entry).alias("x"), F.size(v).alias("dim"))
    rows = written(rows, "whole-numbers", "zstd")
    fit = written(rows.select("dim", "x").distinct(), "fit-list", "zstd")
    n = {r["dim"]: r["count"] for r in fit.groupBy("dim").count().collect()}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, list[int]] = {}
        for b in batches:
            for d, _, own in _by_length(b):
                x = _ints(own.column("x"))
                # 32 bits at a time, so that 2^31 rows' sums fit
                now = ((x >> 32).sum(0).astype(object) << 32) + (x & 0xFFFFFFFF).sum(0).astype(object)
                out[d] = [a + c for a, c in zip(out.get(d, [0] * d), now.tolist(), strict=True)]
        yield _emit(out)

    total = _sums(_total(fit.mapInArrow(sums, _SUMS)))
    centre = {d: [divmod(s, n[d]) for s in total[d]] for d in n}
    centres = spark.sparkContext.broadcast({d: ([m for m, _ in c], [r for _, r in c], n[d]) for d, c in centre.items()})

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, list[int]] = {}
        for b in batches:
            for d, _, own in _by_length(b):
                now = squares(centred(_ints(own.column("x")), centres.value[d][0]))
                out[d] = [a + c for a, c in zip(out[d], now, strict=True)] if d in out else now
        yield _emit(out)

    def decompose(group: tuple, data: pa.Table) -> pa.Table:
        d = group[0].as_py()
        _, remainders, size = centres.value[d]
        data = data.sort_by("i")
        exact = [int(h) * SPLIT + int(low) for h, low in zip(data["high"].to_pylist(), data["low"].to_pylist(), strict=True)]
        values, unit, share = components(covariance(exact, remainders, size), most)
        k = len(values)
        return pa.table([pa.array([d] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array(values), pa.array(share), pa.array(unit.tolist(), pa.list_(pa.float64()))], ["dim", "k", "value", "share", "unit"])

    found = written(_total(fit.mapInArrow(pairs, _SUMS)).groupBy("dim").applyInArrow(decompose, "dim int, k int, value double, share double, unit array<double>"), "components")
    bases: dict[int, list] = {}
    for r in sorted(found.collect(), key=lambda r: (r["dim"], r["k"])):  # ``most`` rows for each length
        bases.setdefault(r["dim"], []).append(r)
    bases = {d: (np.array([r["unit"] for r in b]), np.array([r["value"] for r in b]), np.array([r["share"] for r in b])) for d, b in bases.items()}
    sent = spark.sparkContext.broadcast(bases)

    def project(d: int, x: np.ndarray) -> tuple[np.ndarray, list]:
        """Whitened values (nan: no variance), and exact deviations."""
        mid, remainders, size = centres.value[d]
        y = centred(x, mid)
        unit, values, _ = sent.value[d]
        off = y.astype(np.float64) - np.array([r / size for r in remainders])
        with np.errstate(divide="ignore", invalid="ignore"):
            w = np.where(values > 0, (off @ unit.T) / np.sqrt(values), np.nan)
        if y.dtype != object and float(np.abs(y).max(initial=0)) * size < (1 << 31) / max(1, d):
            dev = ((y * size - np.array(remainders, np.int64)) ** 2).sum(1).tolist()
        else:
            dev = ((y.astype(object) * size - np.array(remainders, object)) ** 2).sum(1).tolist()
        return w, dev

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[int, np.ndarray] = {}
        for b in batches:
            for d, _, own in _by_length(b):
                w = np.nan_to_num(project(d, _ints(own.column("x")))[0])
                one = np.concatenate([w.sum(0), (w.T @ w).ravel()])
                out[d] = out.get(d, 0.0) + one
        rows = [(d, i, float(x)) for d, m in out.items() for i, x in enumerate(m)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 3, (pa.int32(), pa.int32(), pa.float64()), strict=True)], ["dim", "i", "x"])

    errors = {}
    got = fit.mapInArrow(products, "dim int, i int, x double").groupBy("dim", "i").agg(F.sum("x").alias("x")).toPandas()
    for d, g in got.groupby("dim"):
        real = bases[int(d)][1] > 0
        k, m = len(real), g.sort_values("i")["x"].to_numpy() / n[int(d)]
        cov = m[k:].reshape(k, k) - np.outer(m[:k], m[:k])
        errors[int(d)] = float(np.abs(cov - np.eye(k))[np.ix_(real, real)].max(initial=0.0))
    error = max(errors.values(), default=0.0)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, _, own in _by_length(b):
                w, dev = project(d, _ints(own.column("x")))
                k, rows = w.shape[1], len(w)
                share = sent.value[d][2]
                exact = pa.array([decimal.Decimal(x) if x < 10**38 else None for x in dev], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays(
                    [own.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, centres.value[d][2])), exact.take(pa.array(np.repeat(np.arange(rows), k))), pa.array(w.ravel(), from_pandas=True), pa.array(np.tile(share, rows)), pa.array(np.full(rows * k, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(apply, f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
