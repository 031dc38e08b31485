"""Vectors: health, moments, ridge probes over held-out domains, and tests of scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.operators.issues import issues, union
from evidra.sources.io import attach, settled


def doubles(vector: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double"))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def numeric_health(vector: Column) -> dict[str, Column]:
    """Share of finite numbers, largest and mean absolute value, Euclidean norm (the first and last over finite numbers)."""
    good = F.filter(vector, finite)
    size = F.greatest(F.lit(1), F.size(vector))
    total = lambda v, f: F.aggregate(v, F.lit(0.0), lambda a, x: a + f(x))
    return {"finite_ratio": F.size(good) / size, "max_abs": F.coalesce(F.array_max(F.transform(good, F.abs)), F.lit(0.0)), "mean_abs": total(vector, F.abs) / size, "norm": F.sqrt(total(good, lambda x: x * x))}


def validate_vectors(df: DataFrame, cases: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """Unknown cases, repeated keys, non-finite numbers, wrong lengths, and cases without a vector."""
    bad = F.exists(vector, lambda x: ~finite(x))
    known = cases.select(key).distinct()
    return union([
        issues(df.join(known, key, "left_anti"), "vectors", "unknown_case", key, F.col(key)),
        issues(df.groupBy(key).count().where("count > 1"), "vectors", "repeated_key", key, F.col(key), detail=F.col("count")),
        issues(df.where(bad), "vectors", "non_finite", vector, F.col(key)),
        issues(df.where(F.size(vector) != dim), "vectors", "wrong_length", vector, F.col(key), detail=F.size(vector)),
        issues(known.join(df.select(key), key, "left_anti"), "vectors", "missing_vector", key, F.col(key)),
    ])


def vector_parity(left: DataFrame, right: DataFrame, key: str, vector: str, atol: float, rtol: float) -> DataFrame:
    """Per key: pass, fail, shape_mismatch, empty or missing, and the largest absolute difference."""
    both = left.select(key, F.col(vector).alias("a")).join(right.select(key, F.col(vector).alias("b")), key, "full_outer")
    gap = F.zip_with("a", "b", lambda x, y: F.abs(x - y))
    off = F.exists(F.zip_with("a", "b", lambda x, y: F.abs(x - y) - (atol + F.abs(y) * rtol)), lambda d: d > 0)
    status = F.when(F.col("a").isNull() | F.col("b").isNull(), "missing").when(F.size("a") != F.size("b"), "shape_mismatch").when(F.size("a") == 0, "empty").when(off, "fail").otherwise("pass")
    return both.select(key, status.alias("status"), F.when(F.size("a") == F.size("b"), F.array_max(gap)).alias("max_diff"))


def topk_explode(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """The k largest entries of each vector: key, position (from 0), value, rank; ties by position. Sorting stays within the row."""
    ranked = F.slice(F.sort_array(F.transform(vector, lambda x, i: F.struct((-x).alias("v"), i.alias("i")))), 1, k)
    return df.select(key, F.posexplode(ranked).alias("r", "e")).select(key, F.col("e.i").alias("position"), (-F.col("e.v")).alias("value"), (F.col("r") + 1).alias("rank"))


def domain_moments(df: DataFrame, domain: str, label: str, vector: str, dim: int) -> DataFrame:
    """Per domain and label: n, the sum of x and of x x' (upper triangle, row by row). Each task adds up its rows first, so what is shuffled doesn't grow with them."""
    upper = np.triu_indices(dim)
    size = dim + len(upper[0])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            for key in set(keys):
                own = x[[i for i, k in enumerate(keys) if k == key]]
                sums[key] = sums.get(key, np.zeros(size + 1)) + np.concatenate(([len(own)], own.sum(0), (own.T @ own)[upper]))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["domain", "label", "m"])

    rows = df.where(F.size(vector) == dim).select(F.col(domain).cast("string"), F.col(label).cast("string"), doubles(F.col(vector)))
    parts = rows.mapInArrow(partial, "domain string, label string, m array<double>")
    total = parts.select("domain", "label", F.posexplode("m").alias("i", "x")).groupBy("domain", "label", "i").agg(F.sum("x").alias("x"))
    return total.groupBy("domain", "label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("m"))  # 1 + d + d(d+1)/2 numbers each


def _unpack(m: np.ndarray, dim: int) -> tuple[float, np.ndarray, np.ndarray]:
    gram = np.zeros((dim, dim))
    gram[np.triu_indices(dim)] = m[1 + dim :]
    return m[0], m[1 : 1 + dim], gram + np.triu(gram, 1).T


def solve_ridge(by_label: dict[str, np.ndarray], dim: int, alpha: float) -> tuple[list[str], np.ndarray, np.ndarray]:
    """One-vs-rest ridge with a free intercept from moments: labels, weights (labels x dim) and intercepts for raw vectors."""
    labels = sorted(by_label)
    parts = {k: _unpack(by_label[k], dim) for k in labels}
    n = sum(p[0] for p in parts.values())
    s, g = sum(p[1] for p in parts.values()), sum(p[2] for p in parts.values())
    mean = s / n
    sd = np.sqrt(np.maximum(np.diag(g) / n - mean**2, 0))
    sd[sd == 0] = 1
    cov = (g - n * np.outer(mean, mean)) / np.outer(sd, sd)
    right = np.stack([2 * (parts[k][1] - parts[k][0] * mean) / sd for k in labels])
    w = np.linalg.solve(cov + alpha * np.eye(dim), right.T).T / sd
    return labels, w, np.array([(2 * parts[k][0] - n) / n for k in labels]) - w @ mean


def ridge_lodo(df: DataFrame, moments: DataFrame, key: str, domain: str, label: str, vector: str, dim: int, alpha: float) -> DataFrame:
    """Predictions of each domain's rows by a ridge probe fitted on the others: moments are totals less the domain's, one small solve for each domain."""
    moments = settled(moments, "moments")
    total = moments.select("label", F.posexplode("m").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("x")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("t"))
    domains = moments.select(F.col("domain").alias("fold")).distinct()
    grid = domains.crossJoin(total).join(moments.withColumnRenamed("domain", "fold"), ["fold", "label"], "left")  # domains x labels

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        left = {k: np.asarray(t) - (0 if m is None else np.asarray(m)) for k, t, m in zip(pdf["label"], pdf["t"], pdf["m"], strict=True)}
        sums = {k: x for k, x in left.items() if round(x[0]) > 0}
        if not sums:
            return pd.DataFrame({"fold": [], "class": [], "w": [], "b": []})
        labels, w, b = solve_ridge(sums, dim, alpha)
        return pd.DataFrame({"fold": pdf["fold"].iloc[0], "class": labels, "w": list(w), "b": b})

    weights = grid.groupBy("fold").applyInPandas(fit, "fold string, class string, w array<double>, b double")
    rows = df.where(F.size(vector) == dim).select(key, F.col(domain).cast("string").alias("fold"), F.col(label).cast("string").alias("label"), doubles(F.col(vector)).alias("x"))
    dot = F.aggregate(F.zip_with("x", "w", lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
    each = attach(rows, settled(weights, "weights"), ["fold"], 20_000).select(key, "fold", "label", "class", (dot + F.col("b")).alias("score"))  # labels x domains weight rows
    return each.groupBy(key, "fold", "label").agg(F.min_by("class", F.struct(-F.round("score", 9), F.col("class"))).alias("predicted"))


def holm(df: DataFrame, p: str) -> DataFrame:
    """Step-down adjusted p-values: running maximum of p times the number of tests left, at most 1. The table is one of tests."""
    w = Window.orderBy(p, *[c for c in df.columns if c != p])
    m = F.count("*").over(Window.partitionBy())
    return df.withColumns({"_r": F.row_number().over(w), "_m": m}).withColumn("adjusted", F.max(F.least(F.lit(1.0), F.col(p) * (F.col("_m") - F.col("_r") + 1))).over(w)).drop("_r", "_m")


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    p, zz = successes / n, z * z
    centre, half = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    return (centre - half) / (1 + zz / n), (centre + half) / (1 + zz / n)


def family_success(df: DataFrame, family: str, positive: Column, score: str) -> DataFrame:
    """Families of exactly one positive and one negative: if the positive's score is strictly greater; others are malformed (null)."""
    got = df.groupBy(family).agg(F.count_if(positive).alias("p"), F.count("*").alias("n"), F.max(F.when(positive, F.col(score))).alias("hi"), F.max(F.when(~positive, F.col(score))).alias("lo"))
    return got.select(family, F.when((F.col("p") == 1) & (F.col("n") == 2), F.col("hi") > F.col("lo")).alias("success"), (F.col("hi") - F.col("lo")).alias("difference"))


def with_average_rank(df: DataFrame, column: str, name: str, ranges: int = 256) -> DataFrame:
    """``df`` with the rank of a number among all rows, ties by their mean rank (null: null), from counts of value ranges and ranks within each range."""
    cuts = sorted(set(df.approxQuantile(column, [i / ranges for i in range(1, ranges)], 0.002))) if ranges > 1 else []
    x = F.col(column)
    cut = df.withColumn("_range", F.when(x.isNotNull(), F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c <= x))))
    sizes = cut.where(x.isNotNull()).groupBy("_range").agg(F.count("*").alias("_n"))
    base = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # at most ``ranges`` rows
    rank = F.col("_base") + F.rank().over(Window.partitionBy("_range").orderBy(column)) + (F.count("*").over(Window.partitionBy("_range", column)) - 1) / 2
    return cut.join(F.broadcast(base), "_range", "left").withColumn(name, F.when(x.isNotNull(), rank)).drop("_range", "_base")


def contrast_direction(df: DataFrame, group: str, vector: str, target: Column, dim: int) -> DataFrame:
    """Per group: mean of the target vectors less mean of the others, as rows (i, difference), with the direction's norm."""
    each = df.where(F.size(vector) == dim).select(group, target.alias("t"), F.posexplode(doubles(F.col(vector))).alias("i", "x"))
    means = each.groupBy(group, "i").agg((F.avg(F.when(F.col("t"), F.col("x"))) - F.avg(F.when(~F.col("t"), F.col("x")))).alias("difference"))
    return means.withColumn("norm", F.sqrt(F.sum(F.col("difference") * F.col("difference")).over(Window.partitionBy(group))))
