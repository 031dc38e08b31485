"""Probe selection and tests by permutation, from moments.

Rows: key, domain, label, one vector for each layer. Each task adds up, by layer and domain, the count, sum and cross products of its vectors, and by run and label the counts and sums: a run is
the rows' own labels (0) or a permutation of them within domains. Every fit (outer domain held out, inner domain held out too or none, penalty, run) is a small solve on
differences of these sums. Folds are rows: a fold's moments are joined to it, solved in a task of its own, and its weights meet the rows of the domain that it tests, a piece of them and some runs at a time. Moments and weights are tables,
never on the driver or whole in a worker. Nothing grows with the rows but the two passes over them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.operators.baselines import permuted_labels
from evidra.operators.issues import issues
from evidra.sources.io import attach, settled

#: Penalties of the ridge probe, tried in this order.
ALPHAS = (0.01, 0.1, 1.0, 10.0)
DIGITS = 9
#: Numbers that the moments of one layer and domain may have, and those that a task adds up before it passes them on.
MOST, HELD = 1 << 24, 1 << 23
#: Rows of a domain, and runs, that meet a fold's weights at a time.
PIECE, RUNS = 20_000, 25


def unlabelled(rows: DataFrame, key: str, label: str) -> DataFrame:
    """An issue for each row without a label; such rows take no part in folds."""
    return issues(rows.where(F.col(label).isNull()), "probe", "missing_label", label, F.col(key))


def run_labels(rows: DataFrame, key: str, domain: str, label: str, permutations: int, salt: str) -> tuple[DataFrame, int]:
    """``key``, ``y``: places of a row's label, among all in order, in each run, its own first; and the number of labels. Rows without a label have none."""
    cases = rows.select(F.col(key).alias("case_id"), F.col(domain).cast("string").alias("domain"), F.col(label).cast("string").alias("label")).where(F.col("label").isNotNull())
    places = settled(cases.select("label").distinct().withColumn("y", (F.row_number().over(Window.orderBy("label")) - 1).cast("int")), "labels")  # a row for each label
    own = cases.select("case_id", F.lit(0).alias("perm"), "label")
    if permutations:
        own = own.unionByName(permuted_labels(cases, permutations, salt).select("case_id", F.col("perm").cast("int").alias("perm"), "label"))
    placed = attach(own, places, ["label"])
    y = F.transform(F.sort_array(F.collect_list(F.struct("perm", "y"))), lambda s: s["y"])  # one for each run
    return placed.groupBy("case_id").agg(y.alias("y")).withColumnRenamed("case_id", key), places.count()


def _rows(b: pa.RecordBatch | pa.Table, column: str, dtype: type = np.float64) -> np.ndarray:
    """A column of equally long arrays (of arrays) as rows of numbers."""
    x = b.column(column)
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    while pa.types.is_list(x.type):
        x = x.flatten()
    return x.to_numpy(zero_copy_only=False).astype(dtype).reshape(b.num_rows, -1)


def moments(rows: DataFrame, dim: int, runs: int, k: int) -> DataFrame:
    """By layer and domain ``m``: n, sum (dim), cross products (dim x dim), then counts (runs x k) and sums (runs x k x dim). ``rows``: domain, y, layers."""
    size = 1 + dim + dim * dim + runs * k * (1 + dim)
    if size > MOST:
        raise ValueError("too many labels, runs and dimensions for the moments of one domain")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array([s[0] for s in sums], pa.int32()), pa.array([s[1] for s in sums], pa.string()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["layer", "domain", "m"])
            sums.clear()
            return got

        for b in batches:
            if not b.num_rows:
                continue
            domains, y, x = np.array(b.column("domain").to_pylist(), object), _rows(b, "y", np.int64), _rows(b, "layers").reshape(b.num_rows, -1, dim)
            for d in sorted(set(domains)):
                at = np.flatnonzero(domains == d)
                one = (np.arange(runs) * k + y[at], np.arange(len(at))[:, None])
                for layer in range(x.shape[1]):
                    own = x[at, layer]
                    sides = np.zeros((runs * k, dim))
                    np.add.at(sides, one[0].ravel(), np.repeat(own, runs, 0))
                    m = np.concatenate(([len(own)], own.sum(0), (own.T @ own).ravel(), np.bincount(one[0].ravel(), minlength=runs * k), sides.ravel()))
                    sums[layer, d] = sums[layer, d] + m if (layer, d) in sums else m
                    if len(sums) * size > HELD:
                        yield out()
        yield out()

    parts = rows.select("domain", "y", "layers").mapInArrow(partial, "layer int, domain string, m array<double>")
    return settled(_added(parts, ["layer", "domain"], "m"), "moments")


def _added(parts: DataFrame, by: list[str], m: str) -> DataFrame:
    """Sums of arrays, number by number."""
    each = parts.select(*by, F.posexplode(m).alias("i", "x")).groupBy(*by, "i").agg(F.sum("x").alias("x"))
    return each.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(m))  # as many numbers as an array has


def _standard(m: np.ndarray, dim: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """n, means, deviations (below 1e-12: 1) and cross products of standardised vectors."""
    n, s, g = m[0], m[1 : 1 + dim], m[1 + dim : 1 + dim + dim * dim].reshape(dim, dim)
    mean = s / n
    sd = np.sqrt(np.maximum(np.diag(g) / n - mean**2, 0))
    sd[sd < 1e-12] = 1
    return n, mean, sd, (g - n * np.outer(mean, mean)) / np.outer(sd, sd)


def _sides(m: np.ndarray, dim: int, runs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts (runs x k) and sums (runs x k x dim)."""
    rest = m[1 + dim + dim * dim :]
    return rest[: runs * k].reshape(runs, k), rest[runs * k :].reshape(runs, k, dim)


def solve(m: np.ndarray, dim: int, runs: int, k: int, alphas: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Weights (alphas, runs, k, dim) and intercepts (alphas, runs, k) of one-vs-rest ridge probes with +-1 targets and a free intercept, standardised by mean and population deviation, from moments."""
    n, mean, sd, cross = _standard(m, dim)
    count, sums = _sides(m, dim, runs, k)
    count, sums = count.ravel(), sums.reshape(runs * k, dim)
    values, vectors = np.linalg.eigh(cross)
    right = 2 * (sums - count[:, None] * mean) / sd
    turned = right @ vectors
    w = np.stack([(turned / (np.maximum(values, 0) + a)) @ vectors.T / sd for a in alphas])
    b = (2 * count - n) / n - w @ mean
    return w.reshape(len(alphas), runs, k, dim), b.reshape(len(alphas), runs, k)


def _folds(by: DataFrame, nested: bool) -> DataFrame:
    """layer, outer, inner (null: none), and the moments of all, the outer and the inner domain."""
    total = settled(_added(by.select("layer", F.col("m").alias("whole")), ["layer"], "whole"), "totals")
    outer = by.select("layer", F.col("domain").alias("outer"), F.col("m").alias("out")).join(total, "layer")
    folds = outer.select("layer", "outer", F.lit(None).cast("string").alias("inner"), "whole", "out", F.lit(None).cast("array<double>").alias("in"))
    if nested:
        inner = by.select("layer", F.col("domain").alias("inner"), F.col("m").alias("in"))
        folds = folds.unionByName(outer.join(inner, "layer").where("outer <> inner"))
    return folds


def nested_fits(by: DataFrame, dim: int, runs: int, k: int, alphas: tuple = ALPHAS) -> DataFrame:
    """layer, outer, inner, domain (the tested one), chunk (of ``RUNS`` runs), w: weights and intercepts (alphas x runs x k x (dim + 1)). One task solves a fold."""
    if by.select("domain").distinct().count() < 3:
        raise ValueError("nested folds need three domains")

    def fit(key: tuple, data: pa.Table) -> pa.Table:
        m = _rows(data, "whole")[0] - _rows(data, "out")[0]
        if data["in"][0].is_valid:
            m = m - _rows(data, "in")[0]
        w, b = solve(m, dim, runs, k, alphas)
        every = np.concatenate([w, b[..., None]], -1)
        layer, outer, inner = (x.as_py() for x in key)
        chunks = range(-(-runs // RUNS))
        own = [pa.array([x] * len(chunks), t) for x, t in ((layer, pa.int32()), (outer, pa.string()), (inner, pa.string()), (outer if inner is None else inner, pa.string()))]
        return pa.table([*own, pa.array(chunks, pa.int32()), pa.array([every[:, RUNS * c : RUNS * (c + 1)].ravel() for c in chunks], pa.list_(pa.float64()))], ["layer", "outer", "inner", "domain", "chunk", "w"])

    return settled(_folds(by, True).groupBy("layer", "outer", "inner").applyInArrow(fit, "layer int, outer string, inner string, domain string, chunk int, w array<double>"), "fits")


def _pieces(rows: DataFrame, key: str, by: str = "domain") -> DataFrame:
    """``rows`` by layer: layer, x, and ``piece`` (``pieces``: of its domain), of about ``PIECE`` rows, by the hash of ``key``."""
    sizes = settled(rows.groupBy(by).agg(F.ceil(F.count("*") / PIECE).cast("int").alias("pieces")), "pieces")
    cut = attach(rows, sizes, [by]).withColumn("piece", F.pmod(F.xxhash64(key), F.col("pieces")).cast("int"))
    return cut.select("*", F.posexplode("layers").alias("layer", "x")).drop("layers")


def confusions(rows: DataFrame, key: str, fits: DataFrame, dim: int, runs: int, k: int, alphas: tuple = ALPHAS) -> DataFrame:
    """layer, outer, inner (null: the outer domain itself is tested), alpha, run, truth, predicted, n for all fits. ``rows``: key, domain, y, layers.

    Inner folds are tested on the run's labels, outer domains on the rows' own.
    """
    chunks = -(-runs // RUNS)
    left = _pieces(rows.select(key, "domain", "y", "layers"), key).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    # a run's own labels (the first) and those of the chunk
    left = left.select("layer", "domain", "piece", "chunk", "x", F.concat(F.slice("y", 1, 1), F.slice("y", F.col("chunk") * RUNS + 1, RUNS)).alias("y"))
    right = left.select("layer", "domain", "piece").distinct().join(fits, ["layer", "domain"])
    right = right.toDF(*right.columns)  # columns of its own, as cogroup asks
    at = ["layer", "domain", "piece", "chunk"]

    def count(group: tuple, here: pa.Table, there: pa.Table) -> pa.Table:
        out = []
        if here.num_rows and there.num_rows:
            layer, d, _, chunk = (v.as_py() for v in group)
            x, y = _rows(here, "x"), _rows(here, "y", np.int64)
            n = y.shape[1] - 1
            for outer, inner, weights in zip(there["outer"].to_pylist(), there["inner"].to_pylist(), there["w"].combine_chunks(), strict=True):
                w = weights.values.to_numpy().reshape(len(alphas), n, k, dim + 1)
                cells: dict[int, int] = {}
                for i in range(0, len(x), 1024):
                    score = np.round(np.einsum("nd,arkd->nark", x[i : i + 1024], w[..., :dim], optimize=True) + w[..., dim], DIGITS)
                    said = score.argmax(-1)  # of equal scores the first label
                    truth = np.broadcast_to((y[i : i + 1024, :1] if inner is None else y[i : i + 1024, 1:])[:, None, :], said.shape)
                    cell, c = np.unique((((np.arange(len(alphas))[:, None] * runs + chunk * RUNS + np.arange(n)) * k + truth) * k + said).ravel(), return_counts=True)
                    for j, v in zip(cell.tolist(), c.tolist(), strict=True):
                        cells[j] = cells.get(j, 0) + v
                out += [(layer, outer, inner, j, v) for j, v in cells.items()]
        types = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, types, strict=True)], ["layer", "outer", "inner", "i", "n"])

    got = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(count, "layer int, outer string, inner string, i long, n long")
    each = got.groupBy("layer", "outer", "inner", "i").agg(F.sum("n").alias("n"))
    at = lambda size, mod: F.pmod(F.floor(F.col("i") / size), F.lit(mod)).cast("int")
    return each.select("layer", "outer", "inner", at(runs * k * k, len(alphas)).alias("a"), at(k * k, runs).alias("run"), at(k, k).alias("truth"), at(1, k).alias("predicted"), "n").withColumn("alpha", F.array(*map(F.lit, alphas))[F.col("a")]).drop("a")


def f1_of(cells: DataFrame, by: list[str]) -> DataFrame:
    """Macro F1 and accuracy of confusion counts, and if every label occurs (``full``)."""
    sides = F.explode(F.array(*(F.struct(F.col(c).alias("class"), F.lit(c == "truth").alias("own")) for c in ("truth", "predicted")))).alias("s")
    rows = cells.select(*by, "n", (F.col("truth") == F.col("predicted")).alias("hit"), sides).select(*by, "n", "hit", "s.*")
    each = rows.groupBy(*by, "class").agg(F.sum(F.when(F.col("own"), F.col("n"))).alias("t"), F.sum(F.when(~F.col("own"), F.col("n"))).alias("p"), F.sum(F.when(F.col("own") & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"))
    return each.groupBy(*by).agg(F.avg(F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.col("t") + F.col("p"))).otherwise(0.0)).alias("macro_f1"), (F.sum("tp") / F.sum("t")).alias("accuracy"), F.bool_and(F.col("t") > 0).alias("full"))


def nested_alpha(cells: DataFrame) -> DataFrame:
    """layer, outer, run, alpha, inner_f1: the penalty with the best mean macro F1 over inner folds (those that hold every label), the smallest on ties."""
    inner = f1_of(cells.where("inner is not null"), ["layer", "outer", "inner", "alpha", "run"]).where("full")
    mean = inner.groupBy("layer", "outer", "run", "alpha").agg(F.avg("macro_f1").alias("f"))
    best = F.min_by(F.struct("alpha", "f"), F.struct(-F.round("f", DIGITS), F.col("alpha")))
    return mean.groupBy("layer", "outer", "run").agg(best.alias("b")).select("layer", "outer", "run", "b.alpha", F.col("b.f").alias("inner_f1"))


def outer_eval(cells: DataFrame, chosen: DataFrame) -> DataFrame:
    """layer, outer, run, alpha, inner_f1, macro_f1, accuracy: each outer domain under the penalty that its inner folds chose."""
    outer = f1_of(cells.where("inner is null"), ["layer", "outer", "alpha", "run"]).drop("full")
    return chosen.join(outer, ["layer", "outer", "alpha", "run"])


def p_value(observed: Column, null: Column) -> Column:
    """(1 + how often the null is at least the observed) / (1 + size of the null)."""
    return (1 + F.count_if(F.round(null, DIGITS) >= F.round(observed, DIGITS))) / (1 + F.count(null))


def _split(means: DataFrame, by: list[str], value: str = "mean_f1") -> DataFrame:
    own = means.where("run = 0").select(*by, F.col(value).alias("observed"))
    null = means.where("run > 0").select(*by, F.col(value).alias("null"))
    return own.join(null, by, "left") if by else own.crossJoin(null)  # one observed row


def layer_test(evals: DataFrame) -> DataFrame:
    """layer, macro_f1, inner_f1, p: means over outer folds, and the p-value against the permutations'."""
    means = evals.groupBy("layer", "run").agg(F.avg("macro_f1").alias("mean_f1"), F.avg("inner_f1").alias("mean_inner"))
    tested = _split(means, ["layer"]).groupBy("layer", F.col("observed").alias("macro_f1")).agg(p_value(F.col("observed"), F.col("null")).alias("p"))
    return tested.join(means.where("run = 0").select("layer", F.col("mean_inner").alias("inner_f1")), "layer")


def max_statistic(evals: DataFrame, alpha: float) -> DataFrame:
    """One row: the layer with the highest mean macro F1 (the smallest on ties), its p-value against each permutation's maximum over layers, and if it passes; a p that no number of exceedances can bring to ``alpha`` is refused."""
    means = evals.groupBy("layer", "run").agg(F.avg("macro_f1").alias("mean_f1"))
    top = means.groupBy("run").agg(F.max("mean_f1").alias("mean_f1"), F.min_by("layer", F.struct(-F.round("mean_f1", DIGITS), F.col("layer"))).alias("layer"))
    both = _split(top, [])
    got = both.groupBy(F.col("observed").alias("macro_f1")).agg(p_value(F.col("observed"), F.col("null")).alias("p"), F.count("null").alias("runs"))
    refused = 1 / (F.col("runs") + 1) > alpha
    return top.where("run = 0").select("layer").crossJoin(got).withColumn("status", F.when(refused, "refused").when(F.col("p") <= alpha, "pass").otherwise("null"))  # one row each


def operator_fits(by: DataFrame, dim: int, runs: int, alpha: float) -> DataFrame:
    """layer, domain, w: for each run the weights (dim) and offset of a ridge fit without intercept on +-1 labels, standardised, of all domains but this one; no row if there is none."""

    def fit(key: tuple, data: pa.Table) -> pa.Table:
        m = _rows(data, "whole")[0] - _rows(data, "out")[0]
        rows = []
        if m[0] > 0.5:
            _, mean, sd, cross = _standard(m, dim)
            count, sums = _sides(m, dim, runs, 2)
            target = ((sums[:, 1] - count[:, 1:] * mean) - (sums[:, 0] - count[:, :1] * mean)) / sd
            w = np.linalg.solve(cross + alpha * np.eye(dim), target.T).T / sd
            rows = [np.concatenate([w, -(w @ mean)[:, None]], 1).ravel()]
        return pa.table([pa.array([key[0].as_py()] * len(rows), pa.int32()), pa.array([key[1].as_py()] * len(rows), pa.string()), pa.array(rows, pa.list_(pa.float64()))], ["layer", "domain", "w"])

    return settled(_folds(by, False).groupBy("layer", "outer").applyInArrow(fit, "layer int, domain string, w array<double>"), "fits")


def score_operator(rows: DataFrame, dim: int, alpha: float) -> DataFrame:
    """case_id, domain, family, label, layer, score: ridge without intercept on +-1 labels (``y``), standardised (a deviation below 1e-12 counts as 1), each domain scored by the others (null: there are none). ``rows``: case_id, domain, family, y (array of one: 0 or 1), layers."""
    fits = operator_fits(moments(rows, dim, 1, 2), dim, 1, alpha)
    each = rows.select("case_id", "domain", "family", F.col("y")[0].alias("label"), F.posexplode("layers").alias("layer", "x"))
    x = F.transform("x", lambda c: c.cast("double"))
    dot = F.aggregate(F.zip_with(x, F.slice("w", 1, dim), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) + F.col("w")[dim]
    weights = F.broadcast(fits) if fits.count() * (dim + 1) <= 1 << 22 else fits  # 32 MB at most
    return settled(each.join(weights, ["layer", "domain"], "left").select("case_id", "domain", "family", "label", "layer", dot.alias("score")), "scores")


def swap_labels(rows: DataFrame, swaps: int, salt: str) -> tuple[DataFrame, int]:
    """``rows`` (case_id, domain, family, y, layers) with ``y`` for each run, their own labels first, then ``swaps`` draws that swap the labels within families by the parity of a digest of run and family; and the number of runs.

    Families of other than one positive and one negative, in one domain, keep their labels and are marked (``paired`` false). No two draws are the same: of a few families there may be fewer draws than asked.
    """
    paired = rows.groupBy("family").agg(((F.count("*") == 2) & (F.sum(F.col("y")[0]) == 1) & (F.count_distinct("domain") == 1)).alias("paired"))
    rows = settled(rows.join(paired, "family", "left").withColumn("paired", F.coalesce("paired", F.lit(False))), "families")
    name = F.col("family").cast("string")
    bit = lambda run: F.pmod(F.xxhash64(F.lit(salt), run, name), F.lit(2)).cast("int")
    drawn = rows.where("paired").select("family").distinct().select("family", F.explode(F.sequence(F.lit(1), F.lit(2 * swaps))).alias("run"))
    marks = drawn.groupBy("run").agg(F.sum(F.when(bit(F.col("run")) == 1, F.xxhash64(name)).otherwise(0).cast("decimal(38,0)")).alias("mark"))
    distinct = marks.groupBy("mark").agg(F.min("run").alias("run")).orderBy("run").limit(swaps)
    runs = [0, *sorted(r["run"] for r in distinct.collect())]  # ``swaps`` numbers
    own = F.col("y")[0]
    y = F.transform(F.array(*map(F.lit, runs)), lambda r: F.when((r > 0) & F.col("paired") & (bit(r) == 1), 1 - own).otherwise(own).cast("int"))
    return settled(rows.withColumn("y", y), "swaps"), len(runs)


def swap_null(rows: DataFrame, dim: int, alpha: float, swaps: int, salt: str, layers: list[int] | None = None) -> DataFrame:
    """One row: observed, families, least, median (sorted, at n div 2), most, runs, p of the families won, the most over ``layers`` (default: all), against probes fitted anew on labels swapped within families.

    A family is won if its positive scores above its negative, by the labels of the run. Vectors stay, so a fold's cross products are solved once for all runs. p = (1 + null at least the observed) / (1 + runs).
    """
    labels, runs = swap_labels(rows, swaps, salt)
    fits = operator_fits(moments(labels, dim, runs, 2), dim, runs, alpha)
    chosen = labels.where("paired").select("family", "domain", "y", "layers")
    left = _pieces(chosen, "family").select("layer", "domain", "piece", "family", "x", "y")
    if layers is not None:
        left = left.where(F.col("layer").isin(layers))
    at = ["layer", "domain", "piece"]
    right = left.select(*at).distinct().join(fits, ["layer", "domain"])
    right = right.toDF(*right.columns)  # columns of its own, as cogroup asks

    def count(group: tuple, here: pa.Table, there: pa.Table) -> pa.Table:
        wins = np.zeros(0, np.int64)
        if here.num_rows and there.num_rows:
            here = here.take(pa.array(np.lexsort((_rows(here, "y", np.int64)[:, 0], np.unique(here["family"].to_pylist(), return_inverse=True)[1]))))
            x, y = _rows(here, "x"), _rows(here, "y", np.int64)
            w = _rows(there, "w").reshape(runs, dim + 1)
            gap = (x[1::2] - x[::2]) @ w[:, :dim].T * (2 * y[1::2] - 1)
            wins = (np.round(gap, 12) > 0).sum(0)
        return pa.table([pa.array(np.full(len(wins), group[0].as_py()), pa.int32()), pa.array(np.arange(len(wins), dtype=np.int32)), pa.array(wins.astype(np.int64))], ["layer", "run", "won"])

    won = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(count, "layer int, run int, won long").groupBy("layer", "run").agg(F.sum("won").alias("won"))
    best = settled(won.groupBy("run").agg(F.max("won").alias("won")), "null")
    families = chosen.select("family").distinct().agg(F.count("*").alias("families"))
    null = best.where("run > 0").withColumn("i", F.row_number().over(Window.orderBy("won", "run")) - 1)  # a row for each run
    got = null.crossJoin(F.broadcast(best.where("run = 0").select(F.col("won").alias("observed"))))  # one row
    got = got.groupBy("observed").agg(F.min("won").alias("least"), F.max(F.when(F.col("i") == F.lit((runs - 1) // 2), F.col("won"))).alias("median"), F.max("won").alias("most"), F.count("*").alias("runs"), p_value(F.col("observed"), F.col("won")).alias("p"))
    return got.crossJoin(families)  # one row each


def combo_f1(scores: DataFrame) -> DataFrame:
    """layer, macro_f1, accuracy of the sign of the scores (0 and above: label 1)."""
    said = (F.col("score") >= 0).cast("int")
    cells = scores.where("score is not null").groupBy("layer", F.col("label").alias("truth"), said.alias("predicted")).agg(F.count("*").alias("n"))
    return f1_of(cells, ["layer"]).drop("full")


def family_wins(scores: DataFrame) -> DataFrame:
    """layer, family, domain, difference: of families of one positive and one negative in one domain, positive score less negative."""
    got = scores.groupBy("layer", "family").agg(F.count("*").alias("n"), F.sum("label").alias("p"), F.min("domain").alias("domain"), F.count_distinct("domain").alias("d"), F.sum(F.when(F.col("label") == 1, F.col("score")).otherwise(-F.col("score"))).alias("difference"))
    return got.where("n = 2 and p = 1 and d = 1").drop("n", "p", "d")


def primary_endpoint(scores: DataFrame, null: DataFrame, surface_f1: DataFrame, primary: int, limits: dict[str, float]) -> DataFrame:
    """One row for the primary layer: families won, their number, p (of ``null``, a ``swap_null`` of that layer), margin over the best surface baseline, domains with a positive mean difference, and the decision: ``positive`` if all limits (p, margin, rate, domains) hold."""
    own = family_wins(scores).where(F.col("layer") == primary)
    directions = own.groupBy("domain").agg(F.avg("difference").alias("d")).agg(F.count_if(F.col("d") > 0).alias("domains_up"), F.count("*").alias("domains"))
    margin = combo_f1(scores).where(F.col("layer") == primary).select("macro_f1").crossJoin(surface_f1.agg(F.max("macro_f1").alias("surface"))).select("macro_f1", (F.col("macro_f1") - F.col("surface")).alias("margin"))
    ok = (F.col("p") <= limits["p"]) & (F.col("margin") >= limits["margin"]) & (F.col("observed") >= limits["rate"] * F.col("families")) & (F.col("domains_up") >= limits["domains"] * F.col("domains"))
    tested = null.select("observed", "families", "p")
    return tested.crossJoin(directions).crossJoin(margin).withColumn("decision", F.when(ok, "positive").otherwise("null"))  # one row each


def sensitivity(scores: DataFrame, primary: int) -> DataFrame:
    """All layers' metrics with their families won, the primary flagged, and the range of macro F1 over the others; it never replaces the primary."""
    wins = family_wins(scores).groupBy("layer").agg(F.count_if(F.col("difference") > 0).alias("won"), F.count("*").alias("families"))
    got = combo_f1(scores).join(wins, "layer", "left").withColumn("primary", F.col("layer") == primary)
    others = Window.partitionBy()  # one row for each layer
    f = F.when(~F.col("primary"), F.col("macro_f1"))
    return got.withColumn("range", F.max(f).over(others) - F.min(f).over(others))


def random_directions(directions: DataFrame, seeds: int, dim: int, salt: str) -> DataFrame:
    """layer, seed, cosine, norm: Gaussian directions (Box-Muller on hashed uniforms) scaled to the candidate's norm, and their cosine with it. ``directions``: layer, i, difference, norm."""
    uniform = lambda k: (F.pmod(F.xxhash64(F.lit(salt), F.lit(k), "layer", "seed", "i"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    each = directions.where(F.col("i") < dim).withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(seeds))))
    each = each.withColumn("g", F.sqrt(-2 * F.log(uniform(1))) * F.cos(2 * np.pi * uniform(2)))
    got = each.groupBy("layer", "seed").agg(F.sum(F.col("g") * F.col("difference")).alias("dot"), F.sqrt(F.sum(F.col("g") * F.col("g"))).alias("length"), F.first("norm").alias("norm"))
    return got.select("layer", "seed", (F.col("dot") / F.col("length") / F.col("norm")).alias("cosine"), "norm")


def direction_gates(rows: DataFrame, directions: DataFrame, group: str, target: Column, least_rows: int, least_domains: int) -> DataFrame:
    """layer, status: ``pass``, or the first gate that fails: target or contrast rows, domains that have both, a direction that isn't zero."""
    each = rows.groupBy("domain").agg(F.count_if(target).alias("t"), F.count_if(~target).alias("c"))
    whole = each.agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.count_if((F.col("t") > 0) & (F.col("c") > 0)).alias("d"))
    norms = directions.groupBy(group).agg(F.max("norm").alias("norm")).crossJoin(F.broadcast(whole))  # one row of totals
    status = F.when(F.least("t", "c") < least_rows, "too_few_rows").when(F.col("d") < least_domains, "too_few_domains").when(F.coalesce("norm", F.lit(0.0)) <= 0, "zero_direction").otherwise("pass")
    return norms.select(group, status.alias("status"))
