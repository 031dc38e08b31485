"""Nearest neighbours by inner product: a forest of random-projection trees, one priority queue over all of them for each query, exact scores in the leaves.

* Vectors get one more number, so that all are equally long: the largest inner product with a query is then the nearest in angle, and hyperplanes part what is far apart.
* A node's hyperplane lies between two vectors drawn from its sample, at the sample's median. Trees are fitted on a bounded sample and index every vector. Where a leaf's share of the table is
  still too large and its sample used up, it is parted further by random hyperplanes through its mean: these need no sample, so leaves stay small however large the table is.
* A query's queue holds nodes of all trees, by the squared distances to the hyperplanes that lie between them and the query. Leaves are taken from it until they hold ``budget`` vectors.
* The budget is measured, not guessed: some queries are compared with every vector, and the budget is what finds the asked share of their true neighbours.
* Rows and queries meet in leaves (blocks of a leaf, where many rows or queries meet). Scores are exact; what cannot be among a query's best, by its best among the
  sample, is not passed on.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.llm.common import written
from evidra.llm.vectors import good_vector, matrix

#: A leaf's number is its place among the forest's leaves times this, plus the sides of up to 20 further hyperplanes.
SUB = 1 << 20
#: A node is parted by its own sample down to so many vectors.
LEAST_SAMPLE = 16


@functools.lru_cache(1 << 14)
def _direction(leaf: int, level: int, dim: int) -> np.ndarray:
    d = np.random.default_rng((leaf, level)).standard_normal(dim)
    return d / np.linalg.norm(d)


@dataclass
class Leaf:
    """A leaf's number, mean and further levels; ``rows``: how many vectors it holds (all its parts together)."""

    number: int
    mean: np.ndarray
    levels: int
    rows: float = 0.0


class Forest:
    """Trees of (direction, cut, left, right) and leaves, over vectors with one more number (see ``lengthen``)."""

    def __init__(self, sample: np.ndarray, n: int, longest: float, trees: int, leaf: int, seed: int) -> None:
        self.longest, self.leaf, self.leaves = longest, leaf, []
        self.sample = sample
        rng = np.random.default_rng(seed)
        x, scale = self.lengthen(sample), n / max(1, len(sample))
        self.trees = [self._grow(x, scale, rng) for _ in range(trees)]
        #: The sample's vectors in each leaf.
        self.members: dict[int, np.ndarray] = {}
        at = self.route(sample).ravel()
        order = np.argsort(at, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(at[order])) + 1) if len(at) else ():
            self.members[int(at[own[0]])] = own // trees

    def lengthen(self, x: np.ndarray) -> np.ndarray:
        """Vectors over the longest one's length, with what they lack of it as the last number."""
        x = x / self.longest
        return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))], 1)

    def _grow(self, x: np.ndarray, scale: float, rng: np.random.Generator):
        if len(x) * scale > self.leaf and len(x) >= LEAST_SAMPLE:
            for _ in range(4):
                a, b = x[rng.choice(len(x), 2, replace=False)]
                direction = a - b
                long = np.linalg.norm(direction)
                if long == 0:
                    continue
                direction /= long
                at = x @ direction
                cut = float(np.median(at))
                left = at <= cut
                if 0 < left.sum() < len(x):
                    return direction, cut, self._grow(x[left], scale, rng), self._grow(x[~left], scale, rng)
        levels = int(np.ceil(np.log2(max(1.0, len(x) * scale / self.leaf)))) if len(x) < LEAST_SAMPLE else 0
        self.leaves.append(Leaf(len(self.leaves), x.mean(0) if len(x) else np.zeros(x.shape[1]), min(20, levels)))
        return self.leaves[-1]

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector (rows) in each tree (columns)."""
        x = self.lengthen(x)
        out = np.zeros((len(x), len(self.trees)), np.int64)

        def down(node, rows: np.ndarray, tree: int) -> None:
            if not len(rows):
                return
            if isinstance(node, Leaf):
                out[rows, tree] = node.number * SUB
                for level in range(node.levels):
                    out[rows, tree] += ((x[rows] - node.mean) @ _direction(node.number, level, x.shape[1]) > 0).astype(np.int64) << level
                return
            direction, cut, left, right = node
            side = x[rows] @ direction <= cut
            down(left, rows[side], tree)
            down(right, rows[~side], tree)

        for t, tree in enumerate(self.trees):
            down(tree, np.arange(len(x)), t)
        return out

    def visit(self, query: np.ndarray) -> Iterator[tuple[int, float]]:
        """Leaves and how many vectors they hold, nearest first over all trees."""
        q = np.append(query / (np.linalg.norm(query) or 1.0), 0.0)
        queue: list[tuple] = [(0.0, i, tree, 0, 0) for i, tree in enumerate(self.trees)]
        n = len(queue)
        while queue:
            far, _, node, level, sides = heapq.heappop(queue)
            if isinstance(node, Leaf):
                if level == node.levels:
                    yield node.number * SUB + sides, node.rows / (1 << level)
                    continue
                off = float((q - node.mean) @ _direction(node.number, level, len(q)))
                parts = [(node, level + 1, sides, off > 0), (node, level + 1, sides | 1 << level, off <= 0)]
            else:
                direction, cut, left, right = node
                off = float(q @ direction) - cut
                parts = [(left, 0, 0, off > 0), (right, 0, 0, off <= 0)]
            for child, at, own, beyond in parts:
                heapq.heappush(queue, (far + off * off if beyond else far, n, child, at, own))
                n += 1


def compare(rows: np.ndarray, keys: np.ndarray, ids: list[list[int]], queries: np.ndarray, qkeys: np.ndarray, bounds: np.ndarray, k: int) -> list[tuple]:
    """Of each query the ``k`` best rows, as (query's key, score, vec_id, place among copies, if the vector is the query's own); scores are summed number by number, so equal vectors have equal scores."""
    out: list[tuple] = []
    least = np.array([i[0] for i in ids])
    for at in range(0, len(queries), 256):
        scores = np.nan_to_num(queries[at : at + 256] @ rows.T, nan=-np.inf)
        slack = 1e-12 * (np.abs(queries[at : at + 256]) @ np.abs(rows).max(0))[:, None]
        open_ = scores >= bounds[at : at + 256, None] - slack
        if len(rows) > k:
            kth = np.partition(scores, len(rows) - k, axis=1)[:, len(rows) - k, None]
            open_ &= scores >= kth - slack
        for i, own in enumerate(open_):
            hits = np.flatnonzero(own)
            if not len(hits):
                continue
            exact = np.nan_to_num((rows[hits] * queries[at + i]).sum(1), nan=-np.inf)
            best = np.lexsort((least[hits], -exact))[:k]
            found = sorted((-exact[j], vec, copy, int(hits[j])) for j in best for copy, vec in enumerate(ids[hits[j]]))[:k]
            out += [(int(qkeys[at + i]), -s, vec, copy, bool(keys[j] == qkeys[at + i])) for s, vec, copy, j in found]
    return out


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = 0.95, trees: int = 4, leaf: int = 512, sample: int = 20_000, judged: int = 256, block: int = 2048, seed: int = 13) -> DataFrame:
    """query_id, rank, vec_id, score: of each row for which ``is_query`` holds, the ``k`` other rows with the largest inner product that the search finds, ties to the smaller vec_id.

    ``vectors``: vec_id, embedding; other columns are read by ``is_query`` only. Rows with a null id, and vectors that are null, empty, zero or hold null or non-finite numbers, take no part; neither do vectors of
    another length than the query's. Fewer than ``k`` others: all of them. Equal vectors are indexed once and stand for all their rows; repeated ids are separate rows, each a query of its own;
    an empty table gives no rows. ``sample`` vectors fit the trees and ``judged`` queries choose the budget that finds at least ``recall`` of their neighbours; every row is indexed, every query searched.
    """
    spark = vectors.sparkSession
    v = F.col("embedding")
    rows = vectors.where(F.col("vec_id").isNotNull() & good_vector(v)).select("vec_id", v.alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.xxhash64(F.size(v), v).alias("key"), F.size(v).alias("dim"))
    rows = written(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "asks", "key", "dim"), "vectors")
    kind = rows.schema["embedding"].dataType.simpleString()
    # of a vector's copies the k + 1 smallest ids can be results; Spark keeps that many of each task's
    first = rows.select("key", "vec_id", "embedding", "dim", F.row_number().over(Window.partitionBy("key").orderBy("vec_id")).alias("r")).where(F.col("r") <= k + 1)
    first = first.groupBy("key").agg(F.any_value("dim").alias("dim"), F.sort_array(F.collect_list("vec_id")).alias("ids"), F.any_value("embedding").alias("embedding"))
    own = written(first.join(rows.where("asks").select("key", F.lit(True).alias("asked")).distinct(), "key", "left").withColumn("asked", F.coalesce("asked", F.lit(False))), "distinct")
    squares = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    share = {r["dim"]: (r["n"], max(float(r["longest"]), 1e-150), r["queries"]) for r in own.groupBy("dim").agg(F.count("*").alias("n"), F.sqrt(F.max(squares)).alias("longest"), F.count_if("asked").alias("queries")).collect()}
    draw = lambda salt: F.pmod(F.xxhash64("key", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    limits = spark.createDataFrame([(d, min(1.0, sample / n), min(1.0, judged / max(1, q))) for d, (n, _, q) in share.items()], "dim int, fits double, judges double")
    drawn = own.join(F.broadcast(limits), "dim").withColumn("draw", draw(seed)).withColumn("judged", draw(seed + 1))  # a row for each length
    fitted: dict[int, list] = {d: [] for d in share}
    for b in drawn.where(F.col("draw") < F.col("fits")).orderBy("dim", "draw").select("dim", "embedding").toArrow().to_batches():
        dims = b.column("dim").to_numpy()
        for d in np.unique(dims):
            fitted[int(d)].append(matrix(b.column("embedding").take(pa.array(np.flatnonzero(dims == d)))))
    forests = {d: Forest(np.concatenate([*fitted[d], np.zeros((0, d))]), n, longest, trees, leaf, seed) for d, (n, longest, _) in share.items()}
    sent = spark.sparkContext.broadcast(forests)

    def by_length(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        dims = b.column("dim").to_numpy()
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            yield int(d), at, matrix(b.column("embedding").take(pa.array(at)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaves = np.zeros((b.num_rows, trees), np.int64)
            for d, at, x in by_length(b):
                leaves[at] = sent.value[d].route(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, leaves.size + 1, trees, np.int32)), pa.array(leaves.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, "leaves"])

    placed = written(own.mapInArrow(assign, f"key long, dim int, ids array<long>, embedding {kind}, asked boolean, leaves array<long>"), "leaves")
    for r in placed.select("dim", F.explode("leaves").alias("l")).groupBy("dim", F.floor(F.col("l") / SUB).alias("l")).count().collect():  # a row for each leaf that the sample made
        forests[r["dim"]].leaves[r["l"]].rows = float(r["count"])
    sent = spark.sparkContext.broadcast(forests)
    budgets = _budgets(drawn.where(F.col("asked") & (F.col("judged") < F.col("judges"))), placed, share, sent, by_length, k, recall)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query's leaves, and a score that its ``k``-th neighbour in these reaches, as so many of the sample's vectors there do."""
        for b in batches:
            leaves: list = [None] * b.num_rows
            nothing = np.zeros(0, np.int64)
            bounds = np.full(b.num_rows, -np.inf)
            for d, at, x in by_length(b):
                forest = sent.value[d]
                for i, q in zip(at, x, strict=True):
                    got, held = [], 0.0
                    for number, n in forest.visit(q):
                        if held >= budgets[d]:
                            break
                        got.append(number)
                        held += n
                    leaves[i] = got
                    there = np.zeros(len(forest.sample), bool)
                    for number in got:
                        there[forest.members.get(number, nothing)] = True
                    if there.sum() > k:
                        bounds[i] = np.partition(np.nan_to_num(forest.sample[there] @ q, nan=-np.inf), -(k + 1))[-(k + 1)]
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("dim"), b.column("embedding"), pa.array(bounds), pa.array(leaves, pa.list_(pa.int64()))], ["key", "dim", "embedding", "bound", "leaves"])

    asked = written(placed.where("asked").select("key", "dim", "embedding").repartition(F.col("key")).mapInArrow(ask, f"key long, dim int, embedding {kind}, bound double, leaves array<long>"), "asked")
    sizes = placed.select("dim", F.explode("leaves").alias("leaf")).groupBy("dim", "leaf").agg(F.ceil(F.count("*") / block).cast("int").alias("rblocks"))
    sizes = written(asked.select("dim", F.explode("leaves").alias("leaf")).groupBy("dim", "leaf").agg(F.ceil(F.count("*") / block).cast("int").alias("qblocks")).join(sizes, ["dim", "leaf"]), "blocks")
    sizes = F.broadcast(sizes) if sizes.count() <= 500_000 else sizes
    part = lambda n: F.pmod(F.xxhash64("key", F.lit(5)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    here = placed.select("key", "dim", "ids", "embedding", F.explode("leaves").alias("leaf")).join(sizes, ["dim", "leaf"]).withColumn("rblock", part("rblocks")).withColumn("qblock", every("qblocks"))
    there = asked.select("key", "dim", "embedding", "bound", F.explode("leaves").alias("leaf")).join(sizes, ["dim", "leaf"]).withColumn("qblock", part("qblocks")).withColumn("rblock", every("rblocks"))
    on = ["dim", "leaf", "rblock", "qblock"]

    def meet(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found = compare(matrix(left["embedding"]), left["key"].to_numpy(), left["ids"].to_pylist(), matrix(right["embedding"]), right["key"].to_numpy(), right["bound"].to_numpy(), k + 1) if left.num_rows and right.num_rows else []
        types = (pa.int64(), pa.float64(), pa.int64(), pa.int32(), pa.bool_())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [[]] * 5, types, strict=True)], ["key", "score", "vec_id", "copy", "own"])

    found = here.select(*on, "key", "ids", "embedding").groupBy(*on).cogroup(there.select(*on, "key", "embedding", "bound").groupBy(*on)).applyInArrow(meet, "key long, score double, vec_id long, copy int, own boolean")
    # a row is met in several trees; of each query at most k + 1 entries of each of its leaves stand here
    best = found.groupBy("key").agg(F.slice(F.sort_array(F.collect_set(F.struct((-F.col("score")).alias("s"), "vec_id", "copy", "own"))), 1, k + 1).alias("best"))
    mine = lambda x: x["own"] & (x["vec_id"] == F.col("query_id"))
    queries = rows.where("asks").select(F.col("vec_id").alias("query_id"), "key").join(written(best, "best"), "key")
    place = F.array_position(F.transform("best", mine), F.lit(True)).cast("int")
    others = F.slice(F.when(place > 0, F.filter("best", lambda x, i: i != place - 1)).otherwise(F.col("best")), 1, k)
    return queries.select("query_id", F.posexplode(others).alias("i", "e")).select("query_id", (F.col("i") + 1).alias("rank"), F.col("e.vec_id").alias("vec_id"), (-F.col("e.s")).alias("score"))


def _budgets(judged: DataFrame, placed: DataFrame, share: dict, sent, by_length, k: int, recall: float) -> dict[int, float]:
    """By length: how many vectors a query's leaves must hold, so that those of the judged queries hold ``recall`` of their true neighbours."""
    some: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for b in judged.select("dim", "key", "embedding").toArrow().to_batches():
        for d, at, x in by_length(b):
            keys, before = b.column("key").to_numpy()[at], some.get(d)
            some[d] = (keys, x) if before is None else (np.concatenate([before[0], keys]), np.concatenate([before[1], x]))
    spark = placed.sparkSession
    asked = spark.sparkContext.broadcast(some)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best of a task's vectors for each judged query: at most ``k`` of each."""
        best: dict[int, tuple] = {}
        for b in batches:
            for d, at, x in by_length(b):
                if d not in asked.value:
                    continue
                qkeys, q = asked.value[d]
                keys, leaves = b.column("key").to_numpy()[at], np.array(b.column("leaves").take(pa.array(at)).flatten()).reshape(len(at), -1)
                s = np.nan_to_num(q @ x.T, nan=-np.inf)
                s[qkeys[:, None] == keys[None, :]] = -np.inf
                old = best.get(d, (np.full((len(q), 0), 0.0), np.zeros((len(q), 0, leaves.shape[1]), np.int64)))
                s, ls = np.concatenate([old[0], s], 1), np.concatenate([old[1], np.broadcast_to(leaves, (len(q), *leaves.shape))], 1)
                top = np.argsort(-s, 1, kind="stable")[:, :k]
                best[d] = np.take_along_axis(s, top, 1), np.take_along_axis(ls, top[:, :, None], 1)
        for d, (s, ls) in best.items():
            i, j = np.nonzero(s > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d, np.int32)), pa.array(i.astype(np.int32)), pa.array(s[i, j]), pa.array(list(ls[i, j]), pa.list_(pa.int64()))], ["dim", "i", "s", "leaves"])

    near = placed.select("dim", "key", "embedding", "leaves").mapInArrow(scan, "dim int, i int, s double, leaves array<long>")
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("dim", "i").orderBy(F.desc("s"), "leaves"))).where(F.col("r") <= k)

    def until(group: tuple, data: pa.Table) -> pa.Table:
        """How many vectors the queue gives out until each neighbour's leaf, in the tree where it comes first."""
        d, i = group[0].as_py(), group[1].as_py()
        want = [set(x) for x in data["leaves"].to_pylist()]
        held, out = 0.0, []
        for number, n in sent.value[d].visit(asked.value[d][1][i]):
            held += n
            out += [held for w in want if number in w]
            want = [w for w in want if number not in w]
            if not want:
                break
        return pa.table([pa.array([d] * len(out), pa.int32()), pa.array(out, pa.float64())], ["dim", "held"])

    got = near.select("dim", "i", "leaves").groupBy("dim", "i").applyInArrow(until, "dim int, held double").toPandas()
    asked_for = {int(d): float(np.quantile(g, recall, method="higher")) for d, g in got.groupby("dim")["held"]}
    # k + 1 vectors stand in so many leaves' places, at least
    return {d: max(float(len(sent.value[d].trees) * (k + 1)), asked_for.get(d, 0.0)) for d in share}
