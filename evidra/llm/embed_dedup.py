"""Embedding near-duplicates by a forest of random-projection trees.

Each tree splits the unit vectors at random hyperplanes, again and again; vectors near a hyperplane go to both sides. All pairs within
a leaf are compared in double precision, so no pair below the threshold is linked. A hyperplane must not part a group of near copies that is a large share of its
node: such a group is a ball around its mean, and goes whole to the side on which that lies, while the rest of the node is parted as ever; a node that is little but one group is a leaf. Trees are fitted on a bounded
sample of vectors (``sample``, in the order of a hash) and index every vector; where a leaf's share of the table is too large and its sample used up, hyperplanes through its mean, which need no sample, part it further. A pair is counted in the first leaf that it shares, and each
leaf gives links as counts and stars, so that groups of thousands of copies never become pair rows. Leaves of more
than ``block`` vectors are compared block by block in separate tasks.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import written
from evidra.llm.components import connected_components
from evidra.llm.vectors import good_vector, matrix, sample_by_length

#: Leaves of one tree are numbered from tree * TREE, times SUB for the sides of up to 20 further hyperplanes.
TREE, SUB = 1 << 24, 1 << 20
#: A vector is in a hot group if it links with this share of its node (judged on so many vectors); a side may have this share of its node.
HOT, LOOK, MOST = 0.05, 2000, 0.8


@functools.lru_cache(1 << 14)
def _direction(leaf: int, level: int, dim: int) -> np.ndarray:
    d = np.random.default_rng((leaf, level)).standard_normal(dim)
    return d / np.linalg.norm(d)


@dataclass
class Node:
    """A hyperplane and its sides; hot groups, as their centres and least cosines with them, count by the centre's place."""

    direction: np.ndarray
    cut: float
    centres: np.ndarray
    least: np.ndarray
    left: Node | Leaf | None = None
    right: Node | Leaf | None = None

    def sides(self, x: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
        """Which vectors go left, and which right."""
        at, near = x @ self.direction, np.full(len(x), spill)
        if len(self.centres):
            close = x @ self.centres.T - self.least
            group = close.argmax(1)
            own = close[np.arange(len(x)), group] >= 0
            at[own], near[own] = (self.centres @ self.direction)[group[own]], 0.0
        return at <= self.cut + near, at > self.cut - near


@dataclass
class Leaf:
    number: int
    mean: np.ndarray
    levels: int


class Forest:
    """Trees of nodes and leaves."""

    def __init__(self, sample: np.ndarray, n: int, trees: int, leaf: int, spill: float, seed: int, threshold: float) -> None:
        self.spill, self.threshold, self.trees = spill, threshold, []
        rng = np.random.default_rng(seed)
        scale = n / max(1, len(sample))
        for t in range(trees):
            self.next = t * TREE
            self.trees.append(self._grow(sample, scale, leaf, rng))

    def _groups(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hot groups of a node (judged on at most ``LOOK`` of its vectors): their mean directions, and the least cosine of a member with it."""
        some = x[:: -(-len(x) // LOOK)]
        linked = some @ some.T >= self.threshold
        least = max(3, HOT * len(some))
        hot = linked.sum(1) >= least
        some, linked = some[hot], linked[np.ix_(hot, hot)]
        centres, edges, free = [], [], np.ones(len(some), bool)
        while free.any():
            degree = (linked & free).sum(1) * free
            members = linked[degree.argmax()] & free
            if members.sum() < least / 2:
                break
            centre = some[members].sum(0)
            centre /= np.linalg.norm(centre)
            cosine = some @ centre
            edge = cosine[members].min() - 0.01
            centres.append(centre)
            edges.append(edge)
            free &= ~(members | (cosine >= edge))
        return np.array(centres).reshape(-1, x.shape[1]), np.array(edges)

    def _grow(self, x: np.ndarray, scale: float, leaf: int, rng: np.random.Generator) -> Node | Leaf:
        if len(x) * scale > leaf and len(x) >= 8:
            centres, edges = self._groups(x)
            for _ in range(8):
                direction = rng.standard_normal(x.shape[1])
                direction /= np.linalg.norm(direction)
                node = Node(direction, 0.0, centres, edges)
                at = x @ direction
                if len(centres):
                    close = x @ centres.T - edges
                    own = close.max(1) >= 0
                    at[own] = (centres @ direction)[close.argmax(1)[own]]
                low, high = np.quantile(at, rng.uniform(0.4, 0.6), method="lower"), at.max()
                above = at[at > low]  # between two places, so that no group lies on the hyperplane
                node.cut = float(low + above.min()) / 2 if len(above) else float(high)
                left, right = node.sides(x, self.spill)
                if max(left.sum(), right.sum()) <= MOST * len(x):
                    node.left, node.right = self._grow(x[left], scale, leaf, rng), self._grow(x[right], scale, leaf, rng)
                    return node
        levels = int(np.ceil(np.log2(max(1.0, len(x) * scale / leaf)))) if len(x) < 8 else 0
        self.next += 1
        return Leaf(self.next - 1, x.mean(0) if len(x) else np.zeros(x.shape[1]), min(20, levels))

    def leaves(self, x: np.ndarray) -> list[list[int]]:
        """Numbers of the leaves of each unit vector, ascending."""
        out: list[list[int]] = [[] for _ in range(len(x))]

        def deeper(leaf: Leaf, level: int, sides: int, rows: np.ndarray) -> None:
            if level == leaf.levels:
                for i in rows:
                    out[i].append(leaf.number * SUB + sides)
            elif len(rows):
                at = (x[rows] - leaf.mean) @ _direction(leaf.number, level, x.shape[1])
                deeper(leaf, level + 1, sides, rows[at <= self.spill])
                deeper(leaf, level + 1, sides | 1 << level, rows[at > -self.spill])

        def route(node: Node | Leaf, rows: np.ndarray) -> None:
            if isinstance(node, Leaf):
                deeper(node, 0, 0, rows)
            elif len(rows):
                left, right = node.sides(x[rows], self.spill)
                route(node.left, rows[left])
                route(node.right, rows[right])

        for tree in self.trees:
            route(tree, np.arange(len(x)))
        return [sorted(o) for o in out]


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors; the largest number is divided out first, so that squares neither vanish nor overflow."""
    x = x / np.abs(x).max(1, keepdims=True, initial=1e-323)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def compare_leaf(leaf: int, keys: np.ndarray, unit: np.ndarray, copies: np.ndarray, leaves: list[np.ndarray], side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of linked vectors, the links counted in this leaf, and a key of their local component.

    ``side`` holds a block number for each vector; where there are two blocks only pairs across them count.
    """
    n = len(keys)
    linked = np.zeros((n, n), bool)
    for i in range(0, n, 1024):
        linked[i : i + 1024] = unit[i : i + 1024] @ unit.T >= threshold
    np.fill_diagonal(linked, False)
    if side.min() != side.max():
        linked &= side[:, None] != side[None, :]
    rows = np.flatnonzero(linked.any(1))
    if not len(rows):
        return keys[:0], np.zeros(0, np.int64), keys[:0]
    linked, keys, copies = linked[np.ix_(rows, rows)], keys[rows], copies[rows]
    earlier: dict[int, int] = {}
    ones = [(r, earlier.setdefault(int(x), len(earlier))) for r, i in enumerate(rows) for x in leaves[i] if x < leaf]
    counted = linked.copy()
    if ones:
        has = np.zeros((len(rows), len(earlier)), np.float32)
        has[tuple(np.array(ones).T)] = 1
        for i in range(0, len(rows), 1024):
            counted[i : i + 1024] &= has[i : i + 1024] @ has.T == 0
    root = np.full(len(rows), -1)
    for r in range(len(rows)):
        if root[r] < 0:
            new = np.array([r])
            while len(new):
                root[new] = r
                new = np.flatnonzero(linked[new].any(0) & (root < 0))
    return keys, counted @ copies, keys[root]


def near_vectors(vectors: DataFrame, threshold: float = 0.9, trees: int = 6, leaf: int = 512, spill: float = 0.015, sample: int = 20_000, block: int = 2048, seed: int = 7) -> DataFrame:
    """One row for each row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Links are pairs of rows with a cosine of at least ``threshold``; ``component_id`` is the smallest vec_id reachable. Vectors that
    are null, zero or hold null or non-finite numbers link with nothing, and neither do vectors of different
    lengths. Equal vectors are compared once and counted as often as they stand there; repeated ids are separate rows;
    rows with a null id link with nothing and are their own (null) component. An empty table gives no rows; other columns aren't read.
    """
    spark = vectors.sparkSession
    v = F.col("embedding")
    good = F.col("vec_id").isNotNull() & good_vector(v)
    rows = vectors.select("vec_id", v.alias("embedding"), F.when(good, F.xxhash64(F.size(v), v)).alias("key"))
    kind = vectors.schema["embedding"].dataType.simpleString()
    own = written(rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.any_value("embedding").alias("embedding")).withColumn("dim", F.size("embedding")), "vectors")
    forests = {d: Forest(_unit(x), n, trees, leaf, spill, seed + d, threshold) for d, (n, x) in sample_by_length(own, sample, seed).items()}
    sent = spark.sparkContext.broadcast(forests)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaves: list = [None] * b.num_rows
            dims = b.column("dim").to_numpy()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                for i, own_leaves in zip(at, sent.value[int(d)].leaves(_unit(matrix(b.column("embedding").take(pa.array(at))))), strict=True):
                    leaves[i] = own_leaves
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("key", "dim", "copies", "embedding")), pa.array(leaves, pa.list_(pa.int64()))], ["key", "dim", "copies", "embedding", "leaves"])

    placed = written(own.select("key", "dim", "copies", "embedding").mapInArrow(assign, f"key long, dim int, copies long, embedding {kind}, leaves array<long>"), "leaves")
    each = placed.withColumn("leaf", F.explode("leaves"))
    # Leaves above the block size: at most (rows / block) of them.
    large = placed.select("dim", F.explode("leaves").alias("leaf")).groupBy("dim", "leaf").count().where(F.col("count") > block).select("dim", "leaf", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    each = each.join(large, ["dim", "leaf"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("key", F.lit(3)), F.col("blocks")).cast("int")
    each = each.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")})

    def compare(group: tuple, data: pa.Table) -> pa.Table:
        leaves = data["leaves"].to_pylist()
        got = compare_leaf(group[1].as_py(), data["key"].to_numpy(), _unit(matrix(data["embedding"])), data["copies"].to_numpy(), leaves, data["mine"].to_numpy(), threshold)
        return pa.table([pa.array(x) for x in got], ["key", "links", "root"])

    found = written(each.select("dim", "leaf", "i", "j", "mine", "key", "copies", "embedding", "leaves").groupBy("dim", "leaf", "i", "j").applyInArrow(compare, "key long, links long, root long"), "links")
    parts = connected_components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    known = own.select("key", "least", "copies").join(links, "key", "left").join(parts.withColumnRenamed("node", "key"), "key", "left")
    known = known.withColumn("component", F.coalesce("component", "key"))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = written(known.join(least, "component").select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "vector-links")
    out = rows.select("vec_id", "key").join(known, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
