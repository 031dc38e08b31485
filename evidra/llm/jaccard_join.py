"""N-gram Jaccard join in the metric space of shingle sets.

Jaccard distance is a metric, but unrelated texts all lie at distance 1 from any pivot, so pivots drawn from the whole corpus would put
every text in one region. Regions are therefore local: each text owns the shingles that come first in a common order
(rare before frequent, then by hash), one more than a quarter of them, and two texts within the radius own one in common. The owners of a shingle are a region.

* Each region has a first pivot, the text of it that is in most regions; regions with one first pivot become one cell. Each text's distance to it is bounded from
  below by the distance of their bucket counts (a projection that shortens no distance), which settles most, and else computed. If all texts are connected with
  the pivot the cell is done. Else it leaves those that aren't, and those that one of these may reach by the triangle inequality.
* What a cell leaves of a region is a few texts as a rule: pairs of them whose windows of distances to the pivot, sizes and places of the common shingle allow the radius are compared. Of more than that, the regions are joined again.
* Then pivots that lie far apart (above three radii) make Voronoi cells: each text goes to its nearest pivot p, at distance d, and is replicated to later pivots within
  the window d + 2 radii, so that any two texts within the radius meet in a cell. All distances are exact.
* In a cell a text x stands as its difference from the pivot, the shingles that only one of the two has. Differences of two texts differ in just the shingles in which the
  texts differ, so this is a join by symmetric difference. Texts within the radius of the pivot are connected, and a pair of which one is not must have
  a shingle of their differences in common, early in both (and, of those left, sketches that differ in few bits): common order is rare before frequent, as a sample of the region has them. The owners of such a shingle are the
  regions of the next level. They lose the pivot at each level, so the recursion ends.

All links that matter for the components are found: a pair is left out only if proved too far or already connected. Distances are computed in tasks over pieces of a
region, and only regions' members are rows, never the pairs of a large region.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.llm import bloom
from evidra.llm.common import written
from evidra.llm.components import connected_components
from evidra.llm.words import mix, slices, windows, words_of

#: Two sets link when 100 * intersection >= 75 * union; the radius is a quarter.
NEAR, WHOLE = 75, 100
RADIUS = 0.25
_WORDS = 5
#: What a cell leaves of a region is compared outright up to so many texts, a region inside a cell up to this size; larger ones are read in pieces of this many texts.
SMALL, INNER, PIECE = 24, 256, 256
#: Pivots of a region at most, and texts that are looked at for the common order of differences.
PIVOTS, SAMPLE = 4, 16


class Sets:
    """Distinct shingle hashes of each text of a batch, ascending: text i has ``values[at[i]:at[i + 1]]``."""

    def __init__(self, column: pa.Array) -> None:
        w = words_of(column, lower=True)
        first, h = w.first, w.hashes()
        g, start = windows(h, w.doc, _WORDS)
        doc = w.doc[start]
        n = np.diff(first)
        few = np.flatnonzero((n > 0) & (n < _WORDS))
        if len(few):  # the whole sequence is the one shingle
            whole = np.zeros(len(few), np.uint64)
            for k in range(_WORDS - 1):
                on = n[few] > k
                whole[on] = mix(whole[on] * np.uint64(31) + h[first[few[on]] + k])
            g, doc = np.concatenate([g, whole]), np.concatenate([doc, few])
            order = np.argsort(doc, kind="stable")
            g, doc = g[order], doc[order]
        cut = np.searchsorted(doc, np.arange(len(column) + 1))
        own = [np.unique(g[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        self.size = np.array([len(x) for x in own], np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.size)))
        self.values = np.concatenate([*own, np.zeros(0, np.uint64)])
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(self.values ^ np.uint64(0xA0761D6478BD642F)))))
        #: Equal sets have one node; 0 stands for the empty set.
        self.node = np.where(self.size > 0, mix(total[self.at[1:]] - total[self.at[:-1]] + self.size.astype(np.uint64)), 0).view(np.int64)

    def owned(self, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The owned shingles of each text (its rare ones first), the text of each, and by text how many are rare and if it owns all its rare ones."""
        last = np.zeros(len(self.values), bool)
        if len(frequent) and len(self.values):
            at = np.minimum(np.searchsorted(frequent, self.values), len(frequent) - 1)
            last = frequent[at] == self.values
        count = np.where(self.size > 0, self.size - -(-NEAR * self.size // WHOLE) + 1, 0)
        doc = np.repeat(np.arange(len(self.size)), self.size)
        order = np.lexsort((last, doc)) if last.any() else np.arange(len(self.values))  # stable: hashes stay ascending
        rank = np.arange(len(self.values)) - np.repeat(self.at[:-1], self.size)
        keep = rank < np.repeat(count, self.size)
        rare = np.bincount(doc[~last], minlength=len(self.size))
        return self.values[order][keep], doc[keep], np.minimum(rare, count), rare <= count

    def buckets(self, i: int) -> bytes:
        """Shingles counted by the low bits of their hashes, in a number of buckets that grows with the set."""
        n = 1 << max(6, min(14, int(self.size[i] // 3).bit_length()))
        own = self.values[self.at[i] : self.at[i + 1]]
        return np.minimum(255, np.bincount((own & np.uint64(n - 1)).astype(np.int64), minlength=n)).astype(np.uint8).tobytes()


def may_link(a: bytes, b: bytes, n: int, m: int) -> float:
    """A lower bound of the distance of two sets by their sizes and bucket counts."""
    x, y = np.frombuffer(a, np.uint8).astype(np.int32), np.frombuffer(b, np.uint8).astype(np.int32)
    most = min(n, m)
    if x.max() < 255 and y.max() < 255:
        while len(x) > len(y):
            x = x.reshape(2, -1).sum(0)
        while len(y) > len(x):
            y = y.reshape(2, -1).sum(0)
        most = min(most, int(np.minimum(x, y).sum()))
    return 1 - most / (n + m - most)


def _u64(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def frequent_shingles(docs: DataFrame, least: int = 4, most: int = 4_000_000) -> np.ndarray:
    """Shingles that ``least`` texts count, or more where those would be above ``most``: at most that many, ascending. Each text counts the quarter of its
    shingles that a hash of shingle and text picks, so a shingle is counted in about a quarter of its texts.

    They only set the order of shingles, which is the same for all texts, so any choice gives exact results.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = Sets(b.column("text"))
            text = np.repeat(sets.node.view(np.uint64), sets.size)
            s, n = np.unique(sets.values[mix(sets.values ^ text) & np.uint64(3) == 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(n.astype(np.int32))], ["s", "n"])

    often = written(docs.select("text").mapInArrow(counts, "s long, n int").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= least), "often")
    while often.where(F.col("n") >= least).limit(most + 1).count() > most:
        least *= 2
    got = often.where(F.col("n") >= least).select("s").toArrow()["s"].combine_chunks()
    return np.sort(_u64(got)) if len(got) else np.zeros(0, np.uint64)


def _nodes(docs: DataFrame, kind: str) -> DataFrame:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = Sets(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s.size), pa.array(s.node)], ["doc_id", "n", "node"])

    return docs.select("doc_id", "text").mapInArrow(sets, f"doc_id {kind}, n long, node long")


class _Distances:
    """Distances of pairs of nodes: bounded by bucket counts, else computed from the sets, which are gathered for the nodes that need it."""

    def __init__(self, docs: DataFrame, reps: DataFrame) -> None:
        self.docs, self.reps = docs, reps  # reps: node, n, rep, buckets

    def near(self, pairs: DataFrame) -> DataFrame:
        """``a``, ``b``, ``bound`` (a lower bound of the distance), ``linked`` for pairs of nodes (each once)."""
        bounded = self.bounds(pairs)
        open_ = bounded.where(F.col("bound") <= RADIUS + 1e-9).select("a", "b")
        exact = written(compare_sets(open_, self.sets(open_.select(F.explode(F.array("a", "b")).alias("node")))), "exact")
        return bounded.join(exact, ["a", "b"], "left").select("a", "b", F.coalesce("d", "bound").alias("bound"), F.coalesce("linked", F.lit(False)).alias("linked"))

    def bounds(self, pairs: DataFrame) -> DataFrame:
        """``a``, ``b``, ``bound`` for pairs of nodes, by sizes and bucket counts."""
        side = lambda x: self.reps.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("buckets").alias(f"k_{x}"))

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = zip(*(b.column(c).to_pylist() for c in ("k_a", "k_b", "n_a", "n_b")), strict=True)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array([may_link(*r) for r in rows], pa.float64())], ["a", "b", "bound"])

        fits = F.least("n_a", "n_b") * WHOLE >= F.greatest("n_a", "n_b") * NEAR
        joined = pairs.join(side("a"), "a").join(side("b"), "b")
        far = joined.where(~fits).select("a", "b", (1 - F.least("n_a", "n_b") / F.greatest("n_a", "n_b")).alias("bound"))
        return written(joined.where(fits).select("a", "b", "n_a", "n_b", "k_a", "k_b").mapInArrow(bound, "a long, b long, bound double").unionAll(far), "bounds")

    def sets(self, nodes: DataFrame) -> DataFrame:
        """``node``, ``own`` (hashes of its shingles, ascending) of each of the nodes, from one pass over the texts."""
        wanted = written(nodes.select("node").distinct().join(self.reps.select("node", "rep"), "node"), "wanted")
        sent = self.docs.sparkSession.sparkContext.broadcast(bloom.build(wanted.select("rep"), wanted.count()))

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches):
                part = part.filter(pa.array(sent.value.has(part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64))))
                if not part.num_rows:
                    continue
                s = Sets(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s.node), pa.array([s.values[i:j].tobytes() for i, j in zip(s.at[:-1], s.at[1:], strict=True)], pa.binary())], ["rep", "node", "own"])

        # an id that stands there with several texts has several nodes, so both columns are joined
        own = self.docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(gather, "rep long, node long, own binary")
        return written(own.join(wanted, ["rep", "node"]).dropDuplicates(["node"]).select("node", "own"), "sets")


def compare_sets(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """``a``, ``b``, ``d`` (the exact distance), ``linked`` of pairs of nodes."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, linked = [], []
            for x, y in zip(b.column("own_a"), b.column("own_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)  # views: the batch isn't copied
                both = int(_inside(x, y).sum())
                d.append(1 - both / (len(x) + len(y) - both))
                linked.append(WHOLE * both >= NEAR * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(d, pa.float64()), pa.array(linked, pa.bool_())], ["a", "b", "d", "linked"])

    side = lambda x: own.select(F.col("node").alias(x), F.col("own").alias(f"own_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "own_a", "own_b").mapInArrow(compare, "a long, b long, d double, linked boolean")


def sketch(x: np.ndarray) -> list[int]:
    """1024 bits, as 16 numbers: the parity of the shingles with each value of the hash's last ten bits. Two sets differ in at least as many shingles as their sketches in bits."""
    odd = (np.bincount((x & np.uint64(1023)).astype(np.int64), minlength=1024) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).tolist()


def _inside(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in the ascending ``y``."""
    if not len(y):
        return np.zeros(len(x), bool)
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


def voronoi(group: pa.Table, frequent: np.ndarray) -> pa.Table:
    """Cells of a piece of a region: its members (``j`` = -1) and the region's pivots (``j`` = 0, 1, ...) with their sets.

    One row for each member in each of its cells: its distance to the pivot, if they link, the size of its difference from the pivot, and those shingles of the difference, in common
    order, at which it can meet a text that isn't linked with the pivot. With |D| for sizes of differences and n for those of sets, two texts link if their differences
    differ in at most (n_x + n_y) / 7 shingles, so have at least o = (|D_x| + |D_y| - (n_x + n_y) / 7) / 2 in common, the first at place |D| - o at most.
    A text y that isn't linked with p has 7 |D_y| > n_p + n_y, and a partner with |D_x| >= |D_y| - (n_x + n_y) / 7: a linked x meets y before place (7 |D_x| + n_x - n_p) / 14, y meets any other up to n_y / 3.
    """
    own = lambda t: [np.frombuffer(x.as_buffer(), np.uint64) for x in t["own"]]
    some = group.filter(pa.compute.greater_equal(group["j"], 0)).sort_by("j")
    pivots, samples = some.slice(0, PIVOTS), own(some)
    members = group.filter(pa.compute.less(group["j"], 0))
    kept: list[tuple[int, np.ndarray]] = []
    for node, p in zip(pivots["node"].to_pylist(), own(pivots), strict=True):
        both = [int(_inside(p, x).sum()) for _, x in kept]
        if all(1 - m / (len(p) + len(x) - m) > 3 * RADIUS for m, (_, x) in zip(both, kept, strict=True)):
            kept.append((node, p))
    nodes, parts, sets = members["node"].to_numpy(), members["part"].to_numpy(), own(members)
    n = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    at = np.concatenate(([0], np.cumsum(n)))
    # how many of the samples have a shingle, or lack one of a pivot: rare ones come first
    seen = sum((_inside(flat, x) for x in samples), np.zeros(len(flat), np.int64)) * 2 + _inside(flat, frequent)
    hits = [_inside(flat, p) for _, p in kept]
    both = np.array([np.diff(np.concatenate(([0], np.cumsum(h)))[at]) for h in hits]).reshape(len(kept), -1)
    size = np.array([len(p) for _, p in kept])[:, None]
    distance = 1 - both / (size + n - both)
    home = distance.argmin(0) if len(n) else np.zeros(0, np.int64)
    rows: list[tuple] = []
    for j, (pivot, p) in enumerate(kept):
        linked = WHOLE * both[j] >= NEAR * (len(p) + n - both[j])
        lacked = sum((~_inside(p, x) for x in samples), np.zeros(len(p), np.int64)) * 2
        cell = int(mix(np.array([(group["r"][0].as_py() ^ (pivot * 31)) & (1 << 64) - 1], np.uint64)).view(np.int64)[0])
        for i in np.flatnonzero((home == j) | ((home < j) & (distance[j] - distance[home, np.arange(len(n))] <= 2 * RADIUS + 1e-9))):
            if nodes[i] == pivot:
                continue
            x, gone = sets[i], ~_inside(p, sets[i])
            new = ~hits[j][at[i] : at[i + 1]]
            e = len(p) + len(x) - 2 * int(both[j, i])
            most = -(-(7 * e + len(x) - len(p)) // 14) if linked[i] else len(x) // 3 + 1
            shingles, rank = np.concatenate([x[new], p[gone]]), np.concatenate([seen[at[i] : at[i + 1]][new], lacked[gone]])
            rows.append((cell, pivot, int(nodes[i]), int(parts[i]), bool(linked[i]), e, len(x), sketch(x), shingles[np.lexsort((shingles, rank))][: max(0, most)].view(np.int64)))
    names = ["cell", "pivot", "node", "part", "linked", "e", "n", "sketch", "shingles"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.table([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 9, types, strict=True)], names)


def _attach(rows: DataFrame, facts: DataFrame, on: list[str], most: int = 500_000) -> DataFrame:
    """``rows`` joined with ``facts`` (a written table, one row for each key). Keys may be hot, so facts are broadcast as long as there are at most ``most`` of them; else both are shuffled and AQE splits what is skewed."""
    return rows.join(F.broadcast(facts) if facts.count() <= most else facts, on)


def _pairs(small: DataFrame, keys: list[str], *facts: str, far: Callable[[Column, Column], Column]) -> DataFrame:
    """``a``, ``b``: distinct pairs of the members of small regions (at most ``INNER`` each) for which ``far`` is false."""
    lists = small.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("node", *facts))).alias("m"))
    both = F.flatten(F.transform("m", lambda x, i: F.transform(F.filter(F.slice("m", i + 2, F.size("m")), lambda y: ~far(x, y)), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))))
    return lists.select(F.explode(both).alias("p")).select("p.*").distinct()


def _refine(regions: DataFrame, sets: DataFrame, parts: DataFrame, frequent: Broadcast) -> tuple[DataFrame, DataFrame]:
    """One level of regions (``r``, ``pivot``, ``node``): links found (``a``, ``b``), and the regions of the next level."""
    part = lambda df, node="node": df.join(parts.withColumnsRenamed({"node": node, "component": "part"}), node, "left").withColumn("part", F.coalesce("part", node))
    others = [F.min_by("node", F.xxhash64("node", F.lit(j))).alias(f"p{j}") for j in range(1, SAMPLE)]
    facts = written(regions.groupBy("r").agg(F.min("pivot").alias("p0"), F.count("*").alias("size"), *others).withColumn("pieces", F.ceil(F.col("size") / PIECE).cast("int")), "pivots")
    members = _attach(regions.select("r", "node"), facts.select("r", "pieces"), ["r"]).select("r", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int").alias("piece"), F.lit(-1).alias("j"), "node")
    chosen = facts.select("r", "pieces", F.posexplode(F.array(*(f"p{j}" for j in range(SAMPLE)))).alias("j", "node"))
    # these go to each piece of their region: SAMPLE rows for PIECE members
    rows = members.unionByName(chosen.select("r", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"), "j", "node"))
    rows = part(rows).join(sets, "node").select("r", "piece", "j", "node", "part", "own")
    cells = rows.groupBy("r", "piece").applyInArrow(lambda group: voronoi(group, frequent.value), "cell long, pivot long, node long, part long, linked boolean, e long, n long, sketch array<long>, shingles array<long>")
    cells = written(cells, "cells")
    links = cells.where("linked").select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()
    owned = cells.select("cell", "node", "part", "linked", "e", "n", "sketch", F.posexplode("shingles").alias("at", "s"))
    # two texts can meet at a shingle only if u_x >= v_y and u_y >= v_x (14 (|D| - at) is at least 14 o), and one of them isn't linked with the pivot
    u, v, open_ = 7 * F.col("e") - 14 * F.col("at") + F.col("n"), 7 * F.col("e") - F.col("n"), ~F.col("linked")
    bounds = [F.min(v).alias("v"), F.max(u).alias("u"), F.min(F.when(open_, v)).alias("v_open"), F.max(F.when(open_, u)).alias("u_open")]
    blocks = owned.groupBy("cell", "s").agg(F.count("*").alias("size"), F.min("part").alias("one"), F.max("part").alias("two"), *bounds)
    blocks = written(blocks.where("size > 1 and v_open is not null and one <> two").drop("size", "one", "two"), "blocks")
    meets = F.when(open_, (u >= F.col("v")) & (v <= F.col("u"))).otherwise((u >= F.col("v_open")) & (v <= F.col("u_open")))
    owned = written(_attach(owned, blocks, ["cell", "s"]).where(meets).drop("u", "v", "u_open", "v_open"), "meetings")
    sizes = written(owned.groupBy("cell", "s").agg(F.count("*").alias("size")), "sizes")
    owned = _attach(owned, sizes, ["cell", "s"])

    def far(x: Column, y: Column) -> Column:
        need = 7 * (x["e"] + y["e"]) - x["n"] - y["n"]
        apart = F.aggregate(F.zip_with(x["sketch"], y["sketch"], lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda a, b: a + b)
        return (x["part"] == y["part"]) | (x["linked"] & y["linked"]) | (14 * (x["e"] - x["at"]) < need) | (14 * (y["e"] - y["at"]) < need) | (7 * apart > x["n"] + y["n"])

    pairs = written(_pairs(owned.where(F.col("size") <= INNER), ["cell", "s"], "at", "e", "n", "part", "linked", "sketch", far=far), "pairs")
    found = written(compare_sets(pairs, sets).where("linked").select("a", "b"), "found")
    large = owned.where(F.col("size") > INNER).select("cell", "s", "node")
    degree = large.groupBy("cell", "node").agg(F.count("*").alias("degree"))
    large = written(large.join(degree, ["cell", "node"]), "large")
    first = written(large.groupBy("cell", "s").agg(F.min_by("node", F.struct(-F.col("degree"), F.col("node"))).alias("pivot")), "first")
    deeper = _attach(large.select("cell", "s", "node"), first, ["cell", "s"]).select(F.xxhash64("cell", "pivot").alias("r"), "pivot", "node").distinct()
    return written(links.unionByName(found), "links"), written(deeper, "regions")


def _in_regions(owned: DataFrame, regions: DataFrame) -> DataFrame:
    """Rows of owned shingles that are regions."""
    shared = owned.sparkSession.sparkContext.broadcast(bloom.build(regions, regions.count()))

    def in_region(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.has(b.column("s").to_numpy())))

    return owned.select("s", "node", "at", "n", "is_rare").mapInArrow(in_region, "s long, node long, at int, n long, is_rare boolean").join(regions, "s")


def near_documents(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id.

    Two texts link when 100 * intersection >= 75 * union of their sets of distinct 5-word shingles (A-Z in lower case; fewer words: the
    whole sequence is one shingle); component_id is the smallest doc_id reachable. Texts without words have empty sets and link with
    nothing; equal sets are one node however often they stand there; repeated ids are separate rows; rows with a
    null id link with nothing and have a null component; an empty table gives no rows. Sets are of 64-bit hashes. Other columns aren't read.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = docs.where("doc_id is not null").select("doc_id", "text")
    frequent = spark.sparkContext.broadcast(frequent_shingles(known))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each text: its set's node, size, bucket counts and owned shingles."""
        for b in slices(batches):
            s = Sets(b.column("text"))
            shingles, doc, rare, full = s.owned(frequent.value)
            cut = np.searchsorted(doc, np.arange(b.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(shingles.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s.size), pa.array(s.node), pa.array([s.buckets(i) for i in range(b.num_rows)], pa.binary()), lists, pa.array(rare), pa.array(full)], ["doc_id", "n", "node", "buckets", "owned", "rare", "full"])

    texts = written(known.mapInArrow(own, f"doc_id {kind}, n long, node long, buckets binary, owned array<long>, rare long, full boolean"), "owned")
    reps = texts.where("n > 0").groupBy("node").agg(F.min("doc_id").cast("long").alias("rep"), F.count("*").alias("copies"), F.any_value("n").alias("n"), F.any_value("rare").alias("rare"), F.any_value("full").alias("full"))
    reps = written(reps.join(texts.select(F.col("doc_id").alias("rep"), "node", "buckets").dropDuplicates(["rep", "node"]), ["rep", "node"]), "nodes")
    owned = texts.where("n > 0").select("node", "n", "rare", F.posexplode("owned").alias("at", "s")).select("node", "s", "at", "n", (F.col("at") < F.col("rare")).alias("is_rare"))
    regions = written(owned.groupBy("s").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("s"), "regions")
    members = written(_in_regions(owned, regions).distinct().select("s", "node", "at", "n", "is_rare"), "members")
    distances = _Distances(known, reps.select("node", "n", "rep", "buckets"))
    met = members.groupBy("node").agg(F.count("*").alias("degree"), F.count_if("is_rare").alias("met"))
    met = written(met, "met")
    pivot = written(members.select("s", "node").join(met, "node").groupBy("s").agg(F.min_by("node", F.struct(-F.col("degree"), F.col("node"))).alias("pivot")), "pivots")
    # ``alone``: rare shingles that no other text owns; a text that owns all its rare ones shares none of these
    facts = reps.join(met, "node").select("node", "n", "full", (F.col("rare") - F.col("met")).alias("alone"))
    placed = written(_attach(members.select("s", "node", "at", "n"), pivot, ["s"]).where("pivot <> node"), "placed")
    first = placed.select("pivot", "node").distinct()
    side = lambda x: facts.select(F.col("node").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("n", "full", "alone")))
    first = written(first.join(side("node"), "node").join(side("pivot"), "pivot").select("pivot", "node", _may_link().alias("open")), "first")
    got = written(distances.near(written(first.where("open").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct(), "pairs")), "near")
    parts = written(connected_components(got.where("linked").select("a", "b")), "parts")
    pairs, level = _rest(placed, first, got, parts)
    open_ = distances.bounds(pairs).where(F.col("bound") <= RADIUS + 1e-9).select("a", "b")
    again = written(open_.select(F.explode(F.array("a", "b")).alias("node")).unionAll(level.select(F.explode(F.array("node", "pivot")).alias("node"))).distinct(), "again")
    if not again.isEmpty():
        sets = distances.sets(again)
        parts = written(_merged(parts, written(compare_sets(open_, sets).where("linked").select("a", "b"), "found")), "parts")
        while not level.isEmpty():  # each level's regions have lost their pivots, so this ends
            links, level = _refine(level, sets, parts, frequent)
            parts = written(_merged(parts, links), "parts")
    labels = reps.join(parts, "node", "left").select("node", F.coalesce("component", "node").alias("part"), "rep")
    least = labels.groupBy("part").agg(F.min("rep").alias("component_id"))
    labels = written(labels.join(least, "part").select("node", "component_id"), "labels")
    rows = texts.select("doc_id", "n", "node").join(labels, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id").cast("long")).alias("component_id"))
    lost = _nodes(docs.where("doc_id is null"), kind).select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return rows.unionAll(lost)


def _merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links: only the links between different parts are joined up, by the parts' names."""
    name = lambda x: parts.select(F.col("node").alias(x), F.col("component").alias(f"{x}_part"))
    between = links.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("a_part", "a").alias("a"), F.coalesce("b_part", "b").alias("b"))
    moved = written(connected_components(between.where("a <> b")).withColumnsRenamed({"node": "was", "component": "now"}), "moved")
    # a part's name is the least node in it, which has no row of its own until it is moved
    return parts.join(moved, parts["component"] == moved["was"], "left").select("node", F.coalesce("now", "component").alias("component")).unionByName(moved.select(F.col("was").alias("node"), F.col("now").alias("component")))


def _may_link() -> Column:
    """If a text and its region's first pivot may lie within the radius, by their sizes and by what each has alone."""
    n, p, most = F.col("node_n"), F.col("pivot_n"), F.least("node_n", "pivot_n")
    both = F.least(most, F.when(F.col("pivot_full"), n - F.col("node_alone")).otherwise(most), F.when(F.col("node_full"), p - F.col("pivot_alone")).otherwise(most))
    return WHOLE * both >= NEAR * (n + p - both)


def _rest(placed: DataFrame, first: DataFrame, got: DataFrame, parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the cells of first pivots leave: pairs of texts (``a``, ``b``) of regions of which they leave up to ``SMALL``, and the other regions as (``r``, ``pivot``, ``node``).

    Cells with a text that isn't connected with the pivot leave those texts, and of the others the ones that such a text may reach by the triangle inequality.
    """
    part = lambda x, name: parts.select(F.col("node").alias(x), F.col("component").alias(name))
    rows = first.join(part("node", "own"), "node", "left").join(part("pivot", "cell"), "pivot", "left")
    rows = rows.select("pivot", "node", "open", F.coalesce("own", "node").alias("part"), (F.coalesce("own", "node") != F.coalesce("cell", "pivot")).alias("outside"), F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b"))
    rows = rows.join(got, ["a", "b"], "left").select("pivot", "node", "part", "outside", F.coalesce("bound", F.when(F.col("open"), 0.0).otherwise(RADIUS)).alias("lo"), F.when(F.col("linked"), F.col("bound")).otherwise(1.0).alias("hi"))
    rows = written(rows, "bounded")
    # a cell of one other text is done: it was compared with the pivot
    least = written(rows.groupBy("pivot").agg(F.min(F.when(F.col("outside"), F.col("lo"))).alias("o"), F.count("*").alias("size")).where("o is not null and size > 1").select("pivot", "o"), "outside")
    rows = _attach(rows, least, ["pivot"]).where(F.col("outside") | (F.col("hi") >= F.col("o") - RADIUS - 1e-9)).drop("o")
    left = written(placed.join(rows, ["pivot", "node"]), "left")
    sizes = written(left.groupBy("s").agg(F.count("*").alias("size"), F.count_if("outside").alias("out"), F.min("part").alias("one"), F.max("part").alias("two")).where("size > 1 and out > 0 and one <> two").select("s", "size"), "sizes")
    left = written(_attach(left, sizes, ["s"]), "open")

    def far(x: Column, y: Column) -> Column:
        """If two texts of a region are connected, or too far apart by their windows of distances to the pivot, or by their sizes and places of the common shingle: 7 * intersection >= 3 * (n_x + n_y), of which at least what comes after it is left."""
        apart = (x["part"] == y["part"]) | (~x["outside"] & ~y["outside"]) | (x["lo"] - y["hi"] > RADIUS + 1e-9) | (y["lo"] - x["hi"] > RADIUS + 1e-9)
        return apart | (7 * (x["n"] - x["at"]) < 3 * (x["n"] + y["n"])) | (7 * (y["n"] - y["at"]) < 3 * (x["n"] + y["n"]))

    pairs = written(_pairs(left.where(F.col("size") <= SMALL), ["s"], "at", "n", "part", "outside", "lo", "hi", far=far), "pairs")
    return pairs, written(left.where(F.col("size") > SMALL).select(F.col("pivot").alias("r"), "pivot", "node").distinct(), "regions")
