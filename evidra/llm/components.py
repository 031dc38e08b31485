"""Connected components of an edge table by alternating large and small stars, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import written


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) for each node of an edge (columns ``a``, ``b``, any order, repeats allowed) that isn't its own component.

    Self-loops and edges with a null are ignored; an empty table gives no rows. Rounds grow with the logarithm of the longest path;
    edges never come to the driver, only their number and checksum.
    """
    a, b = F.col("a"), F.col("b")
    now = written(edges.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(most_rounds):
        if not mark[0]:
            break
        least = now.groupBy("hi").agg(F.min("lo").alias("m"))
        large = now.join(least.withColumnsRenamed({"hi": "lo"}), "lo", "left").select("hi", F.coalesce("m", "lo").alias("lo"))
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi").select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo")))).alias("e")).select("e.*")
        now = written(small.where("hi <> lo").distinct(), "edges")
        mark, before = _mark(now), mark
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
