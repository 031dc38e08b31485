"""Near duplicates among whole texts by the characters that they keep in common order, exactly and for texts of any length."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidra.sources.io import attach, settled

_BLOCK = 1 << 20  # characters


def fingerprints(text: str, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct least gram hashes of the windows of ``window`` characters, and how many windows have each. Equal windows of two texts have equal hashes; a shorter text has none."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    wide = window - gram + 1
    count = len(codes) - gram + 1
    if count < wide:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    hashed, size = codes, 1
    while size * 2 <= gram:
        hashed, size = hashed[:-size] * np.uint64(0x9E3779B97F4A7C15) + (hashed[size:] ^ (hashed[size:] >> np.uint64(29))), size * 2
    if size < gram:
        hashed = hashed[: size - gram] * np.uint64(0xC2B2AE3D27D4EB4F) + hashed[gram - size :]
    hashed = (hashed ^ (hashed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    hashed ^= hashed >> np.uint64(29)
    least, size = hashed, 1
    while size * 2 <= wide:
        least, size = np.minimum(least[:-size], least[size:]), size * 2
    last = count - wide + 1
    least = np.minimum(least[:last], least[wide - size :][:last]).view(np.int64)
    starts = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    values, place = np.unique(least[starts], return_inverse=True)
    return values, np.bincount(place, np.diff(starts, append=last)).astype(np.int64)


def _run(a: str, b: str, x: int, y: int) -> int:
    """Length of the run that ``a`` from x and ``b`` from y have in common."""
    most, low, step, growing = min(len(a) - x, len(b) - y), 0, 64, True
    if most <= 0 or a[x] != b[y]:
        return 0
    while step and low < most:
        take = min(step, most - low)
        same = a[x + low : x + low + take] == b[y + low : y + low + take]
        growing = growing and same
        low += take if same else 0
        step = step * 2 if growing else step // 2
    return low


def edit_distance(a: str, b: str, most: int) -> int:
    """Least number of inserted and deleted characters from ``a`` to ``b``, -1 if above ``most``: furthest points by diagonal (Myers 1986), O(most) memory, O(most^2) runs."""
    apart = len(a) - len(b)
    far = [-(1 << 60)] * (2 * most + 3)
    mid = most + 1
    far[mid + 1] = 0
    for d in range(most + 1):
        low, high = max(-d, apart - (most - d)), min(d, apart + most - d)
        for k in range(low + (low + d) % 2, high + 1, 2):
            x = max(far[mid + k + 1], far[mid + k - 1] + 1)
            x += _run(a, b, x, x - k)
            far[mid + k] = x
            if k == apart and x >= len(a):
                return d
    return -1


def _print_rows(batches, window: int, gram: int):
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            piece = batch.slice(start, 64)
            found = [fingerprints(t, window, gram) for t in piece.column("t").to_pylist()]
            rows = np.repeat(np.arange(len(found)), [len(v) for v, _ in found])
            ids = [piece.column(c).take(pa.array(rows)) for c in ("class_id", "n")]
            yield pa.RecordBatch.from_arrays([*ids, *(pa.array(np.concatenate([f[i] for f in found])) for i in (0, 1))], names=["class_id", "n", "g", "w"])


def text_classes(df: DataFrame, key: str, text: str, group: str) -> tuple[DataFrame, DataFrame]:
    """(members: id, grp, class_id; classes: class_id, t), one class for each distinct text; its id is the smallest of its texts. Null and empty texts are in none; ``key`` is unique."""
    rows = settled(df.select(F.col(key).alias("id"), F.col(group).alias("grp"), F.col(text).alias("t")).where(F.col("id").isNotNull() & (F.length("t") > 0)), "texts")
    digests = settled(rows.select("id", "grp", F.sha2("t", 256).alias("h")), "digests")
    heads = digests.groupBy("h").agg(F.min("id").alias("class_id"))
    members = settled(digests.join(heads, "h").select("id", "grp", "class_id"), "members")
    return members, settled(rows.join(members.where("id = class_id").select("id"), "id", "left_semi").select(F.col("id").alias("class_id"), "t"), "classes")


def near_text_pairs(classes: DataFrame, ratio: float = 0.995) -> DataFrame:
    """Pairs a < b of distinct texts (class_id, t) with 2 * M / (n + m) >= ``ratio`` (from 0.98 to below 1), M the length of their longest common subsequence: a, b, distance, ratio. Exact.

    d = n + m - 2 * M edits are allowed in proportion to length. Each edit touches at most ``window`` windows of a text, so texts within the ratio share the least gram hash of all but ``window`` * d
    windows: the rarest hash that they share is among the rarest hashes of each text whose predecessors weigh no more than that (weight: windows with that hash). So what many texts quote is met by those
    alone that have little else. The smallest owner of such a hash names its region, and a region has the owners of all its hashes: near texts have one in common, and many hashes of like texts become one
    region. A text goes to its few regions, not to its pairs; regions of more than 2^20 characters are dealt to blocks that meet two by two. A pair is compared in its first common region, if counts of its
    characters allow it. A window of a quarter of 1 / (1 - ratio) characters leaves some windows untouched in every text that may have an edit at all.
    """
    if not 0.98 <= ratio < 1:
        raise ValueError("ratio must be from 0.98 to below 1")
    share = 1 - ratio
    window = round(1 / share) // 4
    gram = max(window // 3, 1)
    rows = classes.select("class_id", F.length("t").cast("long").alias("n"), "t").where(F.col("n") >= window)
    kind = classes.schema["class_id"].dataType.simpleString()
    prints = settled(rows.mapInArrow(partial(_print_rows, window=window, gram=gram), f"class_id {kind}, n long, g long, w long"), "prints")
    often = settled(prints.groupBy("g").agg(F.count("*").alias("df")).where("df > 1"), "often")
    own = Window.partitionBy("class_id")
    before = F.coalesce(F.sum("w").over(own.orderBy("df", "g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    alone = F.col("n") - window + 1 - F.sum("w").over(own)  # windows whose hash no other text has: the rarest of all
    ranked = attach(prints, often, ["g"]).withColumn("before", before + alone)
    posts = settled(ranked.where(F.col("before") <= window * F.floor(F.col("n") * (2 * share / ratio) + 1e-9)).select("class_id", "n", "g"), "posts")
    heads = settled(posts.groupBy("g").agg(F.min("class_id").alias("region"), F.count("*").alias("owners")).where("owners > 1").drop("owners"), "heads")
    owners = attach(posts, heads, ["g"])
    owners = settled(owners.select("class_id", "n", "region").distinct(), "owners")
    blocks = F.ceil(F.sum("n") / _BLOCK).cast("int").alias("blocks")
    regions = settled(owners.groupBy("region").agg(F.count("*").alias("texts"), blocks).where("texts > 1").drop("texts"), "regions")
    own = attach(owners, regions, ["region"]).groupBy("class_id").agg(F.sort_array(F.collect_list(F.struct("region", "blocks"))).alias("own"))
    seats = rows.join(own, "class_id").select("class_id", "t", F.col("own.region").alias("all"), F.explode("own").alias("o")).select("class_id", "t", "all", F.col("o.region"), F.col("o.blocks"))
    mine = F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int")
    seats = seats.withColumn("block", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = seats.select("class_id", "t", "all", "region", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))

    def near(cell: pa.Table) -> pa.Table:
        return _near(cell, share)

    found = cells.groupBy("region", "x", "y").applyInArrow(near, f"a {kind}, b {kind}, distance long, size long")
    return found.select("a", "b", "distance", (1 - F.col("distance") / F.col("size")).alias("ratio"))


def _near(table: pa.Table, share: float) -> pa.Table:
    """Near pairs of a region's block, or of two blocks, whose first common region this is."""
    region, cross = table.column("region")[0].as_py(), table.column("x")[0].as_py() != table.column("y")[0].as_py()
    texts = table.column("t").to_pylist()
    order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
    texts = [texts[i] for i in order]
    ids, every, block = ([values[i] for i in order] for values in (table.column(c).to_pylist() for c in ("class_id", "all", "block")))
    every, block = [frozenset(x) for x in every], np.array(block)
    n = np.array([len(t) for t in texts])
    letters = np.stack([np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) & 127, minlength=128) for t in texts]).astype(np.int32)
    found = []
    for i in range(len(texts) - 1):
        end = int(np.searchsorted(n, n[i] * (1 + share) / (1 - share) + 1, "right"))
        most = (share * (n[i] + n[i + 1 : end]) + 1e-9).astype(np.int64)
        fits = np.abs(letters[i + 1 : end] - letters[i]).sum(1) <= most  # an edit changes one count by one
        if cross:
            fits &= block[i + 1 : end] != block[i]
        for at in np.flatnonzero(fits).tolist():
            j = i + 1 + at
            if min(every[i] & every[j]) == region and (distance := edit_distance(texts[i], texts[j], int(most[at]))) >= 0:
                found.append((min(ids[i], ids[j]), max(ids[i], ids[j]), distance, int(n[i] + n[j])))
    kind = table.schema.field("class_id").type
    columns = list(zip(*found, strict=True)) or [()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, (kind, kind, pa.int64(), pa.int64()), strict=True)], names=["a", "b", "distance", "size"])


def near_text_links(df: DataFrame, key: str, text: str, group: str, ratio: float = 0.995) -> DataFrame:
    """One row for each text that isn't empty: ``key``, class_id (smallest key with the same text), n_equal and n_near (rows of other groups with the same or a near text), best (their highest ratio, null
    without any). Copies aren't expanded into pairs: links between classes meet counts by class and group. A null group is a group of its own."""
    members, classes = text_classes(df, key, text, group)
    links = settled(near_text_pairs(classes, ratio), "links")
    seats = settled(members.groupBy("class_id", "grp").agg(F.count("*").alias("n")), "seats")
    total = settled(seats.groupBy("class_id").agg(F.sum("n").alias("total")), "total")
    ways = links.select("a", "b", "ratio").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "ratio"))
    met = ways.join(seats.select(F.col("class_id").alias("a"), F.col("grp").alias("grp_a")), "a").join(total.withColumnRenamed("class_id", "b"), "b").alias("w")
    met = met.join(seats.alias("s"), (F.col("w.b") == F.col("s.class_id")) & F.col("w.grp_a").eqNullSafe(F.col("s.grp")), "left")
    others = F.col("w.total") - F.coalesce(F.col("s.n"), F.lit(0))
    near = met.groupBy(F.col("w.a").alias("near_id"), F.col("w.grp_a").alias("near_grp")).agg(F.sum(others).alias("n_near"), F.max(F.when(others > 0, F.col("w.ratio"))).alias("best"))
    own = seats.join(total, "class_id").select("class_id", "grp", (F.col("total") - F.col("n")).alias("n_equal"))
    facts = own.join(near, (own["class_id"] == near["near_id"]) & own["grp"].eqNullSafe(near["near_grp"]), "left")
    facts = facts.select(F.col("class_id").alias("fact_id"), F.col("grp").alias("fact_grp"), "n_equal", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("n_equal") > 0, 1.0).otherwise(F.col("best")).alias("best"))
    out = members.join(facts, (members["class_id"] == facts["fact_id"]) & members["grp"].eqNullSafe(facts["fact_grp"]))
    return out.select(F.col("id").alias(key), "class_id", "n_equal", "n_near", "best")
