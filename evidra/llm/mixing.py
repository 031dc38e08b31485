"""Mixing sources to target weights.

Each document gets a hash-random key; within a source, documents stand in the order of their keys. Prefix sums of sizes
are taken in two steps, as a distributed scan is: the key range of a source is cut into ranges, sums of ranges are
added up first, then the documents of each range. A source's whole epochs go to all its documents, and the rest of its budget cuts
the prefix sums at exactly that number of words.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.llm.common import WORD, written


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fill_targets(sizes: dict, weights: dict, share: float, most: float) -> dict:
    """Targets that sum to ``share`` of all sizes, by weight, none above ``most`` times its source's size: the excess is shared again by weight among those below."""
    left, open_, out = share * sum(sizes.values()), set(sizes), {}
    while open_:
        total = sum(weights[s] for s in open_)
        full = [s for s in open_ if left * weights[s] / total > most * sizes[s]]
        if not full:
            out |= {s: left * weights[s] / total for s in open_}
            break
        for s in full:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in full)
        open_ -= set(full)
    return out


def mix_sources(docs: DataFrame, weights: tuple = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 11, rows_per_range: int = 2_000, max_sources: int = 1_000_000, carry: bool = False) -> DataFrame:
    """Words taken of each document so that each source meets its target.

    Sources in code point order (null last) weigh ``weights``, repeating. Returns doc_id, source, size, source_size, target,
    taken, and with ``carry`` the whole row as a struct ``row``. A source's taken words differ from its target by less than one; the document at the cut gives
    the first words only. Null text has size 0; a source without words has target 0; repeated rows are separate documents,
    and equal rows swap places freely; other columns are not read. Only one row for each source reaches the driver (at most ``max_sources``).
    """
    spark = docs.sparkSession
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")).alias("key")
    rows_too = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] * carry
    sized = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key, *rows_too), "mix-sizes")
    rows = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("docs")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    rows.sort(key=lambda r: (r["source"] is None, r["source"] or ""))  # Python orders text by code point
    sizes = {i: r["n"] for i, r in enumerate(rows)}
    targets = fill_targets(sizes, {i: weights[i % len(weights)] for i in sizes}, share, most)
    plan = spark.createDataFrame(
        [(r["source"], r["n"], float(targets[i]), int(targets[i] // r["n"]) if r["n"] else 0, max(1, -(-r["docs"] // rows_per_range))) for i, r in enumerate(rows)],
        "source string, source_size long, target double, epochs long, ranges long",
    )
    by = sized.withColumnRenamed("source", "s").join(plan, F.col("s").eqNullSafe(F.col("source"))).drop("s")
    span = F.floor((F.shiftrightunsigned(F.col("key"), 33).cast("double") / float(1 << 31)) * F.col("ranges")).cast("long")
    by = by.withColumn("span", span)
    sums = by.groupBy("source", "span").agg(F.sum("size").alias("in_span"))
    before = F.sum("in_span").over(Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(F.col("source").alias("s"), F.col("span").alias("p"), F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.sum("size").over(Window.partitionBy("source", "span").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1))
    placed = by.withColumn("inside", F.coalesce(inside, F.lit(0))).join(sums, F.col("s").eqNullSafe(F.col("source")) & (F.col("p") == F.col("span")))
    rest = F.round(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("base") - F.col("inside")))
    return placed.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + last).alias("taken"), *["row"] * carry)


_WORD = re.compile(WORD)


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """The mix as rows with the columns of ``docs``: each document as often as it is taken whole, and at a source's cut once more with its first words only (``n_chars``, if there, follows)."""
    columns = docs.columns

    def repeat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b.slice(at, 128) for b in batches for at in range(0, b.num_rows, 128)):
            size, taken = (b.column(c).to_numpy() for c in ("size", "taken"))
            whole, rest = taken // np.maximum(size, 1), taken % np.maximum(size, 1)
            rows = pa.RecordBatch.from_arrays(b.column("row").flatten(), columns)
            yield rows.take(pa.array(np.repeat(np.arange(b.num_rows), whole)))
            for i in np.flatnonzero(rest):
                row = rows.slice(int(i), 1).to_pylist()[0]
                words = itertools.islice(_WORD.finditer(row["text"]), int(rest[i]))
                row["text"] = row["text"][: max(m.end() for m in words)]
                if "n_chars" in row:
                    row["n_chars"] = len(row["text"])
                yield pa.RecordBatch.from_pylist([row], rows.schema)

    return mix_sources(docs, carry=True, **params).select("size", "taken", "row").mapInArrow(repeat, docs.schema)
