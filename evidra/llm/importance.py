"""Resampling towards a target distribution by hashed n-gram features.

A table of 256 bytes lower-cases A-Z and blanks separators in UTF-8; ``bytes.split`` gives the words, and a crc32 seeded with the crc32 of the words before it extends an n-gram by a word.
Counters of buckets are added up in each task, then over tasks, for the corpus and the target; a bucket's gain is the log of the ratio of its smoothed shares. A second pass adds up the gains of each
text. Gumbel noise from a digest of the id makes the highest scores a draw without replacement; ranks come from ranges of the score and the ranges' sizes, so no task sorts all rows.
Long texts are read in pieces that carry the last words over.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidra.llm.common import written

#: a-z, 0-9 and bytes of other letters stay, A-Z in lower case; all else is a blank.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bytes of text that are split at a time.
PIECE = 1 << 18


def word_pieces(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text, as lists of about ``PIECE`` bytes."""
    data = (text or b"").translate(TABLE)
    at = 0
    while at < len(data):
        to = data.find(b" ", at + PIECE) if at + PIECE < len(data) else -1
        to = len(data) if to < 0 else to
        yield data[at:to].split()
        at = to


def features(text: bytes | None) -> Iterator[tuple[int, np.ndarray]]:
    """For each piece of a text the number of its words, and the crc32 of each run of 1 to 3 consecutive words that ends in it, joined by one space."""
    crc32 = zlib.crc32
    one = two = None  # of the last word, and of the last two
    for words in word_pieces(text):
        out: list[int] = []
        add = out.append
        for w in words:
            h = crc32(w)
            add(h)
            if one is not None:
                spaced = b" " + w
                if two is not None:
                    add(crc32(spaced, two))
                two = crc32(spaced, one)
                add(two)
            one = h
        yield len(words), np.array(out, np.uint32)


def count_buckets(texts: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket's features occur in all texts: each task, and the driver, gets a row for each bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for text in b.column(0).cast(pa.binary()):
                for _, crc in features(text.as_py()):
                    counts.update((crc % np.uint32(buckets)).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.int32()), pa.array(list(counts.values()), pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets))))."""
    s_all, t_all = int(corpus.sum()) + len(corpus), int(target.sum()) + len(target)
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: object, seed: int) -> int:
    """floor(-1000 ln(-ln(u))) of a number u of (0, 1) from the digest of seed and id; a null id counts as the text ``null``."""
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = 10_000, seed: int = 42, rows_per_range: int = 100_000) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs`` (doc_id, text), drawn towards ``target`` (text).

    ``rank`` is 1, 2, ... for the floor(percent * N / 100) highest scores (ties: smaller doc_id, null last) of the N rows with at least ``least_words`` words, null for the others. Null and empty texts have no features and weight 0;
    repeated ids and rows are rows of their own, and of equal scores and ids any comes first. An empty target leaves only what smoothing says; an empty table gives no rows; other columns aren't read.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    table = spark.sparkContext.broadcast(gains(count_buckets(docs, buckets), count_buckets(target, buckets)))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, n, weight = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for i, text in enumerate(b.column("text").cast(pa.binary())):
                for k, crc in features(text.as_py()):
                    words[i] += k
                    n[i] += len(crc)
                    weight[i] += table.value[crc % np.uint32(buckets)].sum()
            score = weight + np.fromiter((noise(x, seed) for x in b.column("doc_id").to_pylist()), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words), pa.array(n), pa.array(weight), pa.array(score)], ["doc_id", "n_words", "n_features", "weight", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long, score long")
    scored = written(scored.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())), "scores")
    able = F.col("n_words") >= least_words
    n = scored.where(able).count()
    drawn, order = percent * n // 100, [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("salt")]
    ranges = written(scored.where(able).repartitionByRange(max(1, -(-n // rows_per_range)), *order).withColumn("part", F.spark_partition_id()), "ranges")
    bases, before = [], 0
    for r in sorted(ranges.groupBy("part").count().collect()):  # a row for each range
        bases.append((r["part"], before))
        before += r["count"]
    bases = spark.createDataFrame([b for b in bases if b[1] < drawn], "part int, base long")
    last = F.broadcast(bases)
    rank = F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    first = ranges.join(last, "part").withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = ranges.join(last, "part", "left_anti").unionByName(scored.where(~able), allowMissingColumns=True)
    columns = ["doc_id", "n_features", "weight", "score"]
    return first.select(*columns, "rank").unionByName(rest.select(*columns, F.lit(None).cast("long").alias("rank")))
