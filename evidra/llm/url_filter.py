"""URL filters by a cascade of Bloom filters.

Every page offers candidate keys: each suffix of its host at a label boundary, joined with each prefix of its path
that ends in ``/``. A cascade holds one list of keys: level 1 encodes the listed keys, level 2 those keys of the corpus
that level 1 takes for listed, level 3 the listed keys that level 2 takes for unlisted, and so on until a level errs on
no key. As all candidate keys of the corpus took part, membership is exact for each of them, and pages need no join:
the filters are broadcast, their size is bounded by ``max_bits`` and checked before they are built.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import lower_ascii, written
from evidra.llm.words import mix

BLOCK, ALLOW = "block", "allow"


@dataclass(frozen=True)
class Level:
    bits: int
    probes: int
    words: np.ndarray  # int64


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased) and path (then up to ``?``, ``#`` or the end)."""
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    return lower_ascii(F.regexp_extract(rest, "^([^/?#]*)", 1)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def candidates(host: Column, path: Column, labels: int, depth: int) -> Column:
    """Keys of at most ``labels`` host labels and ``depth`` path parts: what a list with such limits can match."""
    parts, segments = F.split(host, "\\."), F.split(path, "/")
    n = F.size(parts)
    hosts = F.transform(F.sequence(F.greatest(F.lit(1), n - labels + 1), n), lambda i: F.array_join(F.slice(parts, i, n), "."))
    m = F.least(F.size(segments) - 1, F.lit(depth))
    paths = F.when(m > 0, F.transform(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), lambda j: F.concat(F.array_join(F.slice(segments, 1, j), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))


def hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key), F.xxhash64(key, F.lit(17))]


def _position(h1: np.ndarray, h2: np.ndarray, i: int, level: int, bits: int) -> np.ndarray:
    """Place of probe i; each level mixes both hashes anew, so keys that meet in one part in the next."""
    a, b = mix(h1 + np.uint64(level) * np.uint64(0x9E3779B97F4A7C15)), mix(h2 ^ np.uint64(level)) | np.uint64(1)
    return (a + np.uint64(i) * b) % np.uint64(bits)


def contains(level: Level, number: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    found = np.ones(len(h1), bool)
    with np.errstate(over="ignore"):
        for i in range(level.probes):
            at = _position(h1, h2, i, number, level.bits)
            found &= (level.words[(at >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (at & np.uint64(63))) & np.uint64(1) == 1
    return found


def member(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Exact for keys of the universe: the first level that lacks a key decides, odd levels against it."""
    listed = np.zeros(len(h1), bool)
    live = np.arange(len(h1))
    for number, level in enumerate(levels, 1):
        hit = contains(level, number, h1[live], h2[live])
        listed[live[~hit]] = number % 2 == 0
        live = live[hit]
    listed[live] = len(levels) % 2 == 1
    return listed


def _insert(keys: DataFrame, number: int, bits: int, probes: int) -> np.ndarray:
    """Words of a filter that holds (h1, h2) of ``keys``: positions are grouped on the executors, one row for each non-zero word comes back."""

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h1, h2 = (b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
            with np.errstate(over="ignore"):
                at = np.unique(np.concatenate([_position(h1, h2, i, number, bits) for i in range(probes)]))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], ["word", "mask"])

    got = keys.select("h1", "h2").mapInArrow(positions, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    words = np.zeros((bits + 63) // 64, np.int64)
    words[got["word"].to_numpy(dtype=np.int64)] = got["mask"].to_numpy(dtype=np.int64)
    return words


def build_cascade(listed: DataFrame, universe: DataFrame, max_bits: int = 1 << 30, max_levels: int = 64) -> list[Level]:
    """Cascade for the keys (h1, h2) of ``listed`` against those of ``universe`` that aren't listed; neither comes to the driver.

    The first level's error rate is set so that about as many other keys pass it as are listed; the later ones err on half.
    """
    n_listed, n_other = listed.count(), universe.count()
    if not n_listed:
        return []
    levels: list[Level] = []
    positive, negative = listed, universe.join(listed, ["h1", "h2"], "left_anti")
    n, rate = n_listed, min(0.5, max(1e-6, n_listed / max(1, n_other) * 0.7))
    while n and len(levels) < max_levels:
        probes = max(1, round(-math.log2(rate)))
        bits = max(64, math.ceil(n * probes / math.log(2)))
        if bits > max_bits:
            raise ValueError(f"a level needs {bits} bits; max_bits is {max_bits}")
        number = len(levels) + 1
        level = Level(bits, probes, _insert(positive, number, bits, probes))
        levels.append(level)

        def passing(batches: Iterator[pa.RecordBatch], level: Level = level, number: int = number) -> Iterator[pa.RecordBatch]:
            for b in batches:
                h1, h2 = (b.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (0, 1))
                yield b.filter(pa.array(contains(level, number, h1, h2)))

        wrong = written(negative.select("h1", "h2").mapInArrow(passing, "h1 long, h2 long"), "cascade")
        positive, negative, n, rate = wrong, positive, wrong.count(), 0.5
    if n:
        raise ValueError("listed and other keys can't be told apart by their hashes")
    return levels


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", default: str = ALLOW, max_bits: int = 1 << 30) -> DataFrame:
    """Verdict on each url by the longest rule that fits: (key, ``block`` or ``allow``), key = host, then a path from ``/`` to ``/``.

    Returns id, host, path, rule (null where none fits), verdict (``default`` where none fits). A null url or one without
    ``://`` has an empty host and path, and so no rule. A key in both lists blocks; of two keys of one length the one with the
    longer host wins. Repeated rows are judged each; an empty table or list gives no rows or only defaults. Other columns
    of ``pages`` are not read.
    """
    for key, verdict in rules:
        if not key.endswith("/") or key.startswith("/") or verdict not in (BLOCK, ALLOW):
            raise ValueError(f"not a rule: {key!r}, {verdict!r}")
    spark = pages.sparkSession
    hosts = [k.split("/", 1)[0] for k, _ in rules]
    labels, depth = max([1, *(h.count(".") + 1 for h in hosts)]), max([1, *(k.count("/") for k, _ in rules)])
    host, path = url_parts(F.col(url_col))
    base = pages.select(F.col(id_col), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path")).withColumn("keys", candidates(F.col("host"), F.col("path"), labels, depth))
    key = F.col("key")
    universe = written(base.select(F.explode("keys").alias("key")).select(*(h.alias(f"h{i}") for i, h in enumerate(hashes(key), 1))).distinct(), "url-keys")
    cascades = {}
    for verdict in (BLOCK, ALLOW):
        own = [(k,) for k, v in rules if v == verdict]
        listed = spark.createDataFrame(own, "key string").select(*(h.alias(f"h{i}") for i, h in enumerate(hashes(key), 1))).distinct()
        cascades[verdict] = build_cascade(listed, universe, max_bits)
    sent = spark.sparkContext.broadcast(cascades)
    kind = pages.schema[id_col].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, h1, h2 = (b.column(c) for c in ("keys", "h1", "h2"))
            row = np.repeat(np.arange(b.num_rows), np.diff(keys.offsets.to_numpy()))
            flat = keys.flatten()
            h1, h2 = (x.flatten().to_numpy(zero_copy_only=False).view(np.uint64) for x in (h1, h2))
            rule, verdict = [None] * b.num_rows, [default] * b.num_rows
            hits = {v: member(sent.value[v], h1, h2) for v in (ALLOW, BLOCK)}
            best: dict[int, tuple] = {}
            for j in np.flatnonzero(hits[ALLOW] | hits[BLOCK]):
                k = flat[int(j)].as_py()
                best[row[j]] = max(best.get(row[j], ()), (len(k), k.index("/"), k, BLOCK if hits[BLOCK][j] else ALLOW))
            for i, (_, _, k, v) in best.items():
                rule[i], verdict[i] = k, v
            yield pa.RecordBatch.from_arrays([b.column(0), b.column("host"), b.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], [id_col, "host", "path", "rule", "verdict"])

    full = base.withColumns({"h1": F.transform("keys", lambda k: hashes(k)[0]), "h2": F.transform("keys", lambda k: hashes(k)[1])})
    return full.mapInArrow(judge, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
