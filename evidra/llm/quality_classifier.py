"""Quality classifier by compression.

Two zstandard dictionaries are built from labelled good and bad texts. A text is compressed with each; the difference of the two sizes
over the larger one, with the text's compressed size for each byte and its length, is turned into a probability by a logistic calibration that
is fitted on labelled texts which the dictionaries haven't seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import crc_mod
from evidra.llm.words import slices

LEVEL = 3


@dataclass(frozen=True)
class Model:
    good: tuple[bytes, bool]  # dictionary, and if it is trained or raw content
    bad: tuple[bytes, bool]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


def _dictionary(texts: list[bytes], size: int) -> tuple[bytes, bool]:
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, texts)) // 8)), texts).as_bytes(), True
    except zstandard.ZstdError:  # too few texts: their bytes are the dictionary
        return b"\n".join(texts)[:size], False


def _compressor(dictionary: tuple[bytes, bool]) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary[0], dict_type=zstandard.DICT_TYPE_FULLDICT if dictionary[1] else zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False)


def features(texts: list[bytes], good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> np.ndarray:
    """Normalised size difference, compressed size for each byte, log length, with squares and products."""
    rows = np.array([(len(t) + 1, len(good.compress(t)), len(bad.compress(t))) for t in texts], float).reshape(-1, 3)
    n, a, b = rows.T
    d, s, m = (b - a) / np.maximum(a, b), a / n, np.log(n)
    return np.stack([np.ones(len(n)), d, s, m, d * d, s * s, m * m, d * s, d * m, s * m], 1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Newton's method; a step that doesn't lower the loss is halved."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(weight @ (np.logaddexp(0, z) - y * z) + ridge / 2 * w @ w)

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (y - p)) - ridge * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        before, now = now, loss(w)
        if before - now < 1e-9 * max(1.0, before):
            break
    return w


def fit_classifier(docs: DataFrame, labels: DataFrame, held_out: int | None = 2, most_texts: int = 2400, most_chars: int = 20_000, size: int = 65_536) -> Model | float:
    """A model from at most ``most_texts`` labelled texts of each class, in the order of a hash of their ids, none longer than ``most_chars``.

    Rows whose crc32(doc_id as text) mod 4 is ``held_out`` are left out, and so are ids with null or contradicting labels. With fewer than
    four texts of a class the result is the share of good labels, as a constant score.
    """
    known = labels.where("doc_id is not null and quality is not null")
    if held_out is not None:
        known = known.where(crc_mod(F.col("doc_id"), 4) != held_out)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("good"), F.max("quality").alias("top")).where("good = top and good in (0, 1)").select("doc_id", "good")
    share = known.agg(F.avg("good")).first()[0]
    order = F.xxhash64("doc_id", F.lit(5))
    some = [known.where(F.col("good") == g).orderBy(order, "doc_id").limit(most_texts) for g in (0, 1)]
    picked = docs.where(F.col("text").isNotNull() & (F.length("text") <= most_chars)).select("doc_id", "text").join(F.broadcast(some[0].unionAll(some[1])), "doc_id")  # at most 2 * most_texts ids
    rows = picked.groupBy("doc_id", "good").agg(F.min("text").alias("text")).orderBy(order, "doc_id").toPandas()
    texts = {g: [t.encode() for t in rows.loc[rows["good"] == g, "text"]] for g in (0, 1)}
    if min(map(len, texts.values())) < 4:
        return 0.5 if share is None else float(share)
    good, bad = (_dictionary(texts[g][::2], size) for g in (1, 0))
    rest = texts[1][1::2] + texts[0][1::2]
    y = np.array([1.0] * len(texts[1][1::2]) + [0.0] * len(texts[0][1::2]))
    x = features(rest, _compressor(good), _compressor(bad))
    mean, scale = x.mean(0), x.std(0) + 1e-9
    mean[0], scale[0] = 0, 1
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return Model(good, bad, mean, scale, _logistic((x - mean) / scale, y, weight))


def score_texts(model: Model | float, texts: list[bytes], tools: list) -> np.ndarray:
    if isinstance(model, float):
        return np.full(len(texts), model)
    if not tools:
        tools += [_compressor(model.good), _compressor(model.bad)]
    x = (features(texts, *tools) - model.mean) / model.scale
    return 1 / (1 + np.exp(-np.clip(x @ model.weights, -500, 500)))


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode() for t in batch.column("text").to_pylist()]


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **fit) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1, higher: good likelier), predicted (1 from ``threshold`` on).

    Null text counts as empty and gets the score of empty text; repeated rows are scored each; an empty table gives no rows;
    labels, languages, sources and ids are no inputs of a score. Other columns aren't read.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_classifier(docs, labels, **fit))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools: list = []
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score_texts(model.value, _texts(b), tools), pa.float64())], ["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_classified(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **fit) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit_classifier(docs, labels, **fit))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools: list = []
        for b in slices(batches):
            yield b.filter(pa.array(score_texts(model.value, _texts(b), tools) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
