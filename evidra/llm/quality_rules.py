"""Quality rules with risk-controlled thresholds.

A fixed base (too few words, too much repetition) fails a text outright. Besides, each rule rejects texts whose statistic lies above
a cutoff of the text's stratum. Labelled texts are split in two: on one part the cutoff is chosen, on the held-out part the number of
good texts that it rejects gives an exact binomial p-value of "it rejects more than ``risk / rules`` of the good texts".
Holm's correction over all strata and rules decides which cutoffs hold, so with probability ``1 - error`` no stratum
loses more than ``risk`` of its good texts. A rule without such evidence rejects nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm.common import crc_mod, written
from evidra.llm.words import mix, slices, windows, words_of

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters")
#: Each rule's statistic lies in [0, 1] and is compared in steps of 1 / STEPS.
RULES = ("symbols", "capitals", "duplicate_lines", "repetition")
STEPS = 200
_SYMBOL, _UPPER, _LETTER = (np.isin(np.arange(256), list(x)) for x in (b"#*$%&|<>", bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])))
_BASE_WORDS, _BASE_REPEAT, _WINDOW = 10, 20, 5


def _line_counts(text: bytes) -> tuple[int, int]:
    lines = [x for x in text.split(b"\n") if x.split()]
    return len(lines), len(lines) - len(set(lines))


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text, as int64 arrays."""
    w = words_of(column)
    first = w.first
    out = {"n_words": np.diff(first)}
    head = (w.data & 0xC0) != 0x80
    inside = np.zeros(len(w.data) + 1, np.int8)
    np.add.at(inside, w.starts, 1)
    np.add.at(inside, w.ends, -1)
    out["word_chars"] = w.per_doc(head & (np.cumsum(inside[:-1]) > 0))
    for name, table in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_letters", _LETTER)):
        out[name] = w.per_doc(table[w.data])
    g, at = windows(w.hashes(), w.doc, _WINDOW)
    _, back, n = np.unique(mix(g + w.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
    twice = np.zeros(len(w.starts) + _WINDOW, bool)
    for k in range(_WINDOW):
        twice[at[n[back] > 1] + k] = True
    covered = np.concatenate(([0], np.cumsum(twice[: len(w.starts)])))
    out["n_repeat_words"] = covered[first[1:]] - covered[first[:-1]]
    raw = w.data.tobytes()
    lines = np.array([_line_counts(raw[a:b]) for a, b in zip(w.offsets[:-1], w.offsets[1:], strict=True)], np.int64).reshape(-1, 2)
    out["n_lines"], out["n_dup_lines"] = lines[:, 0], lines[:, 1]
    return out


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < _BASE_WORDS) | (100 * c["n_repeat_words"] > _BASE_REPEAT * c["n_words"])


def rule_steps(c: dict[str, np.ndarray]) -> np.ndarray:
    """For each text and rule the statistic in steps, rounded down."""
    share = lambda a, b: np.minimum(STEPS, STEPS * c[a] // np.maximum(1, c[b]))
    return np.stack([share("n_symbols", "word_chars"), share("n_upper", "n_letters"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")], 1)


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) of a binomial: exact, by logarithms of its terms."""
    if k >= n:
        return 1.0
    term = n * math.log1p(-p)
    total = math.exp(term)
    for i in range(k):
        term += math.log((n - i) / (i + 1)) + math.log(p / (1 - p))
        total += math.exp(term)
    return min(1.0, total)


def choose_cutoffs(histogram: dict, risk: float, error: float, cost: float = 20.0) -> dict:
    """Cutoffs that hold, by (stratum, rule). ``histogram``: (stratum, rule, held_out, good) -> texts by step.

    Chosen on the fitting part: the loosest cutoff with the most bad texts rejected less ``cost`` for each share of good ones.
    """
    tests = []
    for stratum, rule in sorted({(s, r) for s, r, _, _ in histogram}, key=str):
        part = {(h, g): histogram.get((stratum, rule, h, g), np.zeros(STEPS + 1)) for h in (0, 1) for g in (0, 1)}
        above = {k: v.sum() - np.cumsum(v) for k, v in part.items()}  # rejected by the cutoff at each step
        gain = above[0, 0] / max(1, part[0, 0].sum()) - cost * above[0, 1] / max(1, part[0, 1].sum())
        at = int(STEPS - np.argmax(gain[::-1]))
        n = int(part[1, 1].sum())
        if gain[at] > 0 and n:
            tests.append((binomial_tail(int(above[1, 1][at]), n, risk / len(RULES)), stratum, rule, at))
    held, m = {}, len(tests)
    for i, (p, stratum, rule, at) in enumerate(sorted(tests, key=lambda t: (t[0], str(t[1:])))):
        if p * (m - i) > error:
            break
        held[stratum, rule] = at
    return held


def _stratum(lang) -> str:
    return "?" if lang is None else lang


def fit_rules(counted: DataFrame, labels: DataFrame, risk: float = 0.03, error: float = 0.05) -> dict:
    """Cutoffs from the labelled rows of ``counted`` (doc_id, lang, base_failed, steps); ids with contradicting or null labels don't count.

    Labelled texts are counted by stratum, rule and step on the executors: what reaches the driver doesn't grow with them.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("good"), F.max("quality").alias("top")).where("good = top and good in (0, 1)").select("doc_id", "good")
    held = (crc_mod(F.col("doc_id"), 4) != 1).cast("int")
    rows = counted.where("not base_failed").join(known, "doc_id").select("lang", held.alias("held"), "good", F.posexplode("steps").alias("rule", "step"))
    histogram: dict = {}
    for r in rows.groupBy("lang", "held", "good", "rule", "step").count().collect():
        histogram.setdefault((_stratum(r["lang"]), r["rule"], r["held"], r["good"]), np.zeros(STEPS + 1))[r["step"]] += r["count"]
    return choose_cutoffs(histogram, risk, error)


def _rejecting(lang: list, steps: np.ndarray, cutoffs: dict) -> list[str | None]:
    """The first rule that rejects each text."""
    return [next((name for r, name in enumerate(RULES) if s[r] > cutoffs.get((_stratum(g), r), STEPS)), None) for g, s in zip(lang, steps.tolist(), strict=True)]


def count_texts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the counts, base_failed, steps of each document, as a written table of narrow rows."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            c = text_counts(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), *(pa.array(c[k], pa.int64()) for k in COUNTS), pa.array(base_failed(c)), pa.array(rule_steps(c).tolist(), pa.list_(pa.int32()))], ["doc_id", "lang", *COUNTS, "base_failed", "steps"])

    return written(docs.select("doc_id", "lang", "text").mapInArrow(count, f"doc_id {kind}, lang string, {', '.join(f'{k} long' for k in COUNTS)}, base_failed boolean, steps array<int>"), "counts")


def judge_quality(docs: DataFrame, labels: DataFrame, risk: float = 0.03, error: float = 0.05) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by.

    Strata are languages (null is one of its own). Null and empty texts have no words and so fail the base; repeated rows are judged each;
    an empty table gives no rows; without labels only the base fails texts. Other columns aren't read.
    """
    counted = count_texts(docs)
    cutoffs = docs.sparkSession.sparkContext.broadcast(fit_rules(counted, labels, risk, error))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *COUNTS[:5], "base_failed"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            steps = np.array(b.column("steps").to_pylist(), np.int64).reshape(-1, len(RULES))
            by = _rejecting(b.column("lang").to_pylist(), steps, cutoffs.value)
            failed = b.column("base_failed").to_numpy(zero_copy_only=False)
            kept = ~failed & np.array([x is None for x in by], bool)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(kept), pa.array(by, pa.string())], [*names, "kept", "rejected_by"])

    return counted.mapInArrow(judge, f"doc_id {kind}, {', '.join(f'{k} long' for k in COUNTS[:5])}, base_failed boolean, kept boolean, rejected_by string")


def keep_good(docs: DataFrame, labels: DataFrame, risk: float = 0.03, error: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that :func:`judge_quality` keeps, with all their columns; texts aren't shuffled."""
    cutoffs = docs.sparkSession.sparkContext.broadcast(fit_rules(count_texts(docs), labels, risk, error))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            c = text_counts(b.column("text"))
            by = _rejecting(b.column("lang").to_pylist(), rule_steps(c), cutoffs.value)
            yield b.filter(pa.array(~base_failed(c) & np.array([x is None for x in by], bool)))

    return docs.mapInArrow(keep, docs.schema)
