"""Prompts, token spans, and contracts on public rows, review packets, paired strata and runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.operators.issues import issues, union


def render_prompt(template: str, **fields: Column) -> Column:
    """The template with ``{name}`` replaced by each field (null: empty). Braces in values stay as they are."""
    parts, rest = [], template
    while "{" in rest:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        if name not in fields:
            raise ValueError(f"no field {name}")
        parts += [F.lit(before), F.coalesce(fields[name].cast("string"), F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def span_tokens(tokens: Column, start: Column, end: Column) -> Column:
    """Positions (from 0) of tokens (structs of begin, end, attended, special) that are attended, not special and overlap [start, end)."""
    at = F.transform(tokens, lambda t, i: F.when(t["attended"] & ~t["special"] & (t["begin"] < end) & (t["end"] > start), i))
    return F.filter(at, lambda i: i.isNotNull())


def last_token(tokens: Column) -> Column:
    """Position of the last attended token that isn't special; null if there is none."""
    return F.array_max(F.filter(F.transform(tokens, lambda t, i: F.when(t["attended"] & ~t["special"], i)), lambda i: i.isNotNull()))


def span_mean(df: DataFrame, record: str, position: str, vector: str, first: int, last: int) -> DataFrame:
    """Per record: the mean of its token vectors at positions first to last, as rows (i, mean)."""
    own = df.where(F.col(position).between(first, last)).select(record, F.posexplode(vector).alias("i", "x"))
    return own.groupBy(record, "i").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def answer_leak(df: DataFrame, key: str, candidates: str, mode: str, modes: list[str], words: list[str], number: int = 4) -> DataFrame:
    """Issues of public rows: columns named like an answer, rows without exactly ``number`` candidates, repeated ids, unknown modes. The schema is scanned on the driver, the rows once for each rule."""
    named = [c for c in df.columns if any(w in c.lower() for w in words)]
    fields = [issues(df.where(F.col(c).isNotNull()).limit(1), "answer_leak", "answer_field", c, F.lit(None)) for c in named]
    return union([
        *fields,
        issues(df.where(F.coalesce(F.size(candidates), F.lit(-1)) != number), "answer_leak", "candidate_count", candidates, F.col(key), detail=F.size(candidates)),
        issues(df.groupBy(key).count().where("count > 1"), "answer_leak", "repeated_id", key, F.col(key), detail=F.col("count")),
        issues(df.where(~F.coalesce(F.col(mode).isin(modes), F.lit(False))), "answer_leak", "unknown_mode", mode, F.col(key), detail=F.col(mode)),
    ])


def review_packets(questions: DataFrame, reviews: DataFrame, question: str, reviewer: str, reviewers: list[str]) -> DataFrame:
    """Issues: a reviewer without a review of a question, with several, or who isn't one of the reviewers; and fewer than three distinct reviewers in all."""
    who = F.col(reviewer).cast("string")
    seen = reviews.groupBy(question).agg(F.collect_set(F.when(who.isin(reviewers), who)).alias("seen"))  # at most the reviewers
    lacking = questions.select(question).distinct().join(seen, question, "left")
    lacking = lacking.select(question, F.explode(F.array_except(F.array(*map(F.lit, reviewers)), F.coalesce("seen", F.array().cast("array<string>")))).alias("who"))
    few = reviews.agg(F.count_distinct(F.when(who.isin(reviewers), who)).alias("n")).where("n < 3")
    return union([
        issues(lacking, "review_packets", "missing_review", reviewer, F.col(question), F.col("who")),
        issues(reviews.groupBy(question, reviewer).count().where("count > 1"), "review_packets", "repeated_review", reviewer, F.col(question), F.col(reviewer), F.col("count")),
        issues(reviews.where(~F.coalesce(who.isin(reviewers), F.lit(False))).select(reviewer).distinct(), "review_packets", "unknown_reviewer", reviewer, F.col(reviewer)),
        issues(few, "review_packets", "few_reviewers", reviewer, F.lit(None), detail=F.col("n")),
    ])


def stratum_pairing(df: DataFrame, item: str, blinded: str, exposed: str, pooled: str, text: str, kind: str, kinds: list[str]) -> DataFrame:
    """Issues: a blinded item (by its id's prefix) without its exposed counterpart or the other way round, an item that isn't pooled, transcriptions of one item that differ, required kinds that no item has."""
    side = lambda prefix: df.where(F.col(item).startswith(prefix)).select(F.col(item).substr(F.lit(len(prefix) + 1), F.length(item)).alias("bare")).distinct()
    texts = df.groupBy(item).agg(F.count_distinct(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256)).alias("n")).where("n > 1")
    held = df.agg(F.collect_set(F.when(F.col(kind).isin(kinds), F.col(kind))).alias("k"))  # at most the required kinds
    absent = held.select(F.explode(F.array_except(F.array(*map(F.lit, kinds)), "k")).alias("k"))
    return union([
        issues(side(blinded).join(side(exposed), "bare", "left_anti"), "stratum_pairing", "no_exposed_item", item, F.col("bare")),
        issues(side(exposed).join(side(blinded), "bare", "left_anti"), "stratum_pairing", "no_blinded_item", item, F.col("bare")),
        issues(df.where(~F.coalesce(F.col(pooled), F.lit(False))), "stratum_pairing", "not_pooled", pooled, F.col(item)),
        issues(texts, "stratum_pairing", "transcriptions_differ", text, F.col(item), detail=F.col("n")),
        issues(absent, "stratum_pairing", "missing_kind", kind, F.col("k")),
    ])


def run_comparison(runs: dict[str, DataFrame], ceiling: Column) -> DataFrame:
    """Result rows of independent runs side by side, never pooled, and if each keeps within the ceiling."""
    parts = [df.withColumn("run", F.lit(name)) for name, df in runs.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("within_ceiling", F.coalesce(ceiling, F.lit(False)))


def injected_scores(df: DataFrame, key: str, columns: list[str], scorer: Callable[[pd.DataFrame], np.ndarray]) -> DataFrame:
    """key, score (null if it isn't finite), code (``not_finite`` or null): the caller's scorer over batches of the public columns. A scorer that gives another number of scores than rows fails the job."""
    kind = df.schema[key].dataType.simpleString()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = np.asarray(scorer(b[columns]), float)
            if got.shape != (len(b),):
                raise ValueError("one score for each row is wanted")
            ok = np.isfinite(got)
            yield pd.DataFrame({key: b[key], "score": [float(x) if k else None for x, k in zip(got, ok, strict=True)], "code": [None if k else "not_finite" for k in ok]})

    return df.select(key, *[c for c in columns if c != key]).mapInPandas(score, f"{key} {kind}, score double, code string")
