"""Controls and schedules around the main analyses: review coverage, fixtures, swaps within families, direction controls, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidra.operators.issues import union


def target_field_scan(df: DataFrame, words: list[str]) -> DataFrame:
    """Columns whose names hold one of the words, with how many rows have a value: the schema is scanned on the driver, the rows once."""
    names = [c for c in df.columns if any(w in c.lower() for w in words)]
    counts = df.agg(*(F.count(c).alias(c) for c in names))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("n")) for c in names))).alias("e")).select("e.*")


def review_coverage(pairs: DataFrame, reviews: DataFrame, a: str, b: str, accepted: Column) -> DataFrame:
    """Pairs without an accepted review in either direction, as (least, greatest)."""
    key = [F.least(a, b).alias("x"), F.greatest(a, b).alias("y")]
    return pairs.select(*key).distinct().join(reviews.where(accepted).select(*key).distinct(), ["x", "y"], "left_anti")


def fixture_contract(df: DataFrame, domain: str, family: str, author: str, families: int, replicates: int, authors: int) -> DataFrame:
    """Per domain: families, the least replicates of one, authors, and if all reach their minimum."""
    per = df.groupBy(domain, family).agg(F.count("*").alias("k"))
    got = per.groupBy(domain).agg(F.count("*").alias("families"), F.min("k").alias("replicates")).join(df.groupBy(domain).agg(F.count_distinct(author).alias("authors")), domain)
    return got.withColumn("ok", (F.col("families") >= families) & (F.col("replicates") >= replicates) & (F.col("authors") >= authors))


def cross_domain_max(similar: DataFrame, cases: DataFrame, key: str, domain: str) -> DataFrame:
    """Of similar pairs (a, b, jaccard) the best of each case with one of another domain; ties go to the smallest partner."""
    sides = union([similar.select(F.col("a").alias(key), F.col("b").alias("other"), "jaccard"), similar.select(F.col("b").alias(key), F.col("a").alias("other"), "jaccard")])
    own, far = cases.select(key, F.col(domain).alias("_d")), cases.select(F.col(key).alias("other"), F.col(domain).alias("_e"))
    got = sides.join(own, key).join(far, "other").where("_d <> _e")
    return got.groupBy(key).agg(F.max("jaccard").alias("jaccard"), F.min_by("other", F.struct(-F.col("jaccard"), F.col("other"))).alias("other"))


def binary_metrics(df: DataFrame, combo: str, positive: Column, score: str) -> DataFrame:
    """Per combination: accuracy and macro F1 of "score >= 0 is positive", F1 as 2 tp / (2 tp + fp + fn)."""
    said, n = F.col(score) >= 0, F.count_if
    got = df.groupBy(combo).agg(n(positive & said).alias("tp"), n(~positive & said).alias("fp"), n(positive & ~said).alias("fn"), n(~positive & ~said).alias("tn"))
    f1 = lambda t: F.coalesce(F.try_divide(2.0 * F.col(t), (2 * F.col(t) + F.col("fp") + F.col("fn")).cast("double")), F.lit(0.0))
    return got.select(combo, ((F.col("tp") + F.col("tn")) / (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))).alias("accuracy"), ((f1("tp") + f1("tn")) / 2).alias("macro_f1"))


def direction_cosine(left: DataFrame, right: DataFrame, group: str) -> DataFrame:
    """Per group the cosine of two directions given as rows (i, difference)."""
    both = left.select(group, "i", F.col("difference").alias("l")).join(right.select(group, "i", F.col("difference").alias("r")), [group, "i"])
    return both.groupBy(group).agg((F.sum(F.col("l") * F.col("r")) / F.sqrt(F.sum(F.col("l") * F.col("l")) * F.sum(F.col("r") * F.col("r")))).alias("cosine"))


def schedule(df: DataFrame, key: str, conditions: list[tuple[str, int]]) -> DataFrame:
    """Each record under each (condition, mapping) of a fixed list."""
    return df.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("condition"), F.lit(m).alias("mapping")) for c, m in conditions))).alias("e")).select(key, "e.*")
