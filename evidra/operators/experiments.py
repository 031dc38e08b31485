"""Blinded paired experiments: assignment, integrity, arm scores and paired differences. Draws are digests of ids, so they don't depend on row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.operators.issues import issues, union

_ROWS = 1_000_000


def assign_arms(cases: DataFrame, case: str, arms: list[str], seed: str) -> DataFrame:
    """``packet`` (12 hex digits), case, blind label (A, B, ...) and arm: arms in the order of sha256(seed:case:arm)."""
    each = cases.select(case).distinct().withColumn("arm", F.explode(F.array(*(F.lit(a) for a in arms))))
    id_ = F.col(case).cast("string")
    key = F.sha2(F.concat_ws(":", F.lit(seed), id_, "arm"), 256)
    place = F.row_number().over(Window.partitionBy(case).orderBy(key))
    return each.select(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), id_), 256), 1, 12).alias("packet"), case, F.chr(place.cast("long") + 64).alias("blind"), "arm")


def counterbalance(families: DataFrame, family: str, seed: str) -> DataFrame:
    """Parity of the first eight hex digits of sha256(seed:family): 1 swaps the two variants."""
    digits = F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col(family).cast("string")), 256), 1, 8)
    return families.select(family).distinct().withColumn("swapped", F.conv(digits, 16, 10).cast("long") % 2)


def split_assign(df: DataFrame, domain: str, family: str, k: int) -> DataFrame:
    """The first k families of each domain are for calibration, the rest sealed."""
    rank = F.row_number().over(Window.partitionBy(domain).orderBy(family))
    return df.select(domain, family).distinct().withColumn("split", F.when(rank <= k, "calibration").otherwise("sealed"))


def experiment_integrity(packets: DataFrame, responses: DataFrame, ratings: DataFrame, least_raters: int, top_score: int) -> DataFrame:
    """Issues of packets (packet, blind), responses (response, packet, blind) and ratings (response, rater, score): all are listed.

    Rows are dealt by key to as many partitions as they need (``_ROWS`` each) before they are counted or joined, so no task's tables grow with the input.
    """
    parts = sum(df.count() for df in (packets, responses, ratings)) // _ROWS + 1
    slot = ["packet", "blind"]
    asked = packets.select(*slot, F.lit(True).alias("asked"), F.lit(0).alias("n"))
    given = responses.select(*slot, F.lit(False).alias("asked"), F.lit(1).alias("n"))
    both = asked.unionByName(given).repartition(parts, *slot).groupBy(*slot).agg(F.bool_or("asked").alias("asked"), F.sum("n").alias("n"))
    alone = F.col("packet").isNull() | F.col("blind").isNull()  # a null meets nothing
    codes = {"missing_response": F.col("asked") & ((F.col("n") == 0) | alone), "unknown_packet": (F.col("n") > 0) & (~F.col("asked") | alone), "repeated_response": F.col("n") > 1}
    each = F.array_compact(F.array(*(F.when(bad, F.struct(F.lit(code).alias("code"), F.when(F.lit(code == "repeated_response"), F.col("n")).alias("detail"))) for code, bad in codes.items())))
    places = both.select(F.concat_ws("/", *slot).alias("place"), F.explode(each).alias("e"))
    known = responses.select("response").repartition(parts, "response").groupBy("response").agg(F.count("*").alias("n"))
    raters = ratings.select("response", "rater").repartition(parts, "response", "rater").distinct().repartition(parts, "response").groupBy("response").agg(F.count("rater").alias("raters"))
    return union([
        issues(places, "experiment", F.col("e.code"), "packet", F.col("place"), detail=F.col("e.detail")),
        issues(known.where("n > 1"), "experiment", "duplicate_response", "response", F.col("response")),
        issues(known.join(raters, "response", "left").where(F.coalesce("raters", F.lit(0)) < least_raters), "experiment", "too_few_raters", "response", F.col("response")),
        issues(ratings.select("response", "rater").repartition(parts, "response").join(known, "response", "left_anti"), "experiment", "unknown_response", "response", F.col("response"), F.col("rater")),
        issues(ratings.where(~F.coalesce(F.col("score").between(0, top_score), F.lit(False))), "experiment", "score_range", "score", F.col("response"), F.col("rater")),
    ])


def score_arms(df: DataFrame, arm: str, response: str, dim: str, score: str) -> DataFrame:
    """Mean over raters of a response, then over an arm's responses: a mean of means for each dimension."""
    per = df.groupBy(arm, response, dim).agg(F.avg(score).alias("m"))
    return per.groupBy(arm, dim).agg(F.avg("m").alias("mean"), F.count("*").alias("responses"))


def paired_deltas(df: DataFrame, pair: str, arm: str, dim: str, score: str, minimize: list[str]) -> DataFrame:
    """Per pair and dimension, for each two arms in order: right mean less left mean, with the sign turned for dimensions to be minimized."""
    per = df.groupBy(pair, dim, arm).agg(F.avg(score).alias("m"))
    left, right = per.select(pair, dim, F.col(arm).alias("left"), F.col("m").alias("l")), per.select(pair, dim, F.col(arm).alias("right"), F.col("m").alias("r"))
    sign = F.when(F.col(dim).isin(minimize), -1).otherwise(1)
    return left.join(right, [pair, dim]).where("left < right").select(pair, dim, "left", "right", (F.col("r") - F.col("l")).alias("delta"), ((F.col("r") - F.col("l")) * sign + 0.0).alias("gain"))


def rater_summary(ratings: DataFrame, response: str, rater: str, least: int) -> DataFrame:
    """One row: responses, those with the least number of raters, distinct raters, ratings."""
    per = ratings.groupBy(response).agg(F.count_distinct(rater).alias("k"))
    return per.agg(F.count("*").alias("responses"), F.count_if(F.col("k") >= least).alias("enough")).crossJoin(F.broadcast(ratings.agg(F.count_distinct(rater).alias("raters"), F.count("*").alias("ratings"))))  # one row each


def blind_export(assigned: DataFrame, case: str, texts: DataFrame, text: Column) -> DataFrame:
    """What an evaluator sees: packet, blind label and text, without the arm."""
    return assigned.join(texts.select(case, text.alias("shown")), case).select("packet", "blind", "shown")
