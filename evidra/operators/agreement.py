"""Agreement of raters on units, from counts: pairs of ratings are never listed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.operators.baselines import ranked
from evidra.operators.issues import issues, union
from evidra.sources.io import settled

def annotation_filter(rows: DataFrame, units: DataFrame, *, unit: str, rater: str, label: str, order: list[str], allowed: list[str]) -> DataFrame:
    """The rows with ``code``: the first check they fail (unknown_unit, label_not_allowed, duplicate_rating: not the first of its unit and rater), or null.

    Only rows that pass the earlier checks count as a first rating.
    """
    known = units.select(F.col(unit).alias("_u"), F.lit(True).alias("_known")).dropDuplicates(["_u"])
    first = F.when(F.col("_known").isNull(), "unknown_unit").when(~F.coalesce(F.col(label).isin(allowed), F.lit(False)), "label_not_allowed")
    rows = rows.join(known, F.col(unit) == F.col("_u"), "left").withColumn("_code", first)
    number = F.row_number().over(Window.partitionBy(unit, rater, F.col("_code").isNull()).orderBy(*order))
    rows = rows.withColumn("_n", number)
    return rows.withColumn("code", F.coalesce("_code", F.when(F.col("_n") > 1, "duplicate_rating"))).drop("_u", "_known", "_code", "_n")


def annotation_checks(rows: DataFrame, cases: DataFrame, schema_ok: Column, allowed: list[str], expected: dict[str, object], keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Issues of annotation records, and the rows that pass (their columns ``keep``, else all). ``rows``: file, line (rows of one file and line are one record), rater_id, annotation_id, case_id, label, session_id, case_sha256 and the columns of ``expected``; ``cases``: case_id, case_sha256, each case once.

    In order: mixed_or_missing_rater_file (the file's rows go), duplicate_rater_file (a rater's files after the first; rows stay), schema_invalid, duplicate_annotation_id and unknown_case (such rows go);
    missing_session_id, invalid_case_hash, invalid_<column> of ``expected`` (all that hold are named); invalid_label; duplicate_case_rater (a row that passes stands before it). What has gone doesn't count for later checks. First means by file, then line.
    A null in a checked column fails its check; an empty table has no issues. What a row's own columns say is settled before anything is shuffled, and hashes of cases are shuffled once: name ``keep``, or all columns go along.
    """
    keep = rows.columns if keep is None else keep
    at = F.struct("file", "line")
    whole = F.coalesce(F.length("rater_id") > 0, F.lit(False))
    files = rows.groupBy("file").agg((F.every(whole) & (F.min("rater_id") == F.max("rater_id"))).alias("one"), F.min("rater_id").alias("rater"))
    files = settled(files, "files")
    firsts = files.where("one").groupBy("rater").agg(F.min("file").alias("first"))
    again = files.where("one").join(firsts, "rater").where("file <> first")
    read = rows.join(files.where("one").select("file"), "file").withColumn("_ok", F.coalesce(schema_ok, F.lit(False)))
    ids = read.where("_ok").groupBy("annotation_id").agg(F.min(at).alias("_first"))
    fails = {"missing_session_id": F.length("session_id") > 0, **{f"invalid_{c}": F.col(c) == F.lit(v) for c, v in expected.items()}}
    named = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), code) for code, ok in fails.items())))
    label = F.coalesce(F.col("label").isin(allowed), F.lit(False))
    carried = list(dict.fromkeys(["file", "line", "case_id", "rater_id", *keep]))
    read = read.select(*carried, F.col("annotation_id").alias("_id"), F.col("case_sha256").alias("_claimed"), "_ok", named.alias("_bad"), label.alias("_label"))
    known = cases.select("case_id", F.col("case_sha256").alias("_sha"), F.lit(True).alias("_known"))
    same = F.coalesce(F.col("_claimed") == F.col("_sha"), F.lit(False))
    read = read.join(known, "case_id", "left").withColumn("_bad", F.when(same, F.col("_bad")).otherwise(F.array_append("_bad", F.lit("invalid_case_hash")))).drop("_claimed", "_sha")
    read = read.join(ids.withColumnRenamed("annotation_id", "_id"), "_id", "left")
    gone = F.when(~F.col("_ok"), "schema_invalid").when(F.coalesce(at > F.col("_first"), F.lit(False)), "duplicate_annotation_id").when(F.col("_known").isNull(), "unknown_case")
    passing = F.col("_gone").isNull() & F.col("_label") & (F.size("_bad") == 0)
    read = settled(read.withColumn("_gone", gone).withColumn("_passing", passing).select(*carried, "_gone", "_bad", "_label", "_passing"), "records")
    seen = read.where("_passing").groupBy("case_id", "rater_id").agg(F.min(at).alias("_seen"))
    rated = read.where(F.col("_gone").isNull() & F.col("_label")).select(*carried, "_passing").join(seen, ["case_id", "rater_id"], "left").withColumn("_twice", F.coalesce(at > F.col("_seen"), F.lit(False)))
    own = F.when(F.col("_gone").isNotNull(), F.array("_gone")).when(F.col("_label"), F.col("_bad")).otherwise(F.array_append("_bad", F.lit("invalid_label")))
    codes = read.select("file", "line", F.explode(own).alias("code"))
    twice = rated.where("_twice")
    found = [
        issues(files.where("not one"), "annotations", "mixed_or_missing_rater_file", "rater_id", F.col("file")),
        issues(again, "annotations", "duplicate_rater_file", "rater_id", F.col("file"), F.col("first")),
        issues(codes, "annotations", F.col("code"), "", F.col("file"), F.col("line")),
        issues(twice, "annotations", "duplicate_case_rater", "", F.col("file"), F.col("line")),
    ]
    return union(found), rated.where("_passing and not _twice").select(*keep)


def unit_counts(rows: DataFrame, unit: str, label: str) -> DataFrame:
    """Per unit: m ratings, matching and all pairs, and sum of squared label counts."""
    each = rows.where(F.col(label).isNotNull()).groupBy(unit, label).count()
    n = F.col("count")
    got = each.groupBy(unit).agg(F.sum(n).alias("m"), F.sum(n * n).alias("squares"), F.count("*").alias("labels"), F.max(label).alias("any_label"))
    return got.withColumns({"matches": ((F.col("squares") - F.col("m")) / 2).cast("long"), "pairs": (F.col("m") * (F.col("m") - 1) / 2).cast("long")})


def pairwise_agreement(counts: DataFrame) -> DataFrame:
    """One row: units, matches, pairs, agreement (null without pairs)."""
    return counts.where("m >= 2").agg(F.count("*").alias("units"), F.sum("matches").alias("matches"), F.sum("pairs").alias("pairs")).withColumn("agreement", F.col("matches") / F.expr("nullif(pairs, 0)"))


def _alpha(observed: Column, expected: Column, n: Column) -> Column:
    return F.when(n < 2, 1.0).when(expected == 0, F.when(observed == 0, 1.0).otherwise(0.0)).otherwise(1 - observed / expected)


def alpha_nominal(rows: DataFrame, unit: str, label: str) -> DataFrame:
    """One row: n (ratings in units of two or more), observed and expected disagreement, Krippendorff's alpha for nominal labels."""
    counts = unit_counts(rows, unit, label).where("m >= 2")
    seen = counts.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n"), F.sum((F.col("m") * F.col("m") - F.col("squares")) / (F.col("m") - 1)).alias("d"))
    each = rows.where(F.col(label).isNotNull()).join(counts.select(unit), unit, "left_semi").groupBy(label).count()
    chance = each.agg(F.sum(F.col("count") * F.col("count")).alias("s"))
    n = F.col("n")
    observed, expected = F.coalesce(F.col("d") / n, F.lit(0.0)), F.coalesce((n * n - F.col("s")) / (n * (n - 1)), F.lit(0.0))
    both = seen.crossJoin(F.broadcast(chance)).select("n", observed.alias("observed"), expected.alias("expected"))  # one row each
    return both.withColumn("alpha", _alpha(F.col("observed"), F.col("expected"), n))


def alpha_ordinal(rows: DataFrame, unit: str, label: str) -> DataFrame:
    """As :func:`alpha_nominal` with the ordinal distance (ratings between two categories, ends half) squared. Categories are numbers, about 100 at most; units with equal category counts are worked on as one."""
    per = rows.where(F.col(label).isNotNull()).groupBy(unit, F.col(label).alias("c")).count()
    units = per.groupBy(unit).agg(F.sum("count").alias("m"), F.sort_array(F.collect_list(F.struct("c", "count"))).alias("h")).where("m >= 2")  # a unit's own categories
    alike = settled(units.groupBy("m", "h").agg(F.count("*").alias("units")).withColumn("id", F.monotonically_increasing_id()), "alike")
    own = alike.select("id", "m", "units", F.explode("h").alias("e")).select("id", "m", "units", "e.*")
    histogram = own.groupBy("c").agg(F.sum(F.col("count") * F.col("units")).alias("count"))
    below = F.sum("count").over(Window.orderBy("c"))  # one row for each category
    places = histogram.select("c", F.col("count").alias("n"), (below - F.col("count") / 2).alias("at"))
    left, right = places.select(F.col("c").alias("l"), F.col("at").alias("l_at"), F.col("n").alias("l_n")), places.select(F.col("c").alias("r"), F.col("at").alias("r_at"), F.col("n").alias("r_n"))
    distance = F.pow(F.col("l_at") - F.col("r_at"), 2)
    pairs = own.select("id", "m", "units", F.col("c").alias("l"), F.col("count").alias("a")).join(own.select("id", F.col("c").alias("r"), F.col("count").alias("b")), "id").where("l < r")
    seen = pairs.join(F.broadcast(left), "l").join(F.broadcast(right), "r").agg(F.sum(2 * F.col("units") * F.col("a") * F.col("b") * distance / (F.col("m") - 1)).alias("d"))
    chance = left.crossJoin(F.broadcast(right)).where("l < r").agg(F.sum(2 * F.col("l_n") * F.col("r_n") * distance).alias("s"))
    n = F.col("n")
    total = histogram.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"))
    both = total.crossJoin(F.broadcast(seen)).crossJoin(F.broadcast(chance)).select("n", F.coalesce(F.col("d") / n, F.lit(0.0)).alias("observed"), F.coalesce(F.col("s") / (n * (n - 1)), F.lit(0.0)).alias("expected"))
    return both.withColumn("alpha", _alpha(F.col("observed"), F.col("expected"), n))


def consensus(rows: DataFrame, unit: str, label: str, abstain: str) -> DataFrame:
    """Per unit: raters' label if unanimous (else null), disagreement, unanimous_abstention, adjudicate (either)."""
    got = unit_counts(rows, unit, label)
    one = F.col("labels") == 1
    quiet = one & (F.col("any_label") == abstain)
    return got.select(unit, "m", F.when(one, F.col("any_label")).alias("label"), (~one).alias("disagreement"), quiet.alias("unanimous_abstention"), (~one | quiet).alias("adjudicate"))


def coverage(units: DataFrame, rows: DataFrame, unit: str, rater: str) -> DataFrame:
    """Distinct raters of each unit, 0 for units without."""
    got = rows.groupBy(unit).agg(F.count_distinct(rater).alias("raters"))
    return units.select(unit).distinct().join(got, unit, "left").select(unit, F.coalesce("raters", F.lit(0)).alias("raters"))


def abstention_rate(rows: DataFrame, label: str, abstain: str) -> DataFrame:
    return rows.agg(F.count("*").alias("n"), F.avg((F.col(label) == abstain).cast("int")).alias("abstention_rate"))


def mean_abs_diff(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Mean absolute difference over all pairs of ratings within a group, pooled: sorted, the i-th of m values counts 2i - m - 1 times."""
    w = Window.partitionBy(group)
    x = rows.where(F.col(value).isNotNull()).select(group, F.col(value).alias("x"), F.row_number().over(w.orderBy(value)).alias("i"), F.count("*").over(w).alias("m"))
    per = x.groupBy(group, "m").agg(F.sum((2 * F.col("i") - F.col("m") - 1) * F.col("x")).alias("d"))
    return per.agg(F.sum(F.col("m") * (F.col("m") - 1) / 2).cast("long").alias("pairs"), F.sum("d").alias("d")).select("pairs", (F.col("d") / F.expr("nullif(pairs, 0)")).alias("mean_abs_diff"))


def bootstrap_agreement(rows: DataFrame, unit: str, label: str, replicates: int, seed: int, most: int = 1_000_000) -> DataFrame:
    """measure (agreement, alpha), low, high: percentile intervals (2.5, 97.5, linear) of pairwise agreement and nominal alpha over units resampled with replacement.

    Units with equal label counts are one group, at most ``most`` of them, whatever the number of units. A replicate draws the groups' numbers from the multinomial distribution that resampling the units one by one
    has, seeded by its number; replicates are spread over the tasks. Units of one rating are left out; without units there is no row.
    """
    spark = rows.sparkSession
    each = rows.where(F.col(label).isNotNull()).groupBy(unit, F.col(label).cast("string").alias("label")).count()
    units = each.groupBy(unit).agg(F.sum("count").alias("m"), F.sort_array(F.collect_list(F.struct("label", "count"))).alias("h")).where("m >= 2")  # a unit's own labels
    groups = units.groupBy("h").agg(F.count("*").alias("n")).orderBy("h").limit(most + 1).collect()
    if len(groups) > most:
        raise ValueError(f"more than {most} kinds of units")
    labels = sorted({x["label"] for g in groups for x in g["h"]})
    place = {x: i for i, x in enumerate(labels)}
    hist = np.zeros((len(groups), len(labels)))
    for i, g in enumerate(groups):
        for x in g["h"]:
            hist[i, place[x["label"]]] = x["count"]
    n = np.array([g["n"] for g in groups], np.int64)
    sent = spark.sparkContext.broadcast((hist, n))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hist, n = sent.value
        m, square = hist.sum(1), (hist**2).sum(1)
        for b in batches:
            out = []
            for rep in b["id"]:
                k = np.random.default_rng([seed, int(rep)]).multinomial(n.sum(), n / n.sum())
                total, ratings = k @ hist, float(k @ m)
                observed = float(k @ ((m * m - square) / (m - 1))) / ratings
                expected = (ratings**2 - float(total @ total)) / (ratings * (ratings - 1))
                alpha = (1.0 if observed == 0 else 0.0) if expected == 0 else 1 - observed / expected
                out.append((float(k @ (square - m)) / float(k @ (m * m - m)), alpha))
            yield pd.DataFrame(out, columns=["agreement", "alpha"])

    reps = spark.range(replicates if len(groups) else 0).mapInPandas(draw, "agreement double, alpha double")
    long = reps.select(F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).alias("x")) for c in ("agreement", "alpha")))).alias("e")).select("e.*")
    return long.groupBy("measure").agg(F.percentile("x", 0.025).alias("low"), F.percentile("x", 0.975).alias("high"))


def freeze_decision(summary: DataFrame, agreement: float, alpha: float, abstention: float) -> DataFrame:
    """Adds ``freeze`` to one summary row: thresholds met, no disagreement, no unanimous abstention, full coverage."""
    ok = (F.col("agreement") >= agreement) & (F.col("alpha") >= alpha) & (F.col("abstention_rate") <= abstention)
    return summary.withColumn("freeze", F.coalesce(ok & (F.col("disagreements") == 0) & (F.col("unanimous_abstentions") == 0) & (F.col("uncovered") == 0), F.lit(False)))


def rater_order(raters: DataFrame, units: DataFrame, rater: str, unit: str, salt: str) -> DataFrame:
    """A stable order of the units for each rater, by sha256 of salt, rater and unit: ranks come from ranges of the digest, so no task sorts a rater's units alone."""
    own = settled(raters.select(rater).distinct(), "raters")
    both = units.select(unit).distinct().withColumn("_part", F.pmod(F.xxhash64(unit), F.lit(64))).repartition(64, "_part").drop("_part").crossJoin(F.broadcast(own))
    key = F.sha2(F.concat_ws(":", F.lit(salt), F.col(rater).cast("string"), F.col(unit).cast("string")), 256)
    return ranked(both, [rater], key, unit, name="position").select(rater, unit, F.col("position").cast("int").alias("position"))
