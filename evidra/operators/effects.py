"""Response surfaces, exact and bootstrap tests of domain means, and knowledge metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def logprob(logits: Column, at: Column) -> Column:
    """Logit of a position (from 1) less the log-sum-exp of all."""
    top = F.array_max(logits)
    return F.element_at(logits, at) - top - F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top)))


def others(scores: Column, at: Column) -> Column:
    return F.filter(scores, lambda x, i: i != at - 1)


def margin_mean(scores: Column, at: Column) -> Column:
    """The expected score less the mean of the others."""
    rest = others(scores, at)
    return F.element_at(scores, at) - F.aggregate(rest, F.lit(0.0), lambda a, x: a + x) / F.size(rest)


def margin_max(scores: Column, at: Column) -> Column:
    """The expected score less the largest of the others."""
    return F.element_at(scores, at) - F.array_max(others(scores, at))


def top_choice(scores: Column) -> Column:
    """Position of the largest score, the first on ties."""
    return F.array_position(scores, F.array_max(scores))


def unit_effects(df: DataFrame, unit: list[str], stratum: str, value: str, transfer: str, control: str) -> DataFrame:
    """Per unit: mean transfer and control values and their difference, for units that have both."""
    pick = lambda s: F.avg(F.when(F.col(stratum) == s, F.col(value)))
    got = df.groupBy(*unit).agg(pick(transfer).alias("transfer"), pick(control).alias("control")).where("transfer is not null and control is not null")
    return got.withColumn("delta", F.col("transfer") - F.col("control"))


def domain_means(effects: DataFrame, domain: str, value: str = "delta") -> DataFrame:
    return effects.groupBy(domain).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def _as_array(means: DataFrame, domain: str, most: int) -> DataFrame:
    """One row with the domain means in the order of the domains; at most ``most`` domains."""
    return means.agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(domain), F.col("mean")))), lambda s: s["mean"]).alias("m")).withColumn("m", F.when(F.size("m") <= most, F.col("m")).otherwise(F.raise_error(F.lit(f"more than {most} domains"))))


def sign_flip_exact(means: DataFrame, domain: str, tolerance: float = 1e-15) -> DataFrame:
    """Share of all sign vectors of the domain means (at most 16) whose absolute mean reaches the observed one."""
    row = _as_array(means, domain, 16)
    k = F.size("m")
    each = row.select("m", F.explode(F.sequence(F.lit(0), F.shiftleft(F.lit(1), 16) - 1)).alias("bits")).where(F.col("bits") < F.expr("shiftleft(1, size(m))"))
    flipped = F.aggregate(F.transform("m", lambda x, i: F.when(F.expr("bits").bitwiseAND(F.pow(F.lit(2), i).cast("int")) > 0, -x).otherwise(x)), F.lit(0.0), lambda a, x: a + x) / k
    seen = F.aggregate("m", F.lit(0.0), lambda a, x: a + x) / k
    return each.select(flipped.alias("f"), seen.alias("o"), k.alias("k")).agg(F.max("k").alias("domains"), F.max("o").alias("mean"), F.avg((F.abs("f") >= F.abs("o") - tolerance).cast("int")).alias("p"))


def domain_bootstrap(means: DataFrame, domain: str, replicates: int, seed: int) -> DataFrame:
    """Interval of the mean of domain means over domains drawn with replacement by a hash: sorted values at floor((n - 1) p)."""
    row = _as_array(means, domain, 1000)
    each = row.select("m", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("rep"))
    k = F.size("m")
    draw = F.transform(F.sequence(F.lit(1), k), lambda i: F.element_at("m", (F.pmod(F.xxhash64(F.lit(seed), F.col("rep"), i), k) + 1).cast("int")))
    got = each.select((F.aggregate(draw, F.lit(0.0), lambda a, x: a + x) / k).alias("v")).withColumns({"i": F.row_number().over(Window.orderBy("v")) - 1})
    at = lambda p: F.max(F.when(F.col("i") == int((replicates - 1) * p), F.col("v")))
    return got.agg(at(0.025).alias("low"), at(0.975).alias("high"))


def transfer_decision(means: DataFrame, domain: str, alpha: float, margin: float, least: int) -> DataFrame:
    """positive: p <= alpha, mean at least ``margin`` and every domain above 0; non_interpretable: fewer than ``least`` domains; else null_result."""
    test = sign_flip_exact(means, domain)
    both = test.crossJoin(F.broadcast(means.agg(F.min("mean").alias("least_mean"))))  # one row each
    ok = (F.col("p") <= alpha) & (F.col("mean") >= margin) & (F.col("least_mean") > 0)
    return both.withColumn("decision", F.when(F.col("domains") < least, "non_interpretable").when(ok, "positive").otherwise("null_result"))


def remap_scores(df: DataFrame, key: str, scores: str, mappings: DataFrame) -> DataFrame:
    """Scores under each label bijection: ``mappings`` (mapping, places: for each new label the old position, a bounded list)."""
    moved = F.transform("places", lambda p: F.element_at(scores, p.cast("int")))
    return df.crossJoin(F.broadcast(mappings)).select(key, "mapping", moved.alias("scores"))  # rows x mappings is the schedule


def adjust_prior(scores: Column, prior: Column) -> Column:
    """Scores less each label's log prior."""
    return F.zip_with(scores, prior, lambda x, p: x - p)


def label_entropy(df: DataFrame, group: str, label: str) -> DataFrame:
    """Per group: rows and the Shannon entropy (bits) of the labels."""
    n = df.groupBy(group, label).agg(F.count("*").alias("n")).withColumn("all", F.sum("n").over(Window.partitionBy(group)))
    p = F.col("n") / F.col("all")
    return n.groupBy(group).agg(F.sum("n").alias("n"), (-F.sum(p * F.log2(p)) + 0.0).alias("bits"))


def surface_invariance(df: DataFrame, record: str, condition: str, choice: str, original: str) -> DataFrame:
    """Per condition: share of records whose choice equals that under the original condition, and the records compared."""
    base = df.where(F.col(condition) == original).select(record, F.col(choice).alias("base"))
    got = df.where(F.col(condition) != original).join(base, record)
    return got.groupBy(condition).agg(F.count("*").alias("n"), F.avg(F.col(choice).eqNullSafe(F.col("base")).cast("int")).alias("agreement"))


def module_metrics(df: DataFrame, module: str, correct: Column, abstained: Column, unsupported: Column) -> DataFrame:
    """Per module: accuracy, precision among answered, abstention rate, its precision and recall for unsupported questions, and unsupported accepts; null on zero denominators."""
    n = lambda c: F.count_if(c)
    ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    return df.groupBy(module).agg(
        F.count("*").alias("n"), ratio(n(correct & ~abstained), F.count("*")).alias("accuracy"), ratio(n(correct & ~abstained), n(~abstained)).alias("precision"),
        ratio(n(abstained), F.count("*")).alias("abstention_rate"), ratio(n(abstained & unsupported), n(abstained)).alias("abstention_precision"),
        ratio(n(abstained & unsupported), n(unsupported)).alias("abstention_recall"), n(unsupported & ~abstained).alias("unsupported_accepts"),
    )


def condition_contrasts(df: DataFrame, unit: str, condition: str, value: str, left: str, right: str) -> DataFrame:
    """Units with both conditions: mean difference, stability mean(1 - |a - b| / (1 + |a| + |b|)), and win rate."""
    pick = lambda c: F.avg(F.when(F.col(condition) == c, F.col(value)))
    got = df.groupBy(unit).agg(pick(left).alias("a"), pick(right).alias("b")).where("a is not null and b is not null")
    a, b = F.col("a"), F.col("b")
    return got.agg(F.count("*").alias("units"), F.avg(a - b).alias("difference"), F.avg(1 - F.abs(a - b) / (1 + F.abs(a) + F.abs(b))).alias("stability"), F.avg((a > b).cast("int")).alias("win_rate"))


def accuracy_by(df: DataFrame, group: str, correct: Column) -> DataFrame:
    """Accuracy by group and overall (group null), as grouping sets."""
    flagged = df.select(group, correct.cast("int").alias("_ok"))
    return flagged.groupingSets([[F.col(group)], []], group).agg(F.count("*").alias("n"), F.avg("_ok").alias("accuracy"), F.grouping_id().alias("overall"))


def rotate_options(df: DataFrame, key: str, index: Column, value: str, offsets: list[int], n: int) -> DataFrame:
    """Four options for each row: its own value and those at fixed offsets (modulo n, the number of indexed rows), rotated by its index; ``answer`` is where its own stands, from 0."""
    rows = df.select(F.col(key), index.alias("i"), F.col(value).alias("v"))
    each = rows.select(key, "i", F.posexplode(F.array(*(F.lit(o) for o in [0, *offsets]))).alias("k", "o"))
    got = each.join(rows.select(F.col("i").alias("j"), "v"), F.pmod(F.col("i") + F.col("o"), F.lit(n)) == F.col("j"))
    size = len(offsets) + 1
    place = F.pmod(F.col("k") + F.col("i"), F.lit(size))
    return got.groupBy(key, "i").agg(F.transform(F.sort_array(F.collect_list(F.struct(place.alias("p"), "v"))), lambda s: s["v"]).alias("options")).select(key, "options", F.pmod(F.col("i"), F.lit(size)).alias("answer"))


def shard_plan(df: DataFrame, key: str, size: int) -> DataFrame:
    """Contiguous shards of ``size`` keys in order of the key, by ranks within ranges of keys and a prefix sum of the ranges' counts."""
    ranges = df.select(key, F.floor(F.col(key) / (64 * size)).alias("_r"))
    counts = ranges.groupBy("_r").agg(F.count("*").alias("_n"))
    base = counts.select("_r", (F.sum("_n").over(Window.orderBy("_r")) - F.col("_n")).alias("_b"))
    at = F.col("_b") + F.row_number().over(Window.partitionBy("_r").orderBy(key)) - 1
    return ranges.join(base, "_r").select(key, F.floor(at / size).alias("shard"))
