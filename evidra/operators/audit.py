"""Corpus quality audits. Each returns issue rows (``issues.COLUMNS``) or a small table of counts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.operators.issues import issues, union


def canonical_cases(cases: DataFrame, labels: DataFrame, case: str, label: str) -> DataFrame:
    """Per case: its one distinct label in lower case, or null with ``issue`` invalid_labels (none) or non_canonical_labels (several)."""
    named = F.lower(F.trim(F.col(label).cast("string")))
    got = labels.where(named != "").groupBy(case).agg(F.count_distinct(named).alias("k"), F.min(named).alias("one"))
    n = F.coalesce(F.col("k"), F.lit(0))
    return cases.select(case).join(got, case, "left").select(case, F.when(n == 1, F.col("one")).alias("label"), F.when(n == 0, "invalid_labels").when(n > 1, "non_canonical_labels").alias("issue"))


def duplicate_keys(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows after the first of their key."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return issues(df.withColumn("_n", n).where("_n > 1"), "duplicate_keys", "duplicate_id", key, F.col(key), detail=F.col("_n"))


def reference_integrity(edges: DataFrame, targets: DataFrame, src: str, dst: str, key: str, symmetric: bool = False) -> DataFrame:
    """Self references, repeated references, references to missing targets (each once), and with ``symmetric`` edges without their reverse."""
    a, b = F.col(src), F.col(dst)
    parts = [
        issues(edges.where(a == b), "reference_integrity", "self_reference", dst, a, b),
        issues(edges.groupBy(src, dst).count().where("count > 1"), "reference_integrity", "repeated_reference", dst, a, b, F.col("count")),
        issues(edges.select(src, dst).distinct().join(targets.select(F.col(key).alias(dst)), dst, "left_anti"), "reference_integrity", "missing_target", dst, a, b),
    ]
    if symmetric:
        back = edges.select(F.col(dst).alias(src), F.col(src).alias(dst))
        known = edges.select(src, dst).distinct().join(targets.select(F.col(key).alias(dst)), dst, "left_semi")
        parts.append(issues(known.join(back, [src, dst], "left_anti"), "reference_integrity", "asymmetric_reference", dst, a, b))
    return union(parts)


def exact_duplicates(df: DataFrame, key: str, split: str, signature: Column) -> DataFrame:
    """Groups of equal signatures, by digest: rows, splits, pairs within a split and across splits (counted, not listed)."""
    each = df.select(F.sha2(signature, 256).alias("signature"), F.col(split).alias("split"), F.col(key).alias("key")).where("signature is not null")
    by = each.groupBy("signature", "split").agg(F.count("*").alias("n"), F.min("key").alias("first"))
    n = F.col("n")
    got = by.groupBy("signature").agg(F.sum("n").alias("rows"), F.count("*").alias("splits"), F.sum(n * (n - 1) / 2).cast("long").alias("within_pairs"), F.sum(n * n).alias("squares"), F.min("first").alias("first_key")).where("rows > 1")
    return got.select("signature", "first_key", "rows", "splits", "within_pairs", ((F.col("rows") * F.col("rows") - F.col("squares")) / 2).cast("long").alias("cross_pairs"), F.when(F.col("splits") > 1, "cross_split_leakage").otherwise("duplicate_signature").alias("code"))


def forbidden_terms(df: DataFrame, key: str, text: str, terms: list[str], whole_words: bool) -> DataFrame:
    """One row for each text and term that it holds: as a substring, or between word boundaries (terms are literal, never patterns). The list of terms is part of the plan."""
    low = F.lower(F.col(text))
    literal = lambda t: re.sub(r"([^a-z0-9\s])", r"\\\1", t)
    hit = lambda t: low.rlike(f"(?<![a-z0-9]){literal(t)}(?![a-z0-9])") if whole_words else low.contains(t)
    found = F.array_compact(F.array(*(F.when(hit(t.lower()), F.lit(t.lower())) for t in terms)))
    return issues(df.select(key, F.explode(found).alias("term")), "forbidden_terms", "forbidden_term", text, F.col(key), detail=F.col("term"))


def target_gaps(df: DataFrame, split: str, plan: DataFrame) -> DataFrame:
    """Per planned split (split, least, exact): rows there, and the gap to the least or exact number; empty splits count 0."""
    got = df.groupBy(F.col(split).alias("split")).agg(F.count("*").alias("rows"))
    n = F.coalesce(F.col("rows"), F.lit(0))
    gap = F.greatest(F.coalesce(F.col("least") - n, F.lit(0)), F.coalesce(F.abs(F.col("exact") - n), F.lit(0)), F.lit(0))
    return plan.join(got, "split", "left").select("split", n.alias("rows"), "least", "exact", gap.alias("gap"))


def source_policy(df: DataFrame, source: str, allowed: list[str], generated: list[str], cap: float) -> DataFrame:
    """One row: rows with a source, rows of sources that aren't allowed, share of generated rows, and if it is within the cap."""
    s = F.col(source)
    got = df.agg(F.count(s).alias("sourced"), F.count_if(~s.isin(allowed)).alias("not_allowed"), F.count_if(s.isin(generated)).alias("generated"))
    share = F.col("generated") / F.expr("nullif(sourced, 0)")
    return got.withColumn("share", share).withColumn("ok", (F.col("not_allowed") == 0) & (F.coalesce("share", F.lit(0.0)) <= cap))


def fingerprint_leakage(df: DataFrame, split: str, fields: list[str]) -> DataFrame:
    """Fingerprints (sha256 of the fields) that stand in more than one split."""
    digest = F.sha2(F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields)), 256)
    return df.select(digest.alias("fingerprint"), split).groupBy("fingerprint").agg(F.count("*").alias("rows"), F.count_distinct(split).alias("splits")).where("splits > 1")


def distributions(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by each of the columns, as grouping sets of one aggregation."""
    sets = df.groupingSets([[F.col(c)] for c in columns], *columns).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    bit = lambda i: 1 << (len(columns) - 1 - i)
    full = (1 << len(columns)) - 1
    name = F.coalesce(*(F.when(F.col("g") == full - bit(i), F.lit(c)) for i, c in enumerate(columns)))
    value = F.coalesce(*(F.when(F.col("g") == full - bit(i), F.col(c).cast("string")) for i, c in enumerate(columns)))
    return sets.select(name.alias("field"), value.alias("value"), "n")


def cell_minima(df: DataFrame, rows: str, columns: str, least: int) -> DataFrame:
    """Counts of all cells of two fields, zeros included, and if each reaches the least number."""
    other = df.select(columns).distinct()
    grid = df.select(rows).distinct().crossJoin(F.broadcast(other) if other.limit(100_001).count() <= 100_000 else other)  # of two category lists: the cells asked for
    got = df.groupBy(rows, columns).agg(F.count("*").alias("n"))
    return grid.join(got, [rows, columns], "left").select(rows, columns, F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) >= least).alias("ok"))


def table_digest(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """An order-free digest of the rows (per group): row hashes are summed in eight 32-bit lanes, so no list of rows is built."""
    row = F.sha2(F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns)), 256)
    lanes = [F.sum(F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("long")).alias(f"_{i}") for i in range(8)]
    got = df.select(*(by or []), row.alias("_h")).groupBy(*(by or [])).agg(F.count("*").alias("rows"), *lanes)
    return got.select(*(by or []), "rows", F.sha2(F.concat_ws(":", F.col("rows").cast("string"), *(F.col(f"_{i}").cast("string") for i in range(8))), 256).alias("digest"))


def snapshot_diff(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Artifacts that one manifest lacks or that differ in a field (null-safe)."""
    a, b = left.select(key, F.struct(*fields).alias("a")), right.select(key, F.struct(*fields).alias("b"))
    code = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, key, "full_outer").select(key, code.alias("code")).where("code is not null")


def cross_reuse(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Per column the number of distinct values that both tables hold."""
    parts = [left.select(F.col(c).alias("v")).distinct().join(right.select(F.col(c).alias("v")), "v", "left_semi").agg(F.lit(c).alias("field"), F.count("*").alias("shared")) for c in columns]
    return union(parts)


def orphans(left: DataFrame, right: DataFrame, key: str, other: str) -> DataFrame:
    """Rows of either table without one in the other."""
    a = issues(left.join(right.select(F.col(other).alias(key)), key, "left_anti"), "orphans", "without_target", key, F.col(key))
    b = issues(right.join(left.select(F.col(key).alias(other)), other, "left_anti"), "orphans", "without_case", other, F.col(other))
    return a.unionByName(b)


def lead_profile(df: DataFrame, label: str, lead: Column) -> DataFrame:
    """Lead words whose counts differ between labels: word, least and greatest count (0 where a label lacks it)."""
    each = df.select(label, lead.alias("lead")).groupBy("lead", label).count()
    labels = df.agg(F.count_distinct(label).alias("labels"))
    got = each.groupBy("lead").agg(F.count("*").alias("k"), F.min("count").alias("least"), F.max("count").alias("most")).crossJoin(F.broadcast(labels))  # one row
    return got.select("lead", F.when(F.col("k") < F.col("labels"), 0).otherwise(F.col("least")).cast("long").alias("least"), "most").where("least <> most")


def pair_contract(df: DataFrame, key: str, matched: str, domain: str, label: str) -> DataFrame:
    """Issues of matched pairs: missing, not reciprocal, other domain, same label."""
    other = df.select(F.col(key).alias("_k"), F.col(matched).alias("_m"), F.col(domain).alias("_d"), F.col(label).alias("_l"), F.lit(True).alias("_there"))
    both = df.join(other, F.col(matched) == F.col("_k"), "left")
    there = F.col("_there").isNotNull()
    codes = F.array_compact(F.array(F.when(~there, "missing_match"), F.when(there & ~F.col("_m").eqNullSafe(F.col(key)), "not_reciprocal"), F.when(there & ~F.col("_d").eqNullSafe(F.col(domain)), "other_domain"), F.when(there & F.col("_l").eqNullSafe(F.col(label)), "same_label")))
    return issues(both.select(key, matched, F.explode(codes).alias("code")), "pair_contract", F.col("code"), matched, F.col(key), F.col(matched))


def evaluability(df: DataFrame, columns: list[str]) -> DataFrame:
    """A field can be evaluated only with two or more distinct values."""
    return union([df.agg(F.lit(c).alias("field"), F.count_distinct(c).alias("values")).withColumn("evaluable", F.col("values") >= 2) for c in columns])


def family_contract(df: DataFrame, family: str, split: str, label: str, domain: str, labels: int) -> DataFrame:
    """Families that span splits or domains, or don't hold exactly ``labels`` labels."""
    got = df.groupBy(family).agg(F.count_distinct(split).alias("splits"), F.count_distinct(label).alias("labels"), F.count_distinct(domain).alias("domains"), F.count("*").alias("rows"))
    return got.withColumn("ok", (F.col("splits") == 1) & (F.col("labels") == labels) & (F.col("domains") == 1))


def condition_completeness(df: DataFrame, unit: str, condition: str, required: list[str]) -> DataFrame:
    """Per unit: the required conditions it lacks, and how many rows it has of them."""
    need = F.array(*(F.lit(c) for c in required))
    got = df.groupBy(unit).agg(F.collect_set(F.when(F.col(condition).isin(required), F.col(condition))).alias("s"), F.count_if(F.col(condition).isin(required)).alias("rows"))  # at most the required ones
    return got.select(unit, "rows", F.array_join(F.sort_array(F.array_except(need, "s")), ",").alias("missing"))


def position_balance(df: DataFrame, condition: str, position: str) -> DataFrame:
    """Per condition the least and greatest count of answer positions, and if they are equal."""
    got = df.groupBy(condition, position).count().groupBy(condition).agg(F.min("count").alias("least"), F.max("count").alias("most"))
    return got.withColumn("balanced", F.col("least") == F.col("most"))


def freeze_key(df: DataFrame, question: str, fields: list[str]) -> DataFrame:
    """Per question: the unanimous answer (digest of the fields), or rubric_required."""
    signature = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in fields))
    got = df.select(question, signature.alias("s")).groupBy(question).agg(F.count_distinct("s").alias("k"), F.min("s").alias("one"))
    return got.select(question, F.when(F.col("k") == 1, F.col("one")).otherwise("rubric_required").alias("key"))


def evidence_requirements(claims: DataFrame, requirements: DataFrame, key: str, level: str) -> DataFrame:
    """Per claim the axes that its level demands and that aren't true. ``claims`` has a boolean column for each axis; ``requirements``: level, axis."""
    axes = [r["axis"] for r in requirements.select("axis").distinct().collect()]  # columns of ``claims``
    held = F.array_compact(F.array(*(F.when(F.col(a), F.lit(a)) for a in axes)))
    need = requirements.groupBy("level").agg(F.collect_set("axis").alias("need"))
    got = claims.join(F.broadcast(need), claims[level] == need["level"], "left")
    return got.select(key, F.array_join(F.sort_array(F.array_except(F.coalesce("need", F.array().cast("array<string>")), held)), ",").alias("missing"))


def remap_labels(df: DataFrame, column: str, old: str, new: str, key: str) -> DataFrame:
    """Values with prefix ``old`` get ``new``: key, before, after, code unexpected (another prefix) or collision (the new value isn't unique), else null."""
    v = F.col(column)
    after = F.when(v.startswith(old), F.concat(F.lit(new), v.substr(F.lit(len(old) + 1), F.length(v))))
    rows = df.select(key, v.alias("before"), after.alias("after"))
    clash = rows.where("after is not null").select("after", "before").distinct().groupBy("after").count().where("count > 1").select("after", F.lit(True).alias("clash"))
    return rows.join(clash, "after", "left").select(key, "before", "after", F.when(F.col("after").isNull(), "unexpected").when(F.col("clash"), "collision").alias("code"))


def readiness(gates: list[tuple[str, DataFrame]]) -> DataFrame:
    """Gates (one-row tables with ``passed``) as rows, and a last row that all have to pass."""
    rows = union([g.select(F.lit(name).alias("gate"), "passed") for name, g in gates])
    return rows.unionByName(rows.agg(F.lit("all").alias("gate"), F.bool_and("passed").alias("passed")))
