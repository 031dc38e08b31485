"""Agreement queries on line items: unit = order, rater = line number, label = return flag."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra.operators import agreement as A
from evidra.plans.tables import RATINGS, ratings, rounded, table

_ORDER = ["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"]
_KEEP = ["case_id", "rater_id", "label", "file", "line"]


def _units(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit"))


def d0_annotation_filter(spark, sf_dir):
    got = A.annotation_filter(ratings(spark, sf_dir), _units(spark, sf_dir).where("unit % 50 <> 0"), unit="unit", rater="rater", label="label", order=_ORDER, allowed=["A", "N"])
    return got.select("unit", "rater", "label", "l_partkey", "l_suppkey", "code")


def _records(spark, sf_dir):
    """Line items as annotation records, two files to a rater, with faults by part, supplier and quantity."""
    q, sha = F.col("l_quantity").cast("long"), F.md5(F.col("l_orderkey").cast("string"))
    rater = F.when((F.col("l_linenumber") == 7) & (F.col("l_suppkey") % 4 == 0), 8).otherwise(F.col("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", F.col("l_linenumber").cast("string"), (F.col("l_suppkey") % 2).cast("string")).alias("file"), (F.col("l_orderkey") * 1_000_000 + F.col("l_partkey")).alias("line"), rater.cast("string").alias("rater_id"),
        (F.col("l_orderkey") * 100 + F.col("l_partkey") % 40).alias("annotation_id"), F.col("l_orderkey").alias("case_id"), F.col("l_returnflag").alias("label"), F.when(q != 1, F.col("l_partkey").cast("string")).alias("session_id"),
        F.when(q == 2, "x").otherwise(sha).alias("case_sha256"), F.when(q == 3, "x").otherwise("b1").alias("batch"), F.when(q == 4, "v0").otherwise("v1").alias("view"), (q == 5).alias("machine"), F.when(q == 6, "g0").otherwise("g1").alias("guide"), q.alias("quantity"),
    )


def _checked(spark, sf_dir):
    known = _units(spark, sf_dir).where("unit % 50 <> 0").select(F.col("unit").alias("case_id"), F.md5(F.col("unit").cast("string")).alias("case_sha256"))
    return A.annotation_checks(_records(spark, sf_dir), known, F.col("quantity") != 7, ["A", "N"], {"batch": "b1", "view": "v1", "machine": False, "guide": "g1"}, _KEEP)


def d0_annotation_checks(spark, sf_dir):
    """All issues of the records."""
    return _checked(spark, sf_dir)[0]


def d0_checked_annotations(spark, sf_dir):
    """What passes, as the statistics take it."""
    return _checked(spark, sf_dir)[1]


def d1_pairwise_agreement(spark, sf_dir):
    return rounded(A.pairwise_agreement(A.unit_counts(ratings(spark, sf_dir), "unit", "label")), "agreement")


def d1_unit_agreement(spark, sf_dir):
    got = A.unit_counts(ratings(spark, sf_dir), "unit", "label").where("m >= 2")
    return rounded(got.select("unit", "m", "matches", "pairs", (F.col("matches") / F.col("pairs")).alias("agreement")), "agreement")


def d2_alpha_nominal(spark, sf_dir):
    return rounded(A.alpha_nominal(ratings(spark, sf_dir), "unit", "label"), "observed", "expected", "alpha")


def d3_alpha_ordinal(spark, sf_dir):
    return rounded(A.alpha_ordinal(ratings(spark, sf_dir), "unit", "grade"), "alpha").select("n", "alpha")


def d4_bootstrap_ci(spark, sf_dir):
    return A.bootstrap_agreement(ratings(spark, sf_dir), "unit", "label", 2000, 1729)


def d5_abstention_rate(spark, sf_dir):
    return rounded(A.abstention_rate(ratings(spark, sf_dir), "label", "N"), "abstention_rate")


def d6_consensus(spark, sf_dir):
    return A.consensus(ratings(spark, sf_dir), "unit", "label", "N")


def d7_coverage(spark, sf_dir):
    return A.coverage(_units(spark, sf_dir), ratings(spark, sf_dir), "unit", "rater")


def d8_mean_abs_diff(spark, sf_dir):
    return rounded(A.mean_abs_diff(ratings(spark, sf_dir), "unit", "grade"), "mean_abs_diff")


def d9_freeze_decision(spark, sf_dir):
    rows = ratings(spark, sf_dir)
    one = A.pairwise_agreement(A.unit_counts(rows, "unit", "label")).select("agreement")
    for more in (
        A.alpha_nominal(rows, "unit", "label").select("alpha"), A.abstention_rate(rows, "label", "N").select("abstention_rate"),
        A.consensus(rows, "unit", "label", "N").agg(F.count_if("disagreement").alias("disagreements"), F.count_if("unanimous_abstention").alias("unanimous_abstentions")),
        A.coverage(_units(spark, sf_dir), rows, "unit", "rater").agg(F.count_if(F.col("raters") < 2).alias("uncovered")),
    ):
        one = one.crossJoin(F.broadcast(more))  # one row each
    return rounded(A.freeze_decision(one, 0.8, 0.7, 0.1), "agreement", "alpha", "abstention_rate")


def d10_rater_order(spark, sf_dir):
    return A.rater_order(ratings(spark, sf_dir), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit")), "rater", "unit", "guide-1")


QUERIES = {f.__name__: f for f in (d0_annotation_filter, d0_annotation_checks, d0_checked_annotations, d1_pairwise_agreement, d1_unit_agreement, d2_alpha_nominal, d3_alpha_ordinal, d4_bootstrap_ci, d5_abstention_rate, d6_consensus, d7_coverage, d8_mean_abs_diff, d9_freeze_decision, d10_rater_order)}

_COUNTS = f"""WITH {RATINGS}, per AS (SELECT unit, label, count(*) AS n FROM ratings GROUP BY ALL),
u AS (SELECT unit, CAST(sum(n) AS BIGINT) AS m, CAST(sum(n * n) AS BIGINT) AS sq, count(*) AS k, max(label) AS any_label FROM per GROUP BY unit)"""
_CONSENSUS = """SELECT unit, m, CASE WHEN k = 1 THEN any_label END AS label, k <> 1 AS disagreement, k = 1 AND any_label = 'N' AS unanimous_abstention,
  k <> 1 OR any_label = 'N' AS adjudicate FROM u"""
_NOMINAL = f"""{_COUNTS}, w AS (SELECT * FROM u WHERE m >= 2), t AS (SELECT CAST(sum(m) AS BIGINT) AS n, sum((m * m - sq) / (m - 1.0)) AS d FROM w),
c AS (SELECT sum(x * x) AS s FROM (SELECT label, sum(n) AS x FROM per WHERE unit IN (SELECT unit FROM w) GROUP BY label)),
a AS (SELECT n, CAST(d AS DOUBLE) / n AS observed, (CAST(n AS DOUBLE) * n - s) / (CAST(n AS DOUBLE) * (n - 1)) AS expected FROM t, c)"""

_RECORDS = """WITH r AS (SELECT l_linenumber || '-' || (l_suppkey % 2) AS file, l_orderkey * 1000000 + l_partkey AS line, CAST(CASE WHEN l_linenumber = 7 AND l_suppkey % 4 = 0 THEN 8 ELSE l_linenumber END AS VARCHAR) AS rater_id,
  l_orderkey * 100 + l_partkey % 40 AS annotation_id, l_orderkey AS case_id, l_returnflag AS label, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
f AS (SELECT file, min(rater_id) AS rater, min(rater_id) = max(rater_id) AS one FROM r GROUP BY file),
g AS (SELECT *, min(file) OVER (PARTITION BY rater) AS first FROM f WHERE one),
a AS (SELECT r.*, {'f': file, 'l': line} AS pos FROM r WHERE file IN (SELECT file FROM g)),
i AS (SELECT annotation_id, min(pos) AS head FROM a WHERE q <> 7 GROUP BY 1),
b AS (SELECT a.*, CASE WHEN q = 7 THEN 'schema_invalid' WHEN a.pos > i.head THEN 'duplicate_annotation_id' WHEN case_id % 50 = 0 OR case_id NOT IN (SELECT o_orderkey FROM orders) THEN 'unknown_case' END AS gone FROM a LEFT JOIN i USING (annotation_id)),
s AS (SELECT case_id, rater_id, min(pos) AS seen FROM b WHERE gone IS NULL AND q > 6 AND label IN ('A', 'N') GROUP BY ALL),
c AS (SELECT b.*, gone IS NULL AND q > 6 AND label IN ('A', 'N') AS passing, coalesce(pos > seen, false) AS later FROM b LEFT JOIN s USING (case_id, rater_id))"""

ORACLE_SQL = {
    "d0_annotation_checks": f"""{_RECORDS}, e AS (
SELECT file, CAST(line AS VARCHAR) AS line, gone AS code FROM c WHERE gone IS NOT NULL UNION ALL
SELECT file, CAST(line AS VARCHAR), ['missing_session_id', 'invalid_case_hash', 'invalid_batch', 'invalid_view', 'invalid_machine', 'invalid_guide'][q] FROM c WHERE gone IS NULL AND q <= 6 UNION ALL
SELECT file, CAST(line AS VARCHAR), 'invalid_label' FROM c WHERE gone IS NULL AND label NOT IN ('A', 'N') UNION ALL
SELECT file, CAST(line AS VARCHAR), 'duplicate_case_rater' FROM c WHERE gone IS NULL AND label IN ('A', 'N') AND later)
SELECT 'annotations' AS "check", code, '' AS field, file AS entity_id, line AS other_id, CAST(NULL AS VARCHAR) AS detail, 'error' AS severity FROM e UNION ALL
SELECT 'annotations', 'mixed_or_missing_rater_file', 'rater_id', file, NULL, NULL, 'error' FROM f WHERE NOT one UNION ALL
SELECT 'annotations', 'duplicate_rater_file', 'rater_id', file, first, NULL, 'error' FROM g WHERE file <> first""",
    "d0_checked_annotations": f"{_RECORDS} SELECT case_id, rater_id, label, file, line FROM c WHERE passing AND NOT later",
    "d0_annotation_filter": f"""WITH {RATINGS}, known AS (SELECT o_orderkey AS unit FROM orders WHERE o_orderkey % 50 <> 0),
f AS (SELECT r.*, CASE WHEN r.unit NOT IN (SELECT unit FROM known) THEN 'unknown_unit' WHEN label NOT IN ('A', 'N') THEN 'label_not_allowed' END AS c FROM ratings r)
SELECT unit, rater, label, l_partkey, l_suppkey,
  coalesce(c, CASE WHEN row_number() OVER (PARTITION BY unit, rater, c IS NULL ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) > 1 THEN 'duplicate_rating' END) AS code FROM f""",
    "d1_pairwise_agreement": f"""{_COUNTS} SELECT count(*) AS units, CAST(sum((sq - m) / 2) AS BIGINT) AS matches, CAST(sum(m * (m - 1) / 2) AS BIGINT) AS pairs,
  round(sum((sq - m) / 2) / sum(m * (m - 1) / 2), 6) AS agreement FROM u WHERE m >= 2""",
    "d1_unit_agreement": f"""{_COUNTS} SELECT unit, m, CAST((sq - m) / 2 AS BIGINT) AS matches, CAST(m * (m - 1) / 2 AS BIGINT) AS pairs, round((sq - m) / (CAST(m AS DOUBLE) * (m - 1)), 6) AS agreement FROM u WHERE m >= 2""",
    "d2_alpha_nominal": f"""{_NOMINAL} SELECT n, round(observed, 6) AS observed, round(expected, 6) AS expected, round(1 - observed / expected, 6) AS alpha FROM a""",
    "d3_alpha_ordinal": f"""WITH {RATINGS}, r AS (SELECT unit, grade, count(*) OVER (PARTITION BY unit) AS m FROM ratings), w AS (SELECT * FROM r WHERE m >= 2),
h AS (SELECT grade, count(*) AS n FROM w GROUP BY grade), p AS (SELECT grade, n, sum(n) OVER (ORDER BY grade) - n / 2.0 AS at FROM h),
o AS (SELECT unit, m, grade, count(*) AS n FROM w GROUP BY ALL),
s AS (SELECT sum(2.0 * a.n * b.n * (x.at - y.at) * (x.at - y.at) / (a.m - 1)) AS d FROM o a JOIN o b ON a.unit = b.unit AND a.grade < b.grade JOIN p x ON x.grade = a.grade JOIN p y ON y.grade = b.grade),
e AS (SELECT sum(2.0 * x.n * y.n * (x.at - y.at) * (x.at - y.at)) AS s FROM p x JOIN p y ON x.grade < y.grade), t AS (SELECT CAST(sum(n) AS BIGINT) AS n FROM h)
SELECT n, round(1 - (d / n) / (s / (CAST(n AS DOUBLE) * (n - 1))), 6) AS alpha FROM t, s, e""",
    "d5_abstention_rate": f"WITH {RATINGS} SELECT count(*) AS n, round(avg(CASE WHEN label = 'N' THEN 1.0 ELSE 0 END), 6) AS abstention_rate FROM ratings",
    "d6_consensus": f"{_COUNTS} {_CONSENSUS}",
    "d7_coverage": f"WITH {RATINGS} SELECT o_orderkey AS unit, count(DISTINCT rater) AS raters FROM orders LEFT JOIN ratings ON unit = o_orderkey GROUP BY o_orderkey",
    "d8_mean_abs_diff": f"""WITH {RATINGS}, x AS (SELECT *, row_number() OVER (PARTITION BY unit) AS k FROM ratings)
SELECT count(*) AS pairs, round(avg(abs(a.grade - b.grade)), 6) AS mean_abs_diff FROM x a JOIN x b ON a.unit = b.unit AND a.k < b.k""",
    "d9_freeze_decision": f"""{_NOMINAL}, g AS (SELECT sum((sq - m) / 2) / sum(m * (m - 1) / 2) AS agreement FROM w), z AS ({_CONSENSUS}),
b AS (SELECT avg(CASE WHEN label = 'N' THEN 1.0 ELSE 0 END) AS r FROM ratings), v AS (SELECT o_orderkey, count(DISTINCT rater) AS k FROM orders LEFT JOIN ratings ON unit = o_orderkey GROUP BY o_orderkey),
q AS (SELECT agreement, 1 - observed / expected AS alpha, r AS abstention_rate, (SELECT count(*) FROM z WHERE disagreement) AS disagreements,
  (SELECT count(*) FROM z WHERE unanimous_abstention) AS unanimous_abstentions, (SELECT count(*) FROM v WHERE k < 2) AS uncovered FROM g, a, b)
SELECT round(agreement, 6) AS agreement, round(alpha, 6) AS alpha, round(abstention_rate, 6) AS abstention_rate, disagreements, unanimous_abstentions, uncovered,
  agreement >= 0.8 AND alpha >= 0.7 AND abstention_rate <= 0.1 AND disagreements = 0 AND unanimous_abstentions = 0 AND uncovered = 0 AS freeze FROM q""",
    "d10_rater_order": f"""WITH {RATINGS} SELECT rater, c_custkey AS unit, row_number() OVER (PARTITION BY rater ORDER BY sha256('guide-1:' || rater || ':' || c_custkey)) AS position
FROM (SELECT DISTINCT rater FROM ratings), (SELECT DISTINCT c_custkey FROM customer)""",
}
