"""Probe selection and endpoint queries on embeddings: four layers of sixteen numbers, domains by id."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra.operators import baselines as B
from evidra.operators import probes as P
from evidra.operators import selection as S
from evidra.plans.tables import cases, rounded, table
from evidra.sources.io import settled

LAYERS, DIM, PERMS = 4, 16, 99
LIMITS = {"p": 0.05, "margin": 0.05, "rate": 0.6, "domains": 1.0}


def _layers():
    return F.array(*(F.slice(P.doubles(F.col("embedding")), 1 + DIM * i, DIM) for i in range(LAYERS)))


def _healthy(spark, sf_dir):
    """Vectors of the declared length without null, infinite or missing numbers."""
    return table(spark, sf_dir, "embeddings").where((F.size("embedding") == LAYERS * DIM) & ~F.exists("embedding", lambda x: ~P.finite(x)) & F.col("vec_id").isNotNull())


def _cells(spark, sf_dir, permutations):
    rows = _healthy(spark, sf_dir).select("vec_id", (F.col("vec_id") % 5).cast("string").alias("domain"), F.col("label").cast("string").alias("label"), _layers().alias("layers"))
    y, k = S.run_labels(rows, "vec_id", "domain", "label", permutations, "block-1")
    rows = settled(rows.join(y, "vec_id").select("vec_id", "domain", "y", "layers"), "layers")
    fits = S.nested_fits(S.moments(rows, DIM, permutations + 1, k), DIM, permutations + 1, k)
    return settled(S.confusions(rows, "vec_id", fits, DIM, permutations + 1, k), "confusions")


def _evals(spark, sf_dir, permutations):
    cells = _cells(spark, sf_dir, permutations)
    return settled(S.outer_eval(cells, S.nested_alpha(cells)), "evals")


def g4_nested_alpha(spark, sf_dir):
    return rounded(S.nested_alpha(_cells(spark, sf_dir, 0)).drop("run"), "inner_f1")


def g5_nested_outer_eval(spark, sf_dir):
    """Outer folds under their own penalty, with the margin over the majority."""
    got = _evals(spark, sf_dir, 0).drop("run")
    rows = _healthy(spark, sf_dir).select(F.col("vec_id").alias("case_id"), (F.col("vec_id") % 5).cast("string").alias("domain"), F.col("label").cast("string").alias("label"))
    base = B.class_metrics(B.majority(rows)).select(F.col("domain").alias("outer"), F.col("macro_f1").alias("base"))
    return rounded(got.join(base, "outer").withColumn("margin", F.col("macro_f1") - F.col("base")).drop("base"), "inner_f1", "macro_f1", "accuracy", "margin")


def g6_blocked_permutation(spark, sf_dir):
    """By layer and outer domain: macro F1, and its p-value against labels permuted within domains, with the penalty chosen anew each time."""
    means = _evals(spark, sf_dir, PERMS).select("layer", "outer", "run", F.col("macro_f1").alias("mean_f1"))
    got = S._split(means, ["layer", "outer"]).groupBy("layer", "outer", F.col("observed").alias("macro_f1")).agg(S.p_value(F.col("observed"), F.col("null")).alias("p"))
    return rounded(got, "macro_f1", "p")


def g7_layer_test(spark, sf_dir):
    return rounded(S.layer_test(_evals(spark, sf_dir, PERMS)), "macro_f1", "inner_f1", "p")


def g8_max_statistic(spark, sf_dir):
    return rounded(S.max_statistic(_evals(spark, sf_dir, PERMS), 0.05), "macro_f1", "p")


def g24_probe_suite(spark, sf_dir):
    """Layer tests with Holm's correction, the maximum over layers, and the gates: support in every fold, a resolvable p, the chosen layer."""
    evals = _evals(spark, sf_dir, PERMS)
    top = S.max_statistic(evals, 0.05).select(F.col("layer").alias("best"), F.col("p").alias("max_p"), "status")
    rows = _healthy(spark, sf_dir).select(F.col("vec_id").alias("case_id"), (F.col("vec_id") % 5).cast("string").alias("domain"), F.col("label").cast("string").alias("label"))
    support = B.support_check(rows, 10, 3).agg(F.bool_and("valid").alias("supported"))
    got = P.holm(S.layer_test(evals).select("p", "layer", "macro_f1", "inner_f1"), "p").crossJoin(F.broadcast(top)).crossJoin(F.broadcast(support))  # one row each
    gate = F.when(~F.col("supported"), "unsupported").when(F.col("status") != "pass", F.col("status")).when(F.col("layer") == F.col("best"), "selected").otherwise("not_selected")
    return rounded(got.select("layer", "macro_f1", "inner_f1", "p", "adjusted", "max_p", gate.alias("gate")), "macro_f1", "inner_f1", "p", "adjusted", "max_p")


def _paired(spark, sf_dir):
    """Vectors in families of two, one positive, in three domains."""
    family = F.floor(F.col("vec_id") / 2)
    return _healthy(spark, sf_dir).select(F.col("vec_id").alias("case_id"), (family % 3).cast("string").alias("domain"), family.alias("family"), F.array((F.col("vec_id") % 2 == 0).cast("int")).alias("y"), _layers().alias("layers"))


def _scores(spark, sf_dir):
    return S.score_operator(_paired(spark, sf_dir), DIM, 1.0)


def _null(spark, sf_dir, layers=None):
    """Families won against 199 refits on labels swapped within families."""
    return S.swap_null(_paired(spark, sf_dir), DIM, 1.0, 199, "swap-1", layers)


def g15_swap_null(spark, sf_dir):
    """The most families that a layer wins, against the most that any wins when labels are swapped and all layers' probes fitted anew."""
    return rounded(_null(spark, sf_dir), "p")


def g10_score_operator(spark, sf_dir):
    return rounded(_scores(spark, sf_dir).select("case_id", "layer", "label", "score"), "score")


def _surface(spark, sf_dir):
    """Surface baselines: the mean macro F1 of shape statistics and of the majority over documents."""
    rows = cases(spark, sf_dir)
    parts = [B.fold_mean(B.class_metrics(p)).select("macro_f1") for p in (B.shape_centroid(rows), B.majority(rows))]
    return parts[0].unionByName(parts[1])


def g16_surface_margin(spark, sf_dir):
    """By layer: macro F1 of the scores less the best surface baseline's."""
    best = _surface(spark, sf_dir).agg(F.max("macro_f1").alias("surface"))
    return rounded(S.combo_f1(_scores(spark, sf_dir)).crossJoin(F.broadcast(best)).select("layer", "macro_f1", (F.col("macro_f1") - F.col("surface")).alias("margin")), "macro_f1", "margin")  # one row


def g17_endpoint_decision(spark, sf_dir):
    return rounded(S.primary_endpoint(_scores(spark, sf_dir), _null(spark, sf_dir, [0]), _surface(spark, sf_dir), 0, LIMITS), "p", "macro_f1", "margin")


def g18_sensitivity(spark, sf_dir):
    return rounded(S.sensitivity(_scores(spark, sf_dir), 0), "macro_f1", "accuracy", "range")


def g25_primary_suite(spark, sf_dir):
    """The primary layer's decision beside all layers' metrics, bound to the digest of the labels that were read."""
    scores, rows = _scores(spark, sf_dir), _paired(spark, sf_dir)
    bound = rows.select(F.sha2(F.concat_ws(":", "case_id", F.col("y")[0].cast("string")), 256).alias("h")).agg(F.sum(F.conv(F.substring("h", 1, 12), 16, 10).cast("decimal(38,0)")).cast("string").alias("labels_digest"))
    end = S.primary_endpoint(scores, _null(spark, sf_dir, [0]), _surface(spark, sf_dir), 0, LIMITS).select("p", "decision")
    got = S.sensitivity(scores, 0).crossJoin(F.broadcast(end)).crossJoin(F.broadcast(bound))  # one row each
    return rounded(got.withColumns({"p": F.when(F.col("primary"), F.col("p")), "decision": F.when(F.col("primary"), F.col("decision"))}), "macro_f1", "accuracy", "range", "p")


def _directions(spark, sf_dir):
    rows = _healthy(spark, sf_dir).select((F.col("vec_id") % 5).alias("domain"), (F.col("label").cast("int") == 0).alias("t"), F.posexplode(_layers()).alias("layer", "vector"))
    return rows, settled(P.contrast_direction(rows, "layer", "vector", F.col("t"), DIM), "directions")


def g21_random_direction_control(spark, sf_dir):
    """By layer: the cosine of the contrast direction with 20 random ones, in range and on average."""
    got = S.random_directions(_directions(spark, sf_dir)[1], 20, DIM, "random-1")
    return rounded(got.groupBy("layer").agg(F.count("*").alias("seeds"), F.avg("cosine").alias("mean"), F.max(F.abs("cosine")).alias("largest")), "mean", "largest")


def g23_direction_gates(spark, sf_dir):
    rows, directions = _directions(spark, sf_dir)
    return S.direction_gates(rows.where("layer = 0"), directions, "layer", F.col("t"), 10, 2)


QUERIES = {f.__name__: f for f in (g4_nested_alpha, g5_nested_outer_eval, g6_blocked_permutation, g7_layer_test, g8_max_statistic, g10_score_operator, g15_swap_null, g16_surface_margin, g17_endpoint_decision, g18_sensitivity, g21_random_direction_control, g23_direction_gates, g24_probe_suite, g25_primary_suite)}

#: Ridge solves can't be said in SQL; tests fit directly.
ORACLE_SQL = {
    "g23_direction_gates": """WITH v AS (SELECT vec_id % 5 AS domain, CAST(label AS INTEGER) = 0 AS t, embedding FROM embeddings WHERE len(embedding) = 64), d AS (SELECT domain, count(*) FILTER (t) AS t, count(*) FILTER (NOT t) AS c FROM v GROUP BY domain),
w AS (SELECT sum(t) AS t, sum(c) AS c, count(*) FILTER (t > 0 AND c > 0) AS d FROM d), e AS (SELECT i AS layer, t, CAST(unnest(embedding[16 * i + 1 : 16 * i + 16]) AS DOUBLE) AS x, unnest(range(16)) AS k FROM v, (SELECT unnest(range(4)) AS i)),
n AS (SELECT layer, sqrt(sum(g * g)) AS norm FROM (SELECT layer, k, avg(x) FILTER (t) - avg(x) FILTER (NOT t) AS g FROM e GROUP BY layer, k) GROUP BY layer)
SELECT CAST(layer AS INTEGER) AS layer, CASE WHEN least(t, c) < 10 THEN 'too_few_rows' WHEN d < 2 THEN 'too_few_domains' WHEN coalesce(norm, 0) <= 0 THEN 'zero_direction' ELSE 'pass' END AS status FROM n, w""",
}
