"""Experiment and effect queries on customers, orders, line items, events, embeddings and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra.operators import effects as H
from evidra.operators import experiments as E
from evidra.plans.tables import rounded, table


def e1_assign_arms(spark, sf_dir):
    return E.assign_arms(table(spark, sf_dir, "customer"), "c_custkey", ["base", "hint", "full"], "seed-1")


def e2_counterbalance(spark, sf_dir):
    return E.counterbalance(table(spark, sf_dir, "customer"), "c_custkey", "seed-1")


def e3_split_assign(spark, sf_dir):
    return E.split_assign(table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey", 20)


def _ratings(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("response"), F.col("l_linenumber").alias("rater"), F.floor(F.col("l_quantity") / 10).alias("score"))


def e4_experiment_integrity(spark, sf_dir):
    packets = table(spark, sf_dir, "orders").where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("packet"), F.lit("A").alias("blind"))
    responses = table(spark, sf_dir, "orders").where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("response"), (F.col("o_orderkey") - F.col("o_orderkey") % 13 % 2).alias("packet"), F.lit("A").alias("blind"))
    return E.experiment_integrity(packets, responses, _ratings(spark, sf_dir), 2, 4)


def e5_score_arms(spark, sf_dir):
    return rounded(E.score_arms(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_orderkey", "l_linestatus", "l_quantity"), "mean")


def e6_paired_deltas(spark, sf_dir):
    return rounded(E.paired_deltas(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", ["1-URGENT", "2-HIGH"]), "delta", "gain", digits=3)


def e7_rater_summary(spark, sf_dir):
    return E.rater_summary(_ratings(spark, sf_dir), "response", "rater", 3)


def e8_blind_export(spark, sf_dir):
    assigned = E.assign_arms(table(spark, sf_dir, "documents"), "doc_id", ["base", "full"], "seed-2")
    return E.blind_export(assigned, "doc_id", table(spark, sf_dir, "documents"), F.md5("text"))


def _scores(spark, sf_dir):
    v = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", v.alias("scores"))


def h1_choice_logprob(spark, sf_dir):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return rounded(table(spark, sf_dir, "embeddings").select("vec_id", H.logprob(v, F.col("label") + 1).alias("logprob")), "logprob")


def h2_choice_margin(spark, sf_dir):
    at = F.col("label") % 4 + 1
    return rounded(_scores(spark, sf_dir).select("vec_id", H.margin_mean(F.col("scores"), at).alias("mean_margin"), H.margin_max(F.col("scores"), at).alias("max_margin")), "mean_margin", "max_margin")


def h3_top_choice(spark, sf_dir):
    return _scores(spark, sf_dir).select("vec_id", H.top_choice(F.col("scores")).alias("choice"))


def h4_unit_effects(spark, sf_dir):
    return rounded(H.unit_effects(table(spark, sf_dir, "events"), ["user_id"], "event_type", "value", "purchase", "view"), "transfer", "control", "delta")


def _means(spark, sf_dir):
    got = H.unit_effects(table(spark, sf_dir, "events"), ["user_id"], "event_type", "value", "click", "view")
    return H.domain_means(got.withColumn("domain", F.col("user_id") % 8), "domain")


def h5_sign_flip_exact(spark, sf_dir):
    return rounded(H.sign_flip_exact(_means(spark, sf_dir), "domain"), "mean", "p")


def h6_domain_bootstrap(spark, sf_dir):
    return H.domain_bootstrap(_means(spark, sf_dir), "domain", 10_000, 1729)


def h7_transfer_decision(spark, sf_dir):
    return rounded(H.transfer_decision(_means(spark, sf_dir), "domain", 0.05, 0.1, 6), "mean", "p", "least_mean")


def h8_remap_scores(spark, sf_dir):
    maps = spark.createDataFrame([(k, [(i + k) % 4 + 1 for i in range(4)]) for k in range(4)], "mapping int, places array<int>")
    got = H.remap_scores(_scores(spark, sf_dir), "vec_id", "scores", maps)
    return got.select("vec_id", "mapping", H.top_choice(F.col("scores")).alias("choice"))


def h9_adjust_prior(spark, sf_dir):
    prior = F.array(*(F.lit(x) for x in (-0.1, 0.05, 0.0, 0.1)))
    return _scores(spark, sf_dir).select("vec_id", H.top_choice(H.adjust_prior(F.col("scores"), prior)).alias("choice"))


def h10_label_entropy(spark, sf_dir):
    return rounded(H.label_entropy(table(spark, sf_dir, "events"), "user_id", "event_type"), "bits")


def h12_surface_invariance(spark, sf_dir):
    return rounded(H.surface_invariance(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", "l_returnflag", 1), "agreement")


def h13_module_metrics(spark, sf_dir):
    v = F.col("value")
    return rounded(H.module_metrics(table(spark, sf_dir, "events"), "event_type", v > 20, v < 5, F.col("user_id") % 3 == 0), "accuracy", "precision", "abstention_rate", "abstention_precision", "abstention_recall")


def h14_condition_contrasts(spark, sf_dir):
    return rounded(H.condition_contrasts(table(spark, sf_dir, "events"), "user_id", "event_type", "value", "click", "view"), "difference", "stability", "win_rate")


def h15_family_accuracy(spark, sf_dir):
    return rounded(H.accuracy_by(table(spark, sf_dir, "lineitem"), "l_returnflag", F.col("l_quantity") > 25), "accuracy")


def h17_length_parity(spark, sf_dir):
    """Difference of token counts between a conversation's first two turns."""
    from evidra.functions.text import tokens

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(tokens(F.col("text"))).alias("n"))
    first = turns.groupBy("conv_id").agg(F.min("turn").alias("turn"))
    a = turns.join(first, ["conv_id", "turn"]).groupBy("conv_id").agg(F.max("n").alias("a"), F.max("turn").alias("t"))
    b = turns.select("conv_id", F.col("turn").alias("u"), F.col("n").alias("b"))
    return a.join(b, "conv_id").where("u = t + 1").groupBy("conv_id").agg((F.max("b") - F.max("a")).cast("long").alias("difference"))


def h18_expand_units(spark, sf_dir):
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(s).alias("sign")) for k, s in (("forward", 1), ("reverse", -1), ("negative", 0))))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.explode(kinds).alias("k")).select("o_orderkey", "k.kind", "k.sign")


def h19_rotate_options(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    n = rows.count()
    got = H.rotate_options(rows, "c_custkey", F.pmod(F.col("c_custkey"), F.lit(n)), "c_name", [1, 5, 11], n)
    return got.select("c_custkey", F.array_join("options", "|").alias("options"), "answer")


def h20_shard_plan(spark, sf_dir):
    return H.shard_plan(table(spark, sf_dir, "documents"), "doc_id", 64)


QUERIES = {k: v for k, v in globals().items() if k[0] in "eh" and k[1].isdigit()}

_R = "r AS (SELECT l_orderkey AS response, l_linenumber AS rater, CAST(floor(l_quantity / 10) AS BIGINT) AS score FROM lineitem)"
_EFFECT = "ef AS (SELECT user_id, avg(value) FILTER (event_type = '{t}') AS transfer, avg(value) FILTER (event_type = '{c}') AS control FROM events GROUP BY user_id HAVING transfer IS NOT NULL AND control IS NOT NULL)"
_FLIP = _EFFECT.format(t="click", c="view") + """, dm AS (SELECT user_id % 8 AS domain, avg(transfer - control) AS mean FROM ef GROUP BY 1), dk AS (SELECT *, row_number() OVER (ORDER BY domain) - 1 AS i, count(*) OVER () AS k FROM dm),
fl AS (SELECT b, avg(CASE WHEN (b >> CAST(i AS INTEGER)) & 1 = 1 THEN -mean ELSE mean END) AS f FROM dk, range(65536) t(b) WHERE b < (1 << CAST(k AS INTEGER)) GROUP BY b), ob AS (SELECT avg(mean) AS o, count(*) AS k, min(mean) AS least_mean FROM dm),
sf AS (SELECT CAST(any_value(k) AS INTEGER) AS domains, any_value(o) AS mean, avg(CASE WHEN abs(f) >= abs(o) - 1e-12 THEN 1.0 ELSE 0 END) AS p, any_value(least_mean) AS least_mean FROM fl, ob)"""
_S = "s AS (SELECT vec_id, label, CAST(embedding[1:4] AS DOUBLE[]) AS v FROM embeddings)"
_TOP = "list_position({v}, list_max({v}))"
_ISSUE = '"check", code, field, CAST(entity_id AS VARCHAR) AS entity_id, CAST(other_id AS VARCHAR) AS other_id, CAST(detail AS VARCHAR) AS detail, \'error\' AS severity'

ORACLE_SQL = {
    "e1_assign_arms": """SELECT substr(sha256('seed-1:' || c_custkey), 1, 12) AS packet, c_custkey, chr(CAST(64 + row_number() OVER (PARTITION BY c_custkey ORDER BY sha256('seed-1:' || c_custkey || ':' || arm)) AS INTEGER)) AS blind, arm
FROM customer, (VALUES ('base'), ('hint'), ('full')) a(arm)""",
    "e2_counterbalance": "SELECT c_custkey, CAST('0x' || substr(sha256('seed-1:' || c_custkey), 1, 8) AS BIGINT) % 2 AS swapped FROM customer",
    "e3_split_assign": "SELECT c_mktsegment, c_custkey, CASE WHEN row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) <= 20 THEN 'calibration' ELSE 'sealed' END AS split FROM customer",
    "e4_experiment_integrity": f"""WITH {_R}, p AS (SELECT DISTINCT o_orderkey AS packet FROM orders WHERE o_orderkey % 11 <> 0), q AS (SELECT o_orderkey AS response, o_orderkey - o_orderkey % 13 % 2 AS packet FROM orders WHERE o_orderkey % 7 <> 0),
n AS (SELECT packet, count(*) AS n FROM q GROUP BY packet), k AS (SELECT response, count(DISTINCT rater) AS k FROM r GROUP BY response)
SELECT {_ISSUE} FROM (SELECT 'experiment' AS "check", * FROM (
SELECT 'missing_response' AS code, 'packet' AS field, packet || '/A' AS entity_id, NULL AS other_id, NULL AS detail FROM p WHERE packet NOT IN (SELECT packet FROM n) UNION ALL SELECT 'unknown_packet', 'packet', packet || '/A', NULL, NULL FROM n WHERE packet NOT IN (SELECT packet FROM p)
UNION ALL SELECT 'repeated_response', 'packet', packet || '/A', NULL, n FROM n WHERE n > 1 UNION ALL SELECT 'duplicate_response', 'response', CAST(response AS VARCHAR), NULL, NULL FROM q GROUP BY response HAVING count(*) > 1
UNION ALL SELECT 'too_few_raters', 'response', CAST(response AS VARCHAR), NULL, NULL FROM (SELECT DISTINCT response FROM q) WHERE coalesce((SELECT k FROM k WHERE k.response = q.response), 0) < 2
UNION ALL SELECT 'unknown_response', 'response', CAST(response AS VARCHAR), rater, NULL FROM r WHERE response NOT IN (SELECT response FROM q) UNION ALL SELECT 'score_range', 'score', CAST(response AS VARCHAR), rater, NULL FROM r WHERE NOT score BETWEEN 0 AND 4))""".replace("(SELECT DISTINCT response FROM q) WHERE", "(SELECT DISTINCT response FROM q) q WHERE"),
    "e5_score_arms": "WITH p AS (SELECT l_returnflag, l_orderkey, l_linestatus, avg(l_quantity) AS m FROM lineitem GROUP BY ALL) SELECT l_returnflag, l_linestatus, round(avg(m), 6) AS mean, count(*) AS responses FROM p GROUP BY ALL",
    "e6_paired_deltas": """WITH p AS (SELECT o_custkey, o_orderpriority, o_orderstatus AS arm, avg(o_totalprice) AS m FROM orders GROUP BY ALL)
SELECT a.o_custkey, a.o_orderpriority, a.arm AS "left", b.arm AS "right", round(b.m - a.m, 3) AS delta, round((b.m - a.m) * CASE WHEN a.o_orderpriority IN ('1-URGENT', '2-HIGH') THEN -1 ELSE 1 END, 3) AS gain FROM p a JOIN p b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority AND a.arm < b.arm""",
    "e7_rater_summary": f"WITH {_R}, p AS (SELECT response, count(DISTINCT rater) AS k FROM r GROUP BY 1) SELECT count(*) AS responses, count(*) FILTER (k >= 3) AS enough, (SELECT count(DISTINCT rater) FROM r) AS raters, (SELECT count(*) FROM r) AS ratings FROM p",
    "e8_blind_export": """SELECT substr(sha256('seed-2:' || doc_id), 1, 12) AS packet, chr(CAST(64 + row_number() OVER (PARTITION BY doc_id ORDER BY sha256('seed-2:' || doc_id || ':' || arm)) AS INTEGER)) AS blind, md5(text) AS shown FROM documents, (VALUES ('base'), ('full')) a(arm)""",
    "h1_choice_logprob": "WITH s AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT vec_id, round(v[label + 1] - ln(list_sum(list_transform(v, lambda x: exp(x)))), 6) AS logprob FROM s",
    "h2_choice_margin": f"WITH {_S}, o AS (SELECT vec_id, v[label % 4 + 1] AS e, list_filter(v, lambda x, i: i <> label % 4 + 1) AS r FROM s) SELECT vec_id, round(e - list_avg(r), 6) AS mean_margin, round(e - list_max(r), 6) AS max_margin FROM o",
    "h3_top_choice": f"WITH {_S} SELECT vec_id, {_TOP.format(v='v')} AS choice FROM s",
    "h4_unit_effects": f"WITH {_EFFECT.format(t='purchase', c='view')} SELECT user_id, round(transfer, 6) AS transfer, round(control, 6) AS control, round(transfer - control, 6) AS delta FROM ef",
    "h5_sign_flip_exact": f"WITH {_FLIP} SELECT domains, round(mean, 6) AS mean, round(p, 6) AS p FROM sf",
    "h7_transfer_decision": f"WITH {_FLIP} SELECT domains, round(mean, 6) AS mean, round(p, 6) AS p, round(least_mean, 6) AS least_mean, CASE WHEN domains < 6 THEN 'non_interpretable' WHEN p <= 0.05 AND mean >= 0.1 AND least_mean > 0 THEN 'positive' ELSE 'null_result' END AS decision FROM sf",
    "h8_remap_scores": f"WITH {_S}, m AS (SELECT vec_id, k AS mapping, [v[k % 4 + 1], v[(k + 1) % 4 + 1], v[(k + 2) % 4 + 1], v[(k + 3) % 4 + 1]] AS w FROM s, range(4) t(k)) SELECT vec_id, mapping, {_TOP.format(v='w')} AS choice FROM m",
    "h9_adjust_prior": f"WITH {_S}, m AS (SELECT vec_id, [v[1] + 0.1, v[2] - 0.05, v[3], v[4] - 0.1] AS w FROM s) SELECT vec_id, {_TOP.format(v='w')} AS choice FROM m",
    "h10_label_entropy": "WITH g AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY user_id) AS p FROM g) SELECT user_id, CAST(sum(n) AS BIGINT) AS n, round(-sum(p * log2(p)) + 0.0, 6) AS bits FROM p GROUP BY user_id",
    "h12_surface_invariance": "SELECT a.l_linenumber, count(*) AS n, round(avg(CASE WHEN a.l_returnflag = b.l_returnflag THEN 1.0 ELSE 0 END), 6) AS agreement FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = 1 WHERE a.l_linenumber <> 1 GROUP BY 1",
    "h13_module_metrics": """WITH f AS (SELECT event_type, value > 20 AS c, value < 5 AS a, user_id % 3 = 0 AS u FROM events), g AS (SELECT event_type, count(*) AS n, count(*) FILTER (c AND NOT a) AS ok, count(*) FILTER (NOT a) AS ans, count(*) FILTER (a) AS ab, count(*) FILTER (a AND u) AS au, count(*) FILTER (u) AS un, count(*) FILTER (u AND NOT a) AS ua FROM f GROUP BY 1)
SELECT event_type, n, round(ok / n, 6) AS accuracy, round(ok / nullif(ans, 0), 6) AS precision, round(ab / n, 6) AS abstention_rate, round(au / nullif(ab, 0), 6) AS abstention_precision, round(au / nullif(un, 0), 6) AS abstention_recall, ua AS unsupported_accepts FROM g""",
    "h14_condition_contrasts": f"WITH {_EFFECT.format(t='click', c='view')} SELECT count(*) AS units, round(avg(transfer - control), 6) AS difference, round(avg(1 - abs(transfer - control) / (1 + abs(transfer) + abs(control))), 6) AS stability, round(avg(CASE WHEN transfer > control THEN 1.0 ELSE 0 END), 6) AS win_rate FROM ef",
    "h15_family_accuracy": "SELECT l_returnflag, count(*) AS n, round(avg(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0 END), 6) AS accuracy, grouping(l_returnflag) AS overall FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())",
    "h17_length_parity": """WITH t AS (SELECT conv_id, turn, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n FROM conversations), f AS (SELECT conv_id, min(turn) AS t FROM t GROUP BY 1)
SELECT f.conv_id, CAST((SELECT max(n) FROM t WHERE t.conv_id = f.conv_id AND turn = f.t + 1) - (SELECT max(n) FROM t WHERE t.conv_id = f.conv_id AND turn = f.t) AS BIGINT) AS difference FROM f WHERE EXISTS (SELECT 1 FROM t WHERE t.conv_id = f.conv_id AND turn = f.t + 1)""",
    "h18_expand_units": "SELECT o_orderkey, kind, sign FROM orders, (VALUES ('forward', 1), ('reverse', -1), ('negative', 0)) k(kind, sign)",
    "h19_rotate_options": """WITH n AS (SELECT count(*) AS n FROM customer), c AS (SELECT c_custkey, c_name, c_custkey % n AS i, n FROM customer, n), o AS (SELECT a.c_custkey, a.i, b.c_name, (k + a.i) % 4 AS p FROM c a, (VALUES (0, 0), (1, 1), (2, 5), (3, 11)) f(k, d) JOIN c b ON (a.i + d) % a.n = b.i)
SELECT c_custkey, string_agg(c_name, '|' ORDER BY p) AS options, any_value(i) % 4 AS answer FROM o GROUP BY c_custkey""",
    "h20_shard_plan": "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS shard FROM documents",
}
