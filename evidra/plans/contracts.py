"""Prompt, span and contract queries on conversations, documents, embeddings, customer, orders and lineitem."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.operators import contracts as C
from evidra.plans import audit, baselines
from evidra.plans.tables import rounded, table
from evidra.plans.vectors import _ISSUE

MODES, REVIEWERS, KINDS = ["BUILDING", "MACHINERY"], ["1", "2", "3"], ["F", "O", "X"]


def b11_render_prompt(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(C.render_prompt("[{role}] {text} ({turn})", role=F.col("role"), text=F.col("text"), turn=F.col("turn"))).alias("prompt"))


def _tokens(spark, sf_dir):
    """Pieces of five characters as tokens: the first is special, those after the 200th aren't attended."""
    n = F.col("n")  # counted once for each text, not for each of its tokens
    each = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(n / 5).cast("int") - 1)), lambda i: F.struct((i * 5).alias("begin"), F.least(i * 5 + 5, n).alias("end"), (i < 200).alias("attended"), (i == 0).alias("special")))
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n")).where("n > 0").select("doc_id", each.alias("tokens"))


def b14_span_tokens(spark, sf_dir):
    at = C.span_tokens(F.col("tokens"), F.lit(3), F.lit(22))
    return _tokens(spark, sf_dir).select("doc_id", F.size(at).alias("n"), F.array_max(at).alias("site"), F.array_min(at).alias("first"))


def b15_span_mean(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("record"), (F.col("vec_id") % 10).alias("position"), "embedding")
    return rounded(C.span_mean(rows, "record", "position", "embedding", 2, 5), "mean", digits=5)


def b16_last_token(spark, sf_dir):
    return _tokens(spark, sf_dir).select("doc_id", C.last_token(F.col("tokens")).alias("last"))


def c19_answer_leak(spark, sf_dir):
    kept = F.filter(F.array(F.col("c_name"), F.col("c_nationkey").cast("string"), F.coalesce("c_mktsegment", F.lit("")), F.when(F.col("c_custkey") % 17 != 0, F.lit("x"))), lambda x: x.isNotNull())
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", kept.alias("candidates"), F.col("c_acctbal").alias("answer_hint"))
    return C.answer_leak(rows.unionAll(rows.where("c_custkey % 61 = 0")), "c_custkey", "candidates", "c_mktsegment", MODES, ["answer", "gold"])


def c19_review_packets(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return C.review_packets(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey")), rows.unionAll(rows.where("l_orderkey % 53 = 0")), "l_orderkey", "l_linenumber", REVIEWERS)


def c19_stratum_pairing(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    side = lambda p, keep: orders.where(keep).select(F.concat(F.lit(p), F.col("o_orderkey").cast("string")).alias("item"), (F.col("o_orderkey") % 29 != 0).alias("pooled"), F.col("o_orderpriority").alias("text"), F.col("o_orderstatus").alias("kind"))
    rows = side("B-", "o_orderkey % 7 <> 0").unionAll(side("E-", "o_orderkey % 11 <> 0"))
    again = rows.where("item like '%5'").withColumn("text", F.lit("other"))
    return C.stratum_pairing(rows.unionAll(again), "item", "B-", "E-", "pooled", "text", "kind", KINDS)


def h21_run_comparison(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    runs = {f"flag-{k}": rows.where(F.col("l_returnflag") == k).groupBy("l_linestatus").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("mean")) for k in ("A", "N", "R")}
    return rounded(C.run_comparison(runs, F.col("n") <= 2000), "mean")


def _ratio(rows):
    """A scorer for the query: the logarithm of a balance, which isn't finite for negative ones."""
    with np.errstate(all="ignore"):
        return np.log(rows["c_acctbal"].to_numpy(float))


def h22_injected_scorer(spark, sf_dir):
    return rounded(C.injected_scores(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").cast("double").alias("c_acctbal")), "c_custkey", ["c_acctbal"], _ratio), "score")


REUSE = ("c15_cross_reuse", "c15_exact_text_reuse", "c15_partition_overlap", "c15_orphans")


def c24_preoutput_audit(spark, sf_dir):
    """Findings of each reuse check and views at risk of shortcuts, with one status: failed (any reuse), non_interpretable (a view at risk) or pass."""
    parts = [audit.QUERIES[k](spark, sf_dir).agg(F.count("*").alias("findings")).select(F.lit(k).alias("check"), "findings") for k in REUSE]
    parts.append(baselines.f16_shortcut_decision(spark, sf_dir).agg(F.count_if("risk").alias("findings")).select(F.lit("shortcut_views").alias("check"), "findings"))
    rows = reduce(DataFrame.unionByName, parts)
    reuse, risk = F.sum(F.when(F.col("check") != "shortcut_views", F.col("findings"))), F.sum(F.when(F.col("check") == "shortcut_views", F.col("findings")))
    status = rows.agg(F.when(reuse > 0, "failed").when(risk > 0, "non_interpretable").otherwise("pass").alias("status"))
    return rows.crossJoin(F.broadcast(status))  # one row


QUERIES = {f.__name__: f for f in (c24_preoutput_audit, b11_render_prompt, b14_span_tokens, b15_span_mean, b16_last_token, c19_answer_leak, c19_review_packets, c19_stratum_pairing, h21_run_comparison, h22_injected_scorer)}

_TOK = "tok AS (SELECT doc_id, length(text) AS n, CAST(ceil(length(text) / 5) AS BIGINT) AS k FROM documents WHERE length(text) > 0), p AS (SELECT doc_id, i FROM (SELECT doc_id, n, unnest(range(k)) AS i FROM tok) WHERE i > 0 AND i < 200"


def _sql(check: str, parts: list[str]) -> str:
    return f"SELECT {_ISSUE} FROM (SELECT '{check}' AS \"check\", * FROM (" + " UNION ALL ".join(parts) + "))"


_COUNTS = " UNION ALL ".join([*(f"SELECT '{k}' AS \"check\", (SELECT count(*) FROM ({audit.ORACLE_SQL[k]})) AS findings" for k in REUSE), f"SELECT 'shortcut_views', (SELECT count(*) FILTER (risk) FROM ({baselines.ORACLE_SQL['f16_shortcut_decision']}))"])

ORACLE_SQL = {
    "c24_preoutput_audit": f"WITH r AS ({_COUNTS}) SELECT *, CASE WHEN (SELECT sum(findings) FROM r WHERE \"check\" <> 'shortcut_views') > 0 THEN 'failed' WHEN (SELECT sum(findings) FROM r WHERE \"check\" = 'shortcut_views') > 0 THEN 'non_interpretable' ELSE 'pass' END AS status FROM r",
    "b11_render_prompt": "SELECT conv_id, turn, md5('[' || coalesce(role, '') || '] ' || coalesce(text, '') || ' (' || coalesce(CAST(turn AS VARCHAR), '') || ')') AS prompt FROM conversations",
    "b14_span_tokens": f"WITH {_TOK} AND i * 5 < 22 AND least(i * 5 + 5, (SELECT n FROM tok t WHERE t.doc_id = x.doc_id)) > 3), g AS (SELECT doc_id, count(*) AS n, max(i) AS site, min(i) AS first FROM p GROUP BY doc_id) SELECT tok.doc_id, coalesce(g.n, 0) AS n, site, first FROM tok LEFT JOIN g ON g.doc_id = tok.doc_id".replace("FROM tok) WHERE", "FROM tok) x WHERE"),
    "b15_span_mean": "SELECT record, CAST(i AS INTEGER) AS i, round(avg(x), 5) AS mean FROM (SELECT vec_id // 10 AS record, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings WHERE vec_id % 10 BETWEEN 2 AND 5) GROUP BY ALL",
    "b16_last_token": f"WITH {_TOK}) SELECT tok.doc_id, max(i) AS last FROM tok LEFT JOIN p ON p.doc_id = tok.doc_id GROUP BY tok.doc_id",
    "c19_answer_leak": "WITH r AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 17 <> 0 THEN 4 ELSE 3 END AS n FROM customer), a AS (SELECT * FROM r UNION ALL SELECT * FROM r WHERE c_custkey % 61 = 0) "
    + _sql("answer_leak", ["SELECT 'answer_field' AS code, 'answer_hint' AS field, NULL AS entity_id, NULL AS other_id, NULL AS detail", "SELECT 'candidate_count', 'candidates', c_custkey, NULL, CAST(n AS VARCHAR) FROM a WHERE n <> 4", "SELECT 'repeated_id', 'c_custkey', c_custkey, NULL, CAST(count(*) AS VARCHAR) FROM a GROUP BY c_custkey HAVING count(*) > 1", f"SELECT 'unknown_mode', 'c_mktsegment', c_custkey, NULL, c_mktsegment FROM a WHERE c_mktsegment NOT IN {tuple(MODES)}"]),
    "c19_review_packets": "WITH r AS (SELECT l_orderkey, l_linenumber FROM lineitem), a AS (SELECT * FROM r UNION ALL SELECT * FROM r WHERE l_orderkey % 53 = 0) "
    + _sql("review_packets", [f"SELECT 'missing_review' AS code, 'l_linenumber' AS field, o_orderkey AS entity_id, w AS other_id, NULL AS detail FROM orders, (SELECT unnest({REVIEWERS}) AS w) WHERE NOT EXISTS (SELECT 1 FROM a WHERE l_orderkey = o_orderkey AND CAST(l_linenumber AS VARCHAR) = w)", "SELECT 'repeated_review', 'l_linenumber', l_orderkey, CAST(l_linenumber AS VARCHAR), count(*) FROM a GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1", "SELECT DISTINCT 'unknown_reviewer', 'l_linenumber', l_linenumber, NULL, NULL FROM a WHERE l_linenumber > 3"]),
    "c19_stratum_pairing": "WITH b AS (SELECT 'B-' || o_orderkey AS item, o_orderkey % 29 <> 0 AS pooled, o_orderpriority AS text, o_orderstatus AS kind FROM orders WHERE o_orderkey % 7 <> 0), e AS (SELECT 'E-' || o_orderkey AS item, o_orderkey % 29 <> 0 AS pooled, o_orderpriority AS text, o_orderstatus AS kind FROM orders WHERE o_orderkey % 11 <> 0), r AS (SELECT * FROM b UNION ALL SELECT * FROM e), a AS (SELECT * FROM r UNION ALL SELECT item, pooled, 'other', kind FROM r WHERE item LIKE '%5') "
    + _sql("stratum_pairing", ["SELECT 'no_exposed_item' AS code, 'item' AS field, CAST(o_orderkey AS VARCHAR) AS entity_id, NULL AS other_id, NULL AS detail FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 = 0", "SELECT 'no_blinded_item', 'item', CAST(o_orderkey AS VARCHAR), NULL, NULL FROM orders WHERE o_orderkey % 7 = 0 AND o_orderkey % 11 <> 0", "SELECT 'not_pooled', 'pooled', item, NULL, NULL FROM a WHERE NOT pooled", "SELECT 'transcriptions_differ', 'text', item, NULL, count(DISTINCT text) FROM a GROUP BY item HAVING count(DISTINCT text) > 1", f"SELECT 'missing_kind', 'kind', k, NULL, NULL FROM (SELECT unnest({KINDS}) AS k) WHERE k NOT IN (SELECT kind FROM a)"]),
    "h21_run_comparison": "SELECT 'flag-' || l_returnflag AS run, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS mean, count(*) <= 2000 AS within_ceiling FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY l_returnflag, l_linestatus",
    "h22_injected_scorer": "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(ln(CAST(c_acctbal AS DOUBLE)), 6) END AS score, CASE WHEN c_acctbal > 0 THEN NULL ELSE 'not_finite' END AS code FROM customer",
}
