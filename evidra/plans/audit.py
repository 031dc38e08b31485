"""Audit queries on documents, orders, line items, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidra.functions import text as T
from evidra.operators import audit as A
from evidra.operators.issues import audit_status, row_rules
from evidra.operators.rules import declared_rules
from evidra.plans.tables import CASES, cases, rounded, table

TERMS = ["mit license", "password", "idiot", "all rights reserved"]


def _docs(spark, sf_dir):
    split = F.when(F.col("doc_id") % 3 == 0, "a").when(F.col("doc_id") % 3 == 1, "b").otherwise("c")
    return table(spark, sf_dir, "documents").withColumn("split", split)


def c1_canonical_cases(spark, sf_dir):
    """Case = order, labels = return flags of its line items."""
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return A.canonical_cases(orders, table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag")


def c2_field_rules(spark, sf_dir):
    url = F.col("url")
    rules = [("bad_url", "url", ~url.rlike("^https?://[a-z.]+/")), ("long_url", "url", F.length(url) > 45), ("empty", "html", F.length("html") < 200), ("query", "url", url.contains("?"))]
    return row_rules(table(spark, sf_dir, "pages"), "field_rules", F.col("page_id"), rules)


def c3_duplicate_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return A.duplicate_keys(rows, "key", ["l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate"])


def c4_reference_integrity(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 1000).alias("src"), (F.col("l_partkey") % 1000).alias("dst"))
    return A.reference_integrity(edges, table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0"), "src", "dst", "c_custkey", symmetric=True)


def c4_reference_integrity_all(spark, sf_dir):
    """Line items as references from orders to parts, by their own keys, against all customers."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"))
    return A.reference_integrity(edges, table(spark, sf_dir, "customer"), "src", "dst", "c_custkey", symmetric=True)


def c5_exact_duplicates(spark, sf_dir):
    return A.exact_duplicates(_docs(spark, sf_dir), "doc_id", "split", T.norm_dataset(F.col("text")))


def c6_forbidden_terms(spark, sf_dir):
    return A.forbidden_terms(_docs(spark, sf_dir), "doc_id", "text", TERMS, whole_words=False)


def c6_forbidden_words(spark, sf_dir):
    return A.forbidden_terms(_docs(spark, sf_dir), "doc_id", "text", TERMS, whole_words=True)


def c7_target_gaps(spark, sf_dir):
    plan = spark.createDataFrame([("train", 400, None), ("dev", None, 50), ("sealed", 10, None)], "split string, least int, exact int")
    return A.target_gaps(cases(spark, sf_dir), "split", plan)


def c8_source_policy(spark, sf_dir):
    return rounded(A.source_policy(_docs(spark, sf_dir), "source", [f"src{i}" for i in range(18)], ["src3", "src4"], 0.2), "share")


def c9_provenance_rules(spark, sf_dir):
    date, url = F.col("o_orderdate"), F.col("o_orderpriority")
    rules = [("bad_date", "o_orderdate", date.isNull() | (date < F.lit("1993-01-01").cast("timestamp"))), ("not_allowed", "o_orderpriority", ~url.rlike("^[1-4]-")), ("not_positive", "o_totalprice", F.col("o_totalprice") < 2000)]
    return row_rules(table(spark, sf_dir, "orders"), "provenance", F.col("o_orderkey"), rules)


def c10_fingerprint_leakage(spark, sf_dir):
    return A.fingerprint_leakage(_docs(spark, sf_dir), "split", ["source", "lang", "n_chars"])


def c11_distributions(spark, sf_dir):
    return A.distributions(cases(spark, sf_dir), ["split", "domain", "label", "family"])


def c12_cell_minima(spark, sf_dir):
    return A.cell_minima(cases(spark, sf_dir), "label", "family", 2)


def c12_split_digest(spark, sf_dir):
    return A.table_digest(cases(spark, sf_dir), ["case_id"], ["split"])


def c12_snapshot_diff(spark, sf_dir):
    """Two snapshots of documents by source: all rows, and those with an even id."""
    docs = _docs(spark, sf_dir)
    return A.snapshot_diff(A.table_digest(docs, ["doc_id", "lang"], ["source"]), A.table_digest(docs.where("doc_id % 40 <> 3"), ["doc_id", "lang"], ["source"]), "source", ["rows", "digest"])


def c13_snapshot_agreement(spark, sf_dir):
    """Mean over units of exact agreement; units with fewer than three raters count 0 and add nothing to the pool."""
    from evidra.operators.agreement import unit_counts

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_linenumber").alias("rater"), F.col("l_returnflag").alias("label"))
    raters = rows.groupBy("unit").agg(F.count_distinct("rater").alias("raters"))
    got = raters.join(unit_counts(rows, "unit", "label"), "unit").withColumn("enough", F.col("raters") >= 3)
    one = F.when(F.col("enough"), F.col("matches") / F.expr("nullif(pairs, 0)")).otherwise(0.0)
    out = got.agg(F.count("*").alias("units"), F.count_if("enough").alias("enough"), F.avg(one).alias("mean"), (F.sum(F.when(F.col("enough"), F.col("matches"))) / F.sum(F.when(F.col("enough"), F.col("pairs")))).alias("pooled"))
    return rounded(out, "mean", "pooled")


def c14_rule_set(spark, sf_dir):
    """Rules on the JSON column of events, compiled to predicates over one parse."""
    k, raw = F.get_json_object("props", "$.k"), F.col("props")
    rules = [("not_json", "props", raw.isNull() | F.get_json_object("props", "$").isNull()), ("required", "k", k.isNull()), ("maximum", "k", F.coalesce(k.try_cast("double") > 90, F.lit(False))), ("extra", "props", F.coalesce(F.size(F.json_object_keys("props")) > 1, F.lit(False)))]
    return row_rules(table(spark, sf_dir, "events"), "rule_set", F.col("event_id"), rules)


#: Rules of the query on orders.
ORDER_RULES = {
    "type": "object",
    "required": ["id", "status", "total"],
    "additionalProperties": False,
    "properties": {
        "id": {"type": "integer"},
        "status": {"enum": ["F", "O"]},
        "priority": {"type": "string", "pattern": "^[1-4]-"},
        "words": {"items": {"type": "string", "maxLength": 8}, "maxItems": 2},
        "total": {"$ref": "#/$defs/amount"},
    },
    "if": {"properties": {"status": {"const": "F"}}},
    "then": {"properties": {"total": {"maximum": 300000}}},
    "$defs": {"amount": {"type": "number", "minimum": 5000, "exclusiveMaximum": 400000}},
}


def c14_declared_rules(spark, sf_dir):
    """A tree of declared rules on the orders as JSON, their priorities' words as a list."""
    words = F.split("o_orderpriority", "[- ]")
    fields = (F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), words.alias("words"), F.col("o_totalprice").alias("total"))
    return declared_rules(table(spark, sf_dir, "orders"), "declared_rules", F.col("o_orderkey"), F.to_json(F.struct(*fields)), ORDER_RULES)


def c15_cross_reuse(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return A.cross_reuse(docs.where("split = 'a'"), docs.where("split = 'b'"), ["source", "lang", "text"])


def c15_exact_text_reuse(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", "split", T.norm_candidate(F.col("text")).alias("norm"))
    other = docs.where("split = 'b'").select(F.col("norm").alias("n"), F.col("doc_id").alias("source_id")).groupBy("n").agg(F.count("*").alias("sources"), F.min("source_id").alias("first_source"))
    return docs.where("split = 'a'").join(other, F.col("norm") == F.col("n")).select("doc_id", "sources", "first_source")


def c15_orphans(spark, sf_dir):
    return A.orphans(table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey")


def c15_partition_overlap(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return docs.where("split = 'a'").select("source", "n_chars").intersect(docs.where("split = 'c'").select("source", "n_chars"))


def c17_candidate_balance(spark, sf_dir):
    got = cases(spark, sf_dir).groupBy("domain", "label").agg(F.count("*").alias("n")).groupBy("domain").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    return got.withColumn("balanced", F.col("least") == F.col("most"))


def c17_lead_profile(spark, sf_dir):
    return A.lead_profile(cases(spark, sf_dir), "label", T.lead_word(F.col("text")))


def c17_pair_contract(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderkey") + 7).otherwise(F.col("o_orderkey") + F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1)).alias("mate"), "o_orderpriority", "o_orderstatus")
    return A.pair_contract(rows, "o_orderkey", "mate", "o_orderpriority", "o_orderstatus")


def c17_evaluability(spark, sf_dir):
    return A.evaluability(cases(spark, sf_dir), ["domain", "family", "label", "toxic"])


def c18_paired_join(spark, sf_dir):
    return A.family_contract(cases(spark, sf_dir), "family", "split", "label", "domain", 2)


def c19_condition_completeness(spark, sf_dir):
    return A.condition_completeness(table(spark, sf_dir, "conversations"), "conv_id", "role", ["user", "assistant", "system"])


def c19_key_coverage(spark, sf_dir):
    """Labels as the key of documents: documents without one, keys without a document, repeated keys."""
    key = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count("*").alias("n"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(True).alias("there"))
    code = F.when(F.col("n").isNull(), "no_key").when(F.col("there").isNull(), "no_row").when(F.col("n") > 1, "repeated_key")
    return docs.join(key, "doc_id", "full_outer").groupBy(F.coalesce(code, F.lit("ok")).alias("code")).agg(F.count("*").alias("n"))


def c19_position_balance(spark, sf_dir):
    return A.position_balance(table(spark, sf_dir, "orders").withColumn("position", F.col("o_orderkey") % 4), "o_orderstatus", "position")


def c19_freeze_key(spark, sf_dir):
    return A.freeze_key(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_returnflag", "l_linestatus"])


def c20_evidence_requirements(spark, sf_dir):
    claims = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("claim"), "l_returnflag", (F.col("l_quantity") > 10).alias("size"), (F.col("l_discount") > 0.02).alias("deal"), (F.col("l_tax") > 0.04).alias("tax"))
    need = spark.createDataFrame([("A", "size"), ("A", "deal"), ("R", "size"), ("R", "deal"), ("R", "tax"), ("N", "tax")], "level string, axis string")
    return A.evidence_requirements(claims, need, "claim", "l_returnflag")


def c21_remap_labels(spark, sf_dir):
    return A.remap_labels(_docs(spark, sf_dir), "source", "src1", "S", "doc_id")


def c22_readiness_rollup(spark, sf_dir):
    rows = cases(spark, sf_dir)
    cells = A.cell_minima(rows, "label", "domain", 3)
    return A.readiness([("cells", cells.agg(F.bool_and("ok").alias("passed"))), ("labels", rows.agg((F.count_distinct("label") >= 2).alias("passed"))), ("texts", rows.agg((F.count_if(F.col("text").isNull()) == 0).alias("passed")))])


def c23_audit_status(spark, sf_dir):
    found = c2_field_rules(spark, sf_dir).unionByName(c6_forbidden_terms(spark, sf_dir))
    return audit_status(found, ["bad_", "empty"], ["query", "long_"])


def a5_fingerprint_table(spark, sf_dir):
    return A.table_digest(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


QUERIES = {k: v for k, v in globals().items() if k[0] in "ac" and k[1].isdigit()}

_DOCS = "docs AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS split FROM documents)"
_ISSUE = '"check", code, field, CAST(entity_id AS VARCHAR) AS entity_id, CAST(other_id AS VARCHAR) AS other_id, CAST(detail AS VARCHAR) AS detail, \'error\' AS severity'
_LANES = ", ".join(f"CAST(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)) AS BIGINT) AS l{i}" for i in range(8))


def _rules(table_: str, check: str, entity: str, rules: list[tuple[str, str, str]]) -> str:
    each = " UNION ALL ".join(f"SELECT '{check}' AS \"check\", '{c}' AS code, '{f}' AS field, {entity} AS entity_id, NULL AS other_id, NULL AS detail FROM {table_} WHERE coalesce({bad}, true)" for c, f, bad in rules)
    return f"SELECT {_ISSUE} FROM ({each})"


def _digest(source: str, columns: list[str], by: str = "") -> str:
    row = " || '\x1f' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in columns)
    group = f"{by}, " if by else ""
    return f"""SELECT {group}rows, sha256(rows || ':' || {" || ':' || ".join(f"l{i}" for i in range(8))}) AS digest FROM (SELECT {group}count(*) AS rows, {_LANES} FROM (SELECT {group}sha256({row}) AS h FROM {source}) GROUP BY ALL)"""


_FIELD_RULES = _rules("pages", "field_rules", "page_id", [("bad_url", "url", "NOT regexp_matches(url, '^https?://[a-z.]+/')"), ("long_url", "url", "length(url) > 45"), ("empty", "html", "length(html) < 200"), ("query", "url", "contains(url, '?')")])


def _terms(test: str) -> str:
    each = " UNION ALL ".join(f"SELECT 'forbidden_terms' AS \"check\", 'forbidden_term' AS code, 'text' AS field, doc_id AS entity_id, NULL AS other_id, '{t}' AS detail FROM documents WHERE {test.format(t=t)}" for t in TERMS)
    return f"SELECT {_ISSUE} FROM ({each})"


ORACLE_SQL = {
    "c1_canonical_cases": """WITH g AS (SELECT l_orderkey, count(DISTINCT lower(l_returnflag)) AS k, min(lower(l_returnflag)) AS one FROM lineitem GROUP BY 1)
SELECT o_orderkey AS l_orderkey, CASE WHEN k = 1 THEN one END AS label, CASE WHEN k IS NULL THEN 'invalid_labels' WHEN k > 1 THEN 'non_canonical_labels' END AS issue FROM orders LEFT JOIN g ON l_orderkey = o_orderkey""",
    "c2_field_rules": _FIELD_RULES,
    "c3_duplicate_keys": f"""SELECT {_ISSUE} FROM (SELECT 'duplicate_keys' AS "check", 'duplicate_id' AS code, 'key' AS field, l_orderkey || '-' || l_linenumber AS entity_id, NULL AS other_id,
row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS detail FROM lineitem) WHERE CAST(detail AS BIGINT) > 1""",
    "c4_reference_integrity": f"""WITH e AS (SELECT l_orderkey % 1000 AS src, l_partkey % 1000 AS dst FROM lineitem), t AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 7 <> 0), d AS (SELECT DISTINCT src, dst FROM e)
SELECT {_ISSUE} FROM (SELECT 'reference_integrity' AS "check", 'dst' AS field, * FROM (
SELECT 'self_reference' AS code, src AS entity_id, dst AS other_id, NULL AS detail FROM e WHERE src = dst UNION ALL SELECT 'repeated_reference', src, dst, count(*) FROM e GROUP BY src, dst HAVING count(*) > 1
UNION ALL SELECT 'missing_target', src, dst, NULL FROM d WHERE dst NOT IN (SELECT k FROM t) UNION ALL SELECT 'asymmetric_reference', src, dst, NULL FROM d WHERE dst IN (SELECT k FROM t) AND NOT EXISTS (SELECT 1 FROM d r WHERE r.src = d.dst AND r.dst = d.src)))""",
    "c4_reference_integrity_all": f"""WITH e AS (SELECT l_orderkey AS src, l_partkey AS dst FROM lineitem), t AS (SELECT c_custkey AS k FROM customer), d AS (SELECT DISTINCT src, dst FROM e)
SELECT {_ISSUE} FROM (SELECT 'reference_integrity' AS "check", 'dst' AS field, * FROM (
SELECT 'self_reference' AS code, src AS entity_id, dst AS other_id, NULL AS detail FROM e WHERE src = dst UNION ALL SELECT 'repeated_reference', src, dst, count(*) FROM e GROUP BY src, dst HAVING count(*) > 1
UNION ALL SELECT 'missing_target', src, dst, NULL FROM d WHERE dst NOT IN (SELECT k FROM t) UNION ALL SELECT 'asymmetric_reference', src, dst, NULL FROM d WHERE dst IN (SELECT k FROM t) AND NOT EXISTS (SELECT 1 FROM d r WHERE r.src = d.dst AND r.dst = d.src)))""",
    "c5_exact_duplicates": f"""WITH {_DOCS}, s AS (SELECT sha256(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS signature, split, doc_id FROM docs), g AS (SELECT signature, split, count(*) AS n, min(doc_id) AS f FROM s GROUP BY ALL)
SELECT signature, min(f) AS first_key, CAST(sum(n) AS BIGINT) AS rows, count(*) AS splits, CAST(sum(n * (n - 1) / 2) AS BIGINT) AS within_pairs, CAST((sum(n) * sum(n) - sum(n * n)) / 2 AS BIGINT) AS cross_pairs,
CASE WHEN count(*) > 1 THEN 'cross_split_leakage' ELSE 'duplicate_signature' END AS code FROM g GROUP BY signature HAVING sum(n) > 1""",
    "c6_forbidden_terms": _terms("contains(lower(text), '{t}')"),
    "c6_forbidden_words": _terms("regexp_matches(lower(text), '(^|[^a-z0-9]){t}($|[^a-z0-9])')"),
    "c7_target_gaps": f"""WITH {CASES}, p(split, least, exact) AS (VALUES ('train', 400, NULL), ('dev', NULL, 50), ('sealed', 10, NULL)), g AS (SELECT p.*, (SELECT count(*) FROM cases c WHERE c.split = p.split) AS rows FROM p)
SELECT split, rows, least, exact, greatest(coalesce(least - rows, 0), coalesce(abs(exact - rows), 0), 0) AS gap FROM g""",
    "c8_source_policy": """WITH g AS (SELECT count(source) AS sourced, count(*) FILTER (source IN ('src18', 'src19')) AS not_allowed, count(*) FILTER (source IN ('src3', 'src4')) AS generated FROM documents)
SELECT *, round(generated / sourced, 6) AS share, not_allowed = 0 AND generated / sourced <= 0.2 AS ok FROM g""",
    "c9_provenance_rules": _rules("orders", "provenance", "o_orderkey", [("bad_date", "o_orderdate", "o_orderdate IS NULL OR o_orderdate < TIMESTAMP '1993-01-01'"), ("not_allowed", "o_orderpriority", "NOT regexp_matches(o_orderpriority, '^[1-4]-')"), ("not_positive", "o_totalprice", "o_totalprice < 2000")]),
    "c10_fingerprint_leakage": f"""WITH {_DOCS} SELECT sha256(coalesce(source, '') || '\x1f' || coalesce(lang, '') || '\x1f' || coalesce(CAST(n_chars AS VARCHAR), '')) AS fingerprint, count(*) AS rows, count(DISTINCT split) AS splits FROM docs GROUP BY 1 HAVING count(DISTINCT split) > 1""",
    "c11_distributions": f"WITH {CASES} " + " UNION ALL ".join(f"SELECT '{c}' AS field, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM cases GROUP BY {c}" for c in ("split", "domain", "label", "family")),
    "c12_cell_minima": f"WITH {CASES}, g AS (SELECT l.label, f.family, (SELECT count(*) FROM cases c WHERE c.label = l.label AND c.family = f.family) AS n FROM (SELECT DISTINCT label FROM cases) l, (SELECT DISTINCT family FROM cases) f) SELECT label, family, n, n >= 2 AS ok FROM g",
    "c12_split_digest": f"WITH {CASES} {_digest('cases', ['case_id'], 'split')}",
    "c12_snapshot_diff": f"""WITH a AS ({_digest('documents', ['doc_id', 'lang'], 'source')}), b AS ({_digest('(SELECT * FROM documents WHERE doc_id % 40 <> 3)', ['doc_id', 'lang'], 'source')})
SELECT coalesce(a.source, b.source) AS source, CASE WHEN a.source IS NULL THEN 'added' WHEN b.source IS NULL THEN 'removed' ELSE 'changed' END AS code FROM a FULL JOIN b ON a.source = b.source WHERE a.digest IS DISTINCT FROM b.digest""",
    "c13_snapshot_agreement": """WITH p AS (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL), u AS (SELECT l_orderkey, sum(n) AS m, sum(n * (n - 1)) / 2 AS mt FROM p GROUP BY 1), r AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS k FROM lineitem GROUP BY 1)
SELECT count(*) AS units, count(*) FILTER (k >= 3) AS enough, round(avg(CASE WHEN k >= 3 THEN mt / (m * (m - 1) / 2) ELSE 0 END), 6) AS mean, round(sum(mt) FILTER (k >= 3) / sum(m * (m - 1) / 2) FILTER (k >= 3), 6) AS pooled FROM u JOIN r USING (l_orderkey)""",
    "c14_declared_rules": """WITH o AS (SELECT *, regexp_split_to_array(o_orderpriority, '[- ]') AS w FROM orders), e AS (
SELECT o_orderkey AS k, 'enum' AS code, '$.status' AS field FROM o WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL
SELECT o_orderkey, 'required', '$.status' FROM o WHERE o_orderstatus IS NULL UNION ALL
SELECT o_orderkey, 'required', '$.total' FROM o WHERE o_totalprice IS NULL UNION ALL
SELECT o_orderkey, 'pattern', '$.priority' FROM o WHERE NOT regexp_matches(o_orderpriority, '^[1-4]-') UNION ALL
SELECT o_orderkey, 'maxItems', '$.words' FROM o WHERE len(w) > 2 UNION ALL
SELECT o_orderkey, 'maxLength', '$.words[' || i || ']' FROM (SELECT o_orderkey, unnest(w) AS x, unnest(range(len(w))) AS i FROM o) WHERE length(x) > 8 UNION ALL
SELECT o_orderkey, 'minimum', '$.total' FROM o WHERE o_totalprice < 5000 UNION ALL
SELECT o_orderkey, 'exclusiveMaximum', '$.total' FROM o WHERE o_totalprice >= 400000 UNION ALL
SELECT o_orderkey, 'maximum', '$.total' FROM o WHERE (o_orderstatus IS NULL OR o_orderstatus = 'F') AND o_totalprice > 300000)
SELECT 'declared_rules' AS "check", code, field, CAST(k AS VARCHAR) AS entity_id, CAST(NULL AS VARCHAR) AS other_id, CAST(NULL AS VARCHAR) AS detail, 'error' AS severity FROM e""",
    "c14_rule_set": _rules("events", "rule_set", "event_id", [("not_json", "props", "props IS NULL OR NOT json_valid(props)"), ("required", "k", "props ->> '$.k' IS NULL"), ("maximum", "k", "coalesce(try_cast(props ->> '$.k' AS DOUBLE) > 90, false)"), ("extra", "props", "coalesce(len(json_keys(props)) > 1, false)")]),
    "c15_cross_reuse": f"WITH {_DOCS} " + " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) AS shared FROM (SELECT {c} FROM docs WHERE split = 'a' INTERSECT SELECT {c} FROM docs WHERE split = 'b')" for c in ("source", "lang", "text")),
    "c15_exact_text_reuse": f"""WITH {_DOCS}, n AS (SELECT doc_id, split, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g'), '[^a-z0-9 ]+', ' ', 'g')) AS norm FROM docs)
SELECT a.doc_id, count(*) AS sources, min(b.doc_id) AS first_source FROM n a JOIN n b ON a.norm = b.norm WHERE a.split = 'a' AND b.split = 'b' GROUP BY a.doc_id""",
    "c15_orphans": f"""WITH c AS (SELECT * FROM customer WHERE c_custkey % 5 <> 0) SELECT {_ISSUE} FROM (SELECT 'orphans' AS "check", 'without_target' AS code, 'c_custkey' AS field, c_custkey AS entity_id, NULL AS other_id, NULL AS detail FROM c WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'orphans', 'without_case', 'o_custkey', o_custkey, NULL, NULL FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM c))""",
    "c15_partition_overlap": f"WITH {_DOCS} SELECT source, n_chars FROM docs WHERE split = 'a' INTERSECT SELECT source, n_chars FROM docs WHERE split = 'c'",
    "c17_candidate_balance": f"WITH {CASES}, g AS (SELECT domain, label, count(*) AS n FROM cases GROUP BY ALL) SELECT domain, min(n) AS least, max(n) AS most, min(n) = max(n) AS balanced FROM g GROUP BY domain",
    "c17_lead_profile": f"""WITH {CASES}, e AS (SELECT regexp_extract(lower(text), '[a-z]+') AS lead, label, count(*) AS n FROM cases GROUP BY ALL), g AS (SELECT lead, CASE WHEN count(*) < (SELECT count(DISTINCT label) FROM cases) THEN 0 ELSE min(n) END AS least, max(n) AS most FROM e GROUP BY lead) SELECT * FROM g WHERE least <> most""",
    "c17_pair_contract": f"""WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey + 7 WHEN o_orderkey % 2 = 0 THEN o_orderkey + 1 ELSE o_orderkey - 1 END AS m, o_orderpriority AS d, o_orderstatus AS l FROM orders), j AS (SELECT a.*, b.k AS bk, b.m AS bm, b.d AS bd, b.l AS bl FROM r a LEFT JOIN r b ON a.m = b.k)
SELECT {_ISSUE} FROM (SELECT 'pair_contract' AS "check", 'mate' AS field, k AS entity_id, m AS other_id, NULL AS detail, code FROM (SELECT *, 'missing_match' AS code FROM j WHERE bk IS NULL UNION ALL SELECT *, 'not_reciprocal' FROM j WHERE bm <> k UNION ALL SELECT *, 'other_domain' FROM j WHERE bd <> d UNION ALL SELECT *, 'same_label' FROM j WHERE bl = l))""",
    "c17_evaluability": f"WITH {CASES} " + " UNION ALL ".join(f"SELECT '{c}' AS field, count(DISTINCT {c}) AS \"values\", count(DISTINCT {c}) >= 2 AS evaluable FROM cases" for c in ("domain", "family", "label", "toxic")),
    "c18_paired_join": f"WITH {CASES}, g AS (SELECT family, count(DISTINCT split) AS splits, count(DISTINCT label) AS labels, count(DISTINCT domain) AS domains, count(*) AS rows FROM cases GROUP BY family) SELECT *, splits = 1 AND labels = 2 AND domains = 1 AS ok FROM g",
    "c19_condition_completeness": """WITH q(r) AS (VALUES ('user'), ('assistant'), ('system')), c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT conv_id, (SELECT count(*) FROM conversations x WHERE x.conv_id = c.conv_id AND role IN ('user', 'assistant', 'system')) AS rows,
coalesce((SELECT string_agg(r, ',' ORDER BY r) FROM q WHERE NOT EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND x.role = r)), '') AS missing FROM c""",
    "c19_key_coverage": """WITH k AS (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) SELECT CASE WHEN n IS NULL THEN 'no_key' WHEN d.doc_id IS NULL THEN 'no_row' WHEN n > 1 THEN 'repeated_key' ELSE 'ok' END AS code, count(*) AS n FROM documents d FULL JOIN k ON d.doc_id = k.doc_id GROUP BY 1""",
    "c19_position_balance": "WITH g AS (SELECT o_orderstatus, o_orderkey % 4 AS p, count(*) AS n FROM orders GROUP BY ALL) SELECT o_orderstatus, min(n) AS least, max(n) AS most, min(n) = max(n) AS balanced FROM g GROUP BY 1",
    "c19_freeze_key": "SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag || '|' || l_linestatus) = 1 THEN min(l_returnflag || '|' || l_linestatus) ELSE 'rubric_required' END AS key FROM lineitem GROUP BY 1",
    "c20_evidence_requirements": """SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS claim, array_to_string(list_sort(list_filter(['deal', 'size', 'tax'], lambda a:
  (a = 'deal' AND l_returnflag IN ('A', 'R') AND NOT l_discount > 0.02) OR (a = 'size' AND l_returnflag IN ('A', 'R') AND NOT l_quantity > 10) OR (a = 'tax' AND l_returnflag IN ('N', 'R') AND NOT l_tax > 0.04))), ',') AS missing FROM lineitem""",
    "c21_remap_labels": """WITH r AS (SELECT doc_id, source AS before, CASE WHEN starts_with(source, 'src1') THEN 'S' || substr(source, 5) END AS after FROM documents), k AS (SELECT after, count(DISTINCT before) AS n FROM r GROUP BY after)
SELECT doc_id, before, r.after, CASE WHEN r.after IS NULL THEN 'unexpected' WHEN n > 1 THEN 'collision' END AS code FROM r LEFT JOIN k ON k.after = r.after""",
    "c22_readiness_rollup": f"""WITH {CASES}, g AS (SELECT 'cells' AS gate, (SELECT min(n) >= 3 FROM (SELECT (SELECT count(*) FROM cases c WHERE c.label = l.label AND c.domain = d.domain) AS n FROM (SELECT DISTINCT label FROM cases) l, (SELECT DISTINCT domain FROM cases) d)) AS passed
UNION ALL SELECT 'labels', (SELECT count(DISTINCT label) >= 2 FROM cases) UNION ALL SELECT 'texts', (SELECT count(*) = count(text) FROM cases)) SELECT * FROM g UNION ALL SELECT 'all', bool_and(passed) FROM g""",
    "c23_audit_status": f"""WITH i AS ({_FIELD_RULES} UNION ALL {_terms("contains(lower(text), '{t}')")}), g AS (SELECT count(*) AS issues, count(*) FILTER (starts_with(code, 'bad_') OR starts_with(code, 'empty')) AS s, count(*) FILTER (NOT (starts_with(code, 'query') OR starts_with(code, 'long_'))) AS h FROM i)
SELECT issues, s = 0 AS structural_ok, CASE WHEN issues = 0 THEN 'pass' WHEN h = 0 THEN 'pass_with_gaps' ELSE 'fail' END AS status FROM g""",
    "a5_fingerprint_table": _digest("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]),
}
