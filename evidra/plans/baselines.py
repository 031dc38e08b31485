"""Baseline queries: labelled documents, domain = language, label = quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.functions import text as T
from evidra.operators import baselines as B
from evidra.plans.tables import CASES, cases, rounded

METRICS = ("accuracy", "macro_f1", "balanced_accuracy")
LEXICON = {"en": ["the", "of", "and", "to"], "de": ["der", "die", "und", "den"], "fr": ["le", "la", "les", "des"], "es": ["el", "los", "que", "una"]}


def f1_lodo_folds(spark, sf_dir):
    return B.folds(cases(spark, sf_dir))


def f2_kfold_random(spark, sf_dir):
    return B.kfold_random(cases(spark, sf_dir), 5, "fold-1")


def f3_majority(spark, sf_dir):
    return B.majority(cases(spark, sf_dir))


def f4_keyword(spark, sf_dir):
    return B.keyword(cases(spark, sf_dir))


def f5_naive_bayes(spark, sf_dir):
    return B.naive_bayes(cases(spark, sf_dir))


def f6_char_profile(spark, sf_dir):
    return B.char_profile(cases(spark, sf_dir))


def f7_shape_centroid(spark, sf_dir):
    return B.shape_centroid(cases(spark, sf_dir))


def f8_nearest_centroid(spark, sf_dir):
    return B.nearest_centroid(cases(spark, sf_dir))


def f9_lexicon_argmax(spark, sf_dir):
    return B.lexicon_argmax(cases(spark, sf_dir), LEXICON)


def f10_categorical_lookup(spark, sf_dir):
    return B.categorical_lookup(cases(spark, sf_dir), "family", 3)


def f11_class_metrics(spark, sf_dir):
    return rounded(B.class_metrics(B.naive_bayes(cases(spark, sf_dir))), "accuracy", "macro_f1", "balanced_accuracy")


def f12_fold_mean(spark, sf_dir):
    return rounded(B.fold_mean(B.class_metrics(B.naive_bayes(cases(spark, sf_dir)))), "accuracy", "macro_f1", "balanced_accuracy")


PERMS = {"naive_bayes": 3, "nearest_centroid": 30}


def f13_random_label_control(spark, sf_dir):
    """Metrics of naive Bayes (3 times) and the nearest centroid (30 times) fitted on training labels permuted within domains and tested on the true ones, and if each fold has the support; permutations are columns of one plan."""
    rows, parts = cases(spark, sf_dir), []
    for method, n in PERMS.items():
        said = B.TextFit(rows, perms=B.permuted_labels(rows, n, "perm-1")).predict(method)
        parts.append(B.fold_mean(B.class_metrics(said, ("run", "domain")), ("run",)).withColumn("method", F.lit(method)))
    valid = B.support_check(rows, 10, 3).agg(F.bool_and("valid").alias("valid"))
    return rounded(reduce(DataFrame.unionByName, parts).crossJoin(F.broadcast(valid)), *METRICS)  # one row


def f13_permuted_labels(spark, sf_dir):
    return B.permuted_labels(cases(spark, sf_dir), 3, "perm-1")


def views(rows):
    """The whole text, its first line and what follows it, as tables of cases."""
    first = F.substring_index("text", "\n", 1)
    return {"whole": rows, "first_line": rows.withColumn("text", first), "rest": rows.withColumn("text", F.expr("substring(text, length(substring_index(text, '\\n', 1)) + 2)"))}


def f14_random_partition_control(spark, sf_dir):
    """The nearest centroid under five random folds for each view, and its status by the mean macro F1."""
    parts = []
    for name, rows in views(cases(spark, sf_dir)).items():
        mixed = rows.join(B.kfold_random(rows, 5, "fold-1"), "case_id").select("case_id", F.col("fold").cast("string").alias("domain"), "label", "text")
        parts.append(B.fold_mean(B.class_metrics(B.nearest_centroid(mixed))).withColumn("view", F.lit(name)))
    got = reduce(DataFrame.unionByName, parts)
    return rounded(got.withColumn("status", F.when(F.col("macro_f1") >= 0.7, "risk").otherwise("pass")), *METRICS)


def f15_quantiles_nearest(spark, sf_dir):
    return B.quantiles_nearest(cases(spark, sf_dir).withColumn("n_chars", F.length("text")), "domain", "n_chars")


COUNTED = ("majority", "naive_bayes", "keyword", "nearest_centroid")


def _suite(rows_by_view):
    """Predictions of all methods by view: one table of counts for each view."""
    parts = []
    for view, rows in rows_by_view.items():
        said = B.TextFit(rows).predict(*COUNTED).drop("run").unionByName(B.shape_centroid(rows).withColumn("method", F.lit("shape_centroid")))
        parts.append(said.withColumn("view", F.lit(view)))
    return reduce(DataFrame.unionByName, parts)


def f18_baseline_suite(spark, sf_dir):
    """Per method and view the fold means, from one scoring pass each over the view's counts, beside the field lookup and its status."""
    rows = cases(spark, sf_dir)
    own = {k: v for k, v in views(rows).items() if k != "rest"}
    each = _suite(own).unionByName(B.categorical_lookup(rows, "family", 3).withColumns({"method": F.lit("categorical_lookup"), "view": F.lit("family")}))
    status = B.lookup_status(rows, "family", 3).agg(F.min(F.when(F.col("status") != "evaluable", F.col("status"))).alias("reason"))
    got = B.fold_mean(B.class_metrics(each, ("method", "view", "domain")), ("method", "view")).crossJoin(F.broadcast(status))  # one row
    return rounded(got.withColumn("status", F.when(F.col("view") == "family", F.coalesce("reason", F.lit("evaluable"))).otherwise("evaluable")).drop("reason"), *METRICS)


def f10_lookup_status(spark, sf_dir):
    return B.lookup_status(cases(spark, sf_dir), "family", 3)


def f16_shortcut_decision(spark, sf_dir):
    rows = {k: v for k, v in views(cases(spark, sf_dir)).items() if k != "rest"}
    metrics = B.fold_mean(B.class_metrics(_suite(rows), ("method", "view", "domain")), ("method", "view"))
    return rounded(B.shortcut_decision(metrics, 0.7, 0.05, by=("view",)), "macro_f1", "margin")


def f8_feature_kinds(spark, sf_dir):
    """The nearest centroid by words, characters (3 to 5), shares of the text, a one-hot field and the first line's words."""
    rows = cases(spark, sf_dir)
    kinds = {
        "words": B.nearest_centroid(rows),
        "characters": B.nearest_centroid(rows, chars=(3, 5)),
        "shape": B.dense_centroid(rows, T.shape4(F.col("text")), False),
        "field": B.nearest_centroid(rows.withColumn("text", F.col("family")), F.array("text")),
        "first_line": B.nearest_centroid(views(rows)["first_line"]),
    }
    return reduce(DataFrame.unionByName, (p.withColumn("kind", F.lit(k)) for k, p in kinds.items()))


def f17_surface_control_status(spark, sf_dir):
    """Status of the nearest centroid: its mean macro F1 and its least margin over the majority in any fold, both against their limits."""
    rows = cases(spark, sf_dir)
    own = B.class_metrics(B.nearest_centroid(rows)).select("domain", "macro_f1")
    base = B.class_metrics(B.majority(rows)).select("domain", F.col("macro_f1").alias("base"))
    got = own.join(base, "domain").agg(F.avg("macro_f1").alias("macro_f1"), F.min(F.col("macro_f1") - F.col("base")).alias("least_margin"))
    return rounded(got.withColumn("status", F.when((F.col("macro_f1") >= 0.7) & (F.col("least_margin") >= 0.05), "risk").otherwise("pass")), "macro_f1", "least_margin")


def f19_support_check(spark, sf_dir):
    return B.support_check(cases(spark, sf_dir), 10, 3)


QUERIES = {f.__name__: f for f in (f1_lodo_folds, f2_kfold_random, f3_majority, f4_keyword, f5_naive_bayes, f6_char_profile, f7_shape_centroid, f8_nearest_centroid, f8_feature_kinds, f9_lexicon_argmax, f10_categorical_lookup, f10_lookup_status, f11_class_metrics, f12_fold_mean, f13_random_label_control, f13_permuted_labels, f14_random_partition_control, f15_quantiles_nearest, f16_shortcut_decision, f17_surface_control_status, f18_baseline_suite, f19_support_check)}

_K = "case_id, domain, label"
# Every fold is fitted directly on the other domains' rows here.
_WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"


def _grams(low: int, high: int) -> str:
    """Character n-grams of each length, from characters and those that follow them."""
    flat = "SELECT case_id, domain, regexp_replace(lower(text), '\\s+', ' ', 'g') AS t FROM cases WHERE text IS NOT NULL"
    chars = f"SELECT case_id, domain, unnest(string_split(t, '')) AS c, unnest(range(length(t))) AS i FROM ({flat}) WHERE length(t) > 0"
    runs = [f"SELECT case_id, domain, c || {' || '.join(f'lead(c, {k}) OVER w' for k in range(1, n))} AS token FROM ({chars}) WINDOW w AS (PARTITION BY case_id ORDER BY i)" for n in range(low, high + 1)]
    short = [f"SELECT case_id, domain, t AS token FROM ({flat}) WHERE length(t) BETWEEN 1 AND {n - 1}" for n in range(low, high + 1)]
    return "SELECT * FROM (" + " UNION ALL ".join(runs + short) + ") WHERE token IS NOT NULL"


_FOLDS = "folds AS (SELECT DISTINCT domain AS fold FROM cases), train AS (SELECT fold, c.* FROM folds JOIN cases c ON c.domain <> fold)"
_MAJORITY = "maj AS (SELECT fold, label AS predicted FROM (SELECT fold, label, row_number() OVER (PARTITION BY fold ORDER BY count(*) DESC, label) AS k FROM train GROUP BY fold, label) WHERE k = 1)"
_SCORES = {
    "naive_bayes": "ln(cls.n / a) + coalesce(gain, 0) - coalesce(words, 0) * ln(cls.n + v)",
    "keyword": "cls.kinds / a * (1 + coalesce(dot, 0))",
    "nearest_centroid": "2.0 * coalesce(dot, 0) / d - cls.ss / d / d",
    "char_profile": "CASE WHEN dot > 0 THEN dot / sqrt(cls.ss) END",
}


def _fit(x: str, method: str, words: str = _WORDS, source: str = "cases", perms: str = "SELECT 1 AS run, case_id, label FROM cases") -> str:
    """Tables of one direct fit, all ending in ``x``; predictions are ``p{x}`` (run, case_id, domain, label, predicted)."""
    tokens = words if words.startswith("SELECT") else f"SELECT case_id, domain, unnest({words}) AS token FROM {source}"
    other = {"keyword": "words IS NULL", "char_profile": "score IS NULL"}.get(method, "false")
    return f"""lab{x} AS ({perms}), tok{x} AS (SELECT case_id, domain, token, count(*) AS n FROM ({tokens}) GROUP BY ALL),
fit{x} AS (SELECT fold, run, l.label AS class, token, sum(n) AS n FROM folds JOIN tok{x} t ON t.domain <> fold JOIN lab{x} l USING (case_id) GROUP BY ALL),
cls{x} AS (SELECT fold, run, class, sum(n) AS n, count(*) AS kinds, sum(n * n) AS ss FROM fit{x} GROUP BY ALL), tot{x} AS (SELECT fold, run, sum(n) AS a FROM cls{x} GROUP BY ALL), voc{x} AS (SELECT fold, run, count(DISTINCT token) AS v FROM fit{x} GROUP BY ALL),
nd{x} AS (SELECT fold, run, l.label AS class, count(*) AS d FROM folds JOIN {source} c ON c.domain <> fold JOIN lab{x} l USING (case_id) GROUP BY ALL),
hit{x} AS (SELECT t.case_id, run, class, sum(t.n * ln(f.n + 1)) AS gain, sum(t.n * f.n) AS dot FROM tok{x} t JOIN fit{x} f ON f.token = t.token AND f.fold = t.domain GROUP BY ALL), len{x} AS (SELECT case_id, sum(n) AS words FROM tok{x} GROUP BY ALL),
s{x} AS (SELECT cls.run, c.case_id, c.domain, c.label, cls.class, words, {_SCORES[method]} AS score FROM {source} c JOIN cls{x} cls ON cls.fold = c.domain JOIN tot{x} t ON t.fold = cls.fold AND t.run = cls.run JOIN voc{x} v ON v.fold = cls.fold AND v.run = cls.run
  JOIN nd{x} nd ON nd.fold = cls.fold AND nd.run = cls.run AND nd.class = cls.class LEFT JOIN hit{x} h ON h.case_id = c.case_id AND h.run = cls.run AND h.class = cls.class LEFT JOIN len{x} w ON w.case_id = c.case_id),
m{x} AS (SELECT fold, run, class AS most FROM (SELECT *, row_number() OVER (PARTITION BY fold, run ORDER BY d DESC, class) AS k FROM nd{x}) WHERE k = 1),
p{x} AS (SELECT b.run, case_id, domain, label, CASE WHEN {other} THEN most ELSE class END AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY run, case_id ORDER BY round(score, 9) DESC NULLS LAST, class) AS k FROM s{x}) b JOIN m{x} m ON m.fold = domain AND m.run = b.run WHERE k = 1)"""


_BEST = "SELECT case_id, domain, label, class AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(score, 9) DESC, class) AS k FROM s) WHERE k = 1"
_FIRST, _REST = "split_part(text, chr(10), 1)", "substr(text, length(split_part(text, chr(10), 1)) + 2)"
_VIEWS = f"first_line AS (SELECT * REPLACE ({_FIRST} AS text) FROM cases), rest AS (SELECT * REPLACE ({_REST} AS text) FROM cases)"
_PERMS = lambda n: f"SELECT a.perm AS run, b.case_id, a.label FROM (SELECT perm, domain, label, row_number() OVER (PARTITION BY perm, domain ORDER BY md5('perm-1:' || case_id), case_id) AS i FROM cases, (SELECT unnest(range(1, {n + 1})) AS perm)) a JOIN (SELECT perm, domain, case_id, row_number() OVER (PARTITION BY perm, domain ORDER BY md5('perm-1:' || perm || ':' || case_id), case_id) AS j FROM cases, (SELECT unnest(range(1, {n + 1})) AS perm)) b ON a.perm = b.perm AND a.domain = b.domain AND a.i = b.j"
_SUPPORT = """sup AS (SELECT d.domain, l.label, (SELECT count(*) FROM cases c WHERE c.label = l.label AND c.domain <> d.domain) AS tr, (SELECT count(*) FROM cases c WHERE c.label = l.label AND c.domain = d.domain) AS te FROM (SELECT DISTINCT domain FROM cases) d, (SELECT DISTINCT label FROM cases) l)"""


def _shape(x: str, source: str, values: str, n: int, standard: bool) -> str:
    """Tables of nearest class means of statistics; predictions are ``p{x}``."""
    sd = "greatest(1e-9, stddev_pop(x))" if standard else "1.0"
    return f"""w{x} AS (SELECT *, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM {source} WHERE text IS NOT NULL), x{x} AS (SELECT case_id, domain, label, unnest([{values}]::DOUBLE[]) AS x, unnest(range({n})) AS f FROM w{x}),
cm{x} AS (SELECT fold, label AS class, f, avg(x) AS mean FROM folds JOIN x{x} ON domain <> fold GROUP BY ALL), sd{x} AS (SELECT fold, f, {sd} AS sd FROM folds JOIN x{x} ON domain <> fold GROUP BY fold, f),
s{x} AS (SELECT x.case_id, x.domain, x.label, m.class, -sum(((x - mean) / sd) ** 2) AS score FROM x{x} x JOIN cm{x} m ON m.fold = x.domain AND m.f = x.f JOIN sd{x} sd ON sd.fold = x.domain AND sd.f = x.f GROUP BY ALL),
p{x} AS (SELECT case_id, domain, label, class AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(score, 9) DESC, class) AS k FROM s{x}) WHERE k = 1)"""


_SHAPE9 = """length(text) * 1.0, len(t), CASE WHEN len(t) > 0 THEN length(array_to_string(t, '')) / len(t) ELSE 0 END, length(regexp_replace(text, '[^.,;:!?]', '', 'g')), length(regexp_replace(text, '[^,]', '', 'g')), length(regexp_replace(text, '[^;]', '', 'g')),
  length(regexp_replace(text, '[^:]', '', 'g')), length(regexp_replace(text, '[^-]', '', 'g')), length(regexp_replace(text, '[^()]', '', 'g'))"""
_SHAPE4 = """length(text), length(text) / greatest(1, len(list_filter(string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' '), lambda w: w <> ''))),
  length(regexp_replace(text, '[^.,;:!?]', '', 'g')) / greatest(1, length(text)), length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(1, length(text))"""


def _mean_metrics(source: str, by: str) -> str:
    """Fold means of the metrics of predictions (with columns ``by``), as a query."""
    return f"""SELECT {by}, avg(accuracy) AS accuracy, avg(macro_f1) AS macro_f1, avg(balanced_accuracy) AS balanced_accuracy FROM (
  SELECT {by}, domain, sum(tp) / sum(n) AS accuracy, avg(CASE WHEN tp > 0 THEN 2.0 * tp / (n + said) ELSE 0 END) AS macro_f1, avg(CASE WHEN n > 0 THEN 1.0 * tp / n ELSE 0 END) AS balanced_accuracy
  FROM (SELECT {by}, domain, class, count(*) FILTER (p.label = class) AS n, count(*) FILTER (p.predicted = class) AS said, count(*) FILTER (p.label = class AND p.predicted = class) AS tp FROM ({source}) p, (SELECT DISTINCT label AS class FROM cases) GROUP BY ALL) GROUP BY ALL) GROUP BY ALL"""


def _suite_sql(*more: str) -> tuple[str, str]:
    """Tables of the suite's fits and the union of their predictions (method, view)."""
    tables, parts = [], []
    for v, source in enumerate(("cases", "first_line")):
        view = ("whole", "first_line")[v]
        for m in ("naive_bayes", "keyword", "nearest_centroid"):
            tables.append(_fit(f"_{m}{v}", m, source=source))
            parts.append(f"SELECT '{m}' AS method, '{view}' AS view, domain, label, predicted FROM p_{m}{v}")
        tables.append(_shape(f"_shape{v}", source, _SHAPE9, 9, True))
        parts += [f"SELECT 'shape_centroid', '{view}', domain, label, predicted FROM p_shape{v}", f"SELECT 'majority', '{view}', domain, label, predicted FROM cases JOIN maj ON fold = domain"]
    return ", ".join(tables), " UNION ALL ".join([*parts, *more])


_LOOKUP = """g AS (SELECT fold, family, label, count(*) AS n FROM train GROUP BY fold, family, label), tg AS (SELECT *, sum(n) OVER (PARTITION BY fold, family) AS support FROM g),
bg AS (SELECT *, row_number() OVER (PARTITION BY fold, family ORDER BY n DESC, label) AS k FROM tg), lookup AS (SELECT case_id, domain, cases.label, bg.label AS predicted FROM cases LEFT JOIN bg ON fold = domain AND bg.family = cases.family AND k = 1 AND support >= 3)"""
_STATUS = """st AS (SELECT domain, CASE WHEN (SELECT bool_or(family IS NULL OR trim(family) = '') FROM cases) THEN 'blank_value' WHEN (SELECT count(DISTINCT family) FROM cases) < 2 THEN 'one_value' WHEN (SELECT min(n) FROM (SELECT count(*) AS n FROM cases GROUP BY family)) < 3 THEN 'thin_value'
 WHEN bool_or(NOT EXISTS (SELECT 1 FROM cases o WHERE o.family = c.family AND o.domain <> c.domain)) THEN 'unseen_value' ELSE 'evaluable' END AS status FROM cases c GROUP BY domain)"""
_NB = f"{_FOLDS}, {_fit('', 'naive_bayes')}, nb AS (SELECT case_id, domain, label, predicted FROM p)"
_CENTROID = f"{_FOLDS}, {_fit('', 'nearest_centroid')}, nc AS (SELECT case_id, domain, label, predicted FROM p)"


def _metrics(source: str) -> str:
    return f"""SELECT domain, sum(tp) / sum(n) AS accuracy, avg(CASE WHEN tp > 0 THEN 2.0 * tp / (n + said) ELSE 0 END) AS macro_f1, avg(CASE WHEN n > 0 THEN 1.0 * tp / n ELSE 0 END) AS balanced_accuracy FROM (
  SELECT d.domain, l.label, (SELECT count(*) FROM {source} p WHERE p.domain = d.domain AND p.label = l.label) AS n, (SELECT count(*) FROM {source} p WHERE p.domain = d.domain AND p.predicted = l.label) AS said,
         (SELECT count(*) FROM {source} p WHERE p.domain = d.domain AND p.label = l.label AND p.predicted = l.label) AS tp
  FROM (SELECT DISTINCT domain FROM {source}) d, (SELECT DISTINCT label FROM {source}) l) GROUP BY domain"""


_ROUND = "round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(balanced_accuracy, 6) AS balanced_accuracy"

ORACLE_SQL = {
    "f1_lodo_folds": f"WITH {CASES}, t AS (SELECT count(*) AS t FROM cases) SELECT domain, count(*) AS n_test, any_value(t) - count(*) AS n_train FROM cases, t GROUP BY domain HAVING any_value(t) > count(*)",
    "f2_kfold_random": f"WITH {CASES}, r AS (SELECT case_id, row_number() OVER (ORDER BY md5('fold-1:' || case_id), case_id) - 1 AS i, count(*) OVER () AS n FROM cases) SELECT case_id, CAST(least(4, i // (n // 5)) AS INTEGER) AS fold FROM r",
    "f3_majority": f"WITH {CASES}, {_FOLDS}, {_MAJORITY} SELECT {_K}, predicted FROM cases JOIN maj ON fold = domain",
    "f4_keyword": f"WITH {CASES}, {_FOLDS}, {_fit('', 'keyword')} SELECT case_id, domain, label, predicted FROM p",
    "f6_char_profile": f"WITH {CASES}, {_FOLDS}, {_fit('', 'char_profile', _grams(3, 3))} SELECT case_id, domain, label, predicted FROM p",
    "f5_naive_bayes": f"WITH {CASES}, {_NB} SELECT * FROM nb",
    "f7_shape_centroid": f"WITH {CASES}, {_FOLDS}, {_shape('', 'cases', _SHAPE9, 9, True)} SELECT * FROM p",
    "f8_feature_kinds": f"""WITH {CASES}, {_FOLDS}, {_VIEWS}, fields AS (SELECT * REPLACE (family AS text) FROM cases), {_fit('_w', 'nearest_centroid')}, {_fit('_c', 'nearest_centroid', _grams(3, 5))}, {_fit('_f', 'nearest_centroid', '[text]', 'fields')}, {_fit('_l', 'nearest_centroid', source='first_line')}, {_shape('_s', 'cases', _SHAPE4, 4, False)}
SELECT 'words' AS kind, case_id, domain, label, predicted FROM p_w UNION ALL SELECT 'characters', case_id, domain, label, predicted FROM p_c UNION ALL SELECT 'field', case_id, domain, label, predicted FROM p_f UNION ALL SELECT 'first_line', case_id, domain, label, predicted FROM p_l UNION ALL SELECT 'shape', case_id, domain, label, predicted FROM p_s""",
    "f8_nearest_centroid": f"WITH {CASES}, {_CENTROID} SELECT * FROM nc",
    "f9_lexicon_argmax": f"""WITH {CASES}, w AS (SELECT case_id, domain, label, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM cases),
h AS (SELECT *, """ + ", ".join(f"len(list_filter(t, lambda x: x IN {tuple(v)})) AS h_{k}" for k, v in LEXICON.items()) + """ FROM w)
SELECT case_id, domain, label, CASE greatest(h_en, h_de, h_fr, h_es) WHEN h_en THEN 'en' WHEN h_de THEN 'de' WHEN h_fr THEN 'fr' ELSE 'es' END AS predicted FROM h""",
    "f10_categorical_lookup": f"WITH {CASES}, {_FOLDS}, {_LOOKUP} SELECT * FROM lookup",
    "f10_lookup_status": f"WITH {CASES}, {_STATUS} SELECT * FROM st",
    "f11_class_metrics": f"WITH {CASES}, {_NB}, q AS ({_metrics('nb')}) SELECT domain, {_ROUND} FROM q",
    "f12_fold_mean": f"WITH {CASES}, {_NB}, q AS ({_metrics('nb')}) SELECT round(avg(accuracy), 6) AS accuracy, round(avg(macro_f1), 6) AS macro_f1, round(avg(balanced_accuracy), 6) AS balanced_accuracy FROM q",
    "f13_permuted_labels": f"WITH {CASES}, r AS ({_PERMS(3)}) SELECT run AS perm, r.case_id, domain, r.label FROM r JOIN cases USING (case_id)",
    "f13_random_label_control": f"""WITH {CASES}, {_FOLDS}, {_SUPPORT}, {_fit('_n', 'naive_bayes', perms=_PERMS(3))}, {_fit('_c', 'nearest_centroid', perms=_PERMS(30))}, p AS (SELECT 'naive_bayes' AS method, * FROM p_n UNION ALL SELECT 'nearest_centroid', * FROM p_c),
q AS ({_mean_metrics('SELECT * FROM p', 'method, run')}) SELECT method, run, {_ROUND}, (SELECT bool_and(tr >= 10 AND te >= 3) FROM sup) AS valid FROM q""",
    "f14_random_partition_control": f"""WITH {CASES.replace('cases AS', 'whole AS', 1)}, r AS (SELECT case_id, row_number() OVER (ORDER BY md5('fold-1:' || case_id), case_id) - 1 AS i, count(*) OVER () AS n FROM whole),
cases AS (SELECT * REPLACE (CAST(CAST(least(4, i // (n // 5)) AS INTEGER) AS VARCHAR) AS domain) FROM whole JOIN r USING (case_id)), {_FOLDS}, {_VIEWS}, {_fit('_w', 'nearest_centroid')}, {_fit('_l', 'nearest_centroid', source='first_line')}, {_fit('_r', 'nearest_centroid', source='rest')},
p AS (SELECT 'whole' AS view, domain, label, predicted FROM p_w UNION ALL SELECT 'first_line', domain, label, predicted FROM p_l UNION ALL SELECT 'rest', domain, label, predicted FROM p_r), q AS ({_mean_metrics('SELECT * FROM p', 'view')})
SELECT view, {_ROUND}, CASE WHEN macro_f1 >= 0.7 THEN 'risk' ELSE 'pass' END AS status FROM q""",
    "f18_baseline_suite": f"""WITH {CASES}, {_FOLDS}, {_MAJORITY}, {_VIEWS}, {_LOOKUP}, {_STATUS}, {_suite_sql()[0]}, p AS ({_suite_sql("SELECT 'categorical_lookup', 'family', domain, label, predicted FROM lookup")[1]}), q AS ({_mean_metrics('SELECT * FROM p', 'method, view')})
SELECT method, view, {_ROUND}, CASE WHEN view = 'family' THEN coalesce((SELECT min(status) FROM st WHERE status <> 'evaluable'), 'evaluable') ELSE 'evaluable' END AS status FROM q""",
    "f16_shortcut_decision": f"""WITH {CASES}, {_FOLDS}, {_MAJORITY}, {_VIEWS}, {_suite_sql()[0]}, p AS ({_suite_sql()[1]}), q AS ({_mean_metrics('SELECT * FROM p', 'method, view')}), k AS (SELECT *, row_number() OVER (PARTITION BY view ORDER BY round(macro_f1, 9) DESC, method) AS k FROM q WHERE method <> 'majority'),
g AS (SELECT k.view, k.method, k.macro_f1, k.macro_f1 - b.macro_f1 AS m FROM k JOIN q b ON b.view = k.view AND b.method = 'majority' WHERE k = 1) SELECT view, method, round(macro_f1, 6) AS macro_f1, round(m, 6) AS margin, macro_f1 >= 0.7 AND m >= 0.05 AS risk FROM g""",
    "f15_quantiles_nearest": f"""WITH {CASES}, x AS (SELECT domain, list_sort(list(length(text))) AS v FROM cases GROUP BY domain) SELECT domain, len(v) AS n, v[1] AS min, v[len(v) // 4 + 1] AS q1, v[len(v) // 2 + 1] AS q2, v[3 * len(v) // 4 + 1] AS q3, v[-1] AS max FROM x""",
    "f17_surface_control_status": f"""WITH {CASES}, {_CENTROID}, {_MAJORITY}, mj AS (SELECT {_K}, predicted FROM cases JOIN maj ON fold = domain), a AS ({_metrics('nc')}), b AS ({_metrics('mj')}),
g AS (SELECT avg(a.macro_f1) AS macro_f1, min(a.macro_f1 - b.macro_f1) AS least_margin FROM a JOIN b ON a.domain = b.domain) SELECT round(macro_f1, 6) AS macro_f1, round(least_margin, 6) AS least_margin, CASE WHEN macro_f1 >= 0.7 AND least_margin >= 0.05 THEN 'risk' ELSE 'pass' END AS status FROM g""",
    "f19_support_check": f"""WITH {CASES}, g AS (SELECT d.domain, l.label, (SELECT count(*) FROM cases c WHERE c.label = l.label AND c.domain <> d.domain) AS tr, (SELECT count(*) FROM cases c WHERE c.label = l.label AND c.domain = d.domain) AS te
FROM (SELECT DISTINCT domain FROM cases) d, (SELECT DISTINCT label FROM cases) l) SELECT domain, bool_and(tr >= 10 AND te >= 3) AS valid, min(tr) AS least_train, min(te) AS least_test FROM g GROUP BY domain""",
}
