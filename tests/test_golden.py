"""Hand-made rows with known results."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.operators import agreement as A
from evidra.operators import audit
from evidra.operators import baselines as B
from evidra.operators import effects as H
from evidra.operators import probes as G
from evidra.operators import similarity as S


def test_sign_flip_of_six_equal_domains(spark):
    means = spark.createDataFrame([(d, 1.0) for d in "abcdef"], "domain string, mean double")
    row = H.sign_flip_exact(means, "domain").first()
    assert (row["domains"], row["mean"], row["p"]) == (6, 1.0, 0.03125)
    assert H.transfer_decision(means, "domain", 0.05, 0.1, 6).first()["decision"] == "positive"
    assert H.transfer_decision(means, "domain", 0.05, 0.1, 7).first()["decision"] == "non_interpretable"


def test_a_domain_at_zero_is_no_transfer(spark):
    means = spark.createDataFrame([(d, 1.0 if d != "a" else 0.0) for d in "abcdef"], "domain string, mean double")
    assert H.transfer_decision(means, "domain", 0.05, 0.1, 6).first()["decision"] == "null_result"


def alpha(units, distance):
    flat = [x for u in units if len(u) > 1 for x in u]
    n = len(flat)
    do = sum(sum(distance(a, b) for a, b in itertools.permutations(u, 2)) / (len(u) - 1) for u in units if len(u) > 1) / n
    de = sum(distance(a, b) for a, b in itertools.permutations(flat, 2)) / (n * (n - 1))
    return 1 - do / de


@pytest.mark.parametrize("seed", [1, 2])
def test_alpha_against_pairs(spark, seed):
    rng = random.Random(seed)
    units = [[rng.randrange(4) for _ in range(rng.randrange(1, 5))] for _ in range(25)]
    rows = spark.createDataFrame([(i, x) for i, u in enumerate(units) for x in u], "unit long, label int")
    assert A.alpha_nominal(rows, "unit", "label").first()["alpha"] == pytest.approx(alpha(units, lambda a, b: float(a != b)))
    flat = [x for u in units if len(u) > 1 for x in u]
    n = [flat.count(k) for k in range(4)]
    ordinal = lambda a, b: (sum(n[min(a, b) : max(a, b) + 1]) - (n[a] + n[b]) / 2) ** 2
    assert A.alpha_ordinal(rows, "unit", "label").first()["alpha"] == pytest.approx(alpha(units, ordinal))
    pairs = [(a, b) for u in units for a, b in itertools.combinations(u, 2)]
    assert A.pairwise_agreement(A.unit_counts(rows, "unit", "label")).first()["agreement"] == pytest.approx(sum(a == b for a, b in pairs) / len(pairs))
    assert A.mean_abs_diff(rows, "unit", "label").first()["mean_abs_diff"] == pytest.approx(sum(abs(a - b) for a, b in pairs) / len(pairs))


def test_alpha_without_pairs_is_one(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "unit long, label string")
    assert A.alpha_nominal(rows, "unit", "label").first()["alpha"] == 1.0
    assert A.pairwise_agreement(A.unit_counts(rows, "unit", "label")).first()["agreement"] is None


def test_planted_signal_beats_the_majority(spark):
    rows = [(i, d, str(i // 4 % 2), ("alpha beta" if i // 4 % 2 else "gamma delta") + f" x{i}") for i, d in enumerate("abcd" * 6)]
    cases = spark.createDataFrame(rows, "case_id long, domain string, label string, text string")
    for method in (B.naive_bayes, B.keyword, B.nearest_centroid, B.char_profile):
        assert {r["macro_f1"] for r in B.class_metrics(method(cases)).collect()} == {1.0}, method
    assert all(r["macro_f1"] < 0.7 for r in B.class_metrics(B.majority(cases)).collect())


def test_ridge_from_moments_equals_direct_fit(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    x, y, d = rng.normal(size=(60, 4)).astype("float32"), rng.integers(0, 3, 60), rng.integers(0, 3, 60)
    df = spark.createDataFrame([(i, str(d[i]), str(y[i]), [float(v) for v in x[i]]) for i in range(60)], "id long, domain string, label string, v array<double>")
    got = {r["id"]: r["predicted"] for r in G.ridge_lodo(df, G.domain_moments(df, "domain", "label", "v", 4), "id", "domain", "label", "v", 4, 0.5).collect()}
    x = x.astype(float)
    for fold in range(3):
        tr = d != fold
        mean, sd = x[tr].mean(0), x[tr].std(0)
        z = (x - mean) / sd
        scores = []
        for k in range(3):
            t = np.where(y[tr] == k, 1.0, -1.0)
            w = np.linalg.solve(z[tr].T @ z[tr] + 0.5 * np.eye(4), z[tr].T @ (t - t.mean()))
            scores.append(z @ w + t.mean())
        for i in np.flatnonzero(d == fold):
            assert got[i] == str(int(np.argmax(np.array(scores)[:, i])))


def test_near_duplicate_join_against_all_pairs(spark):
    rng = random.Random(5)
    words = "a b c d e f".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9)))) for i in range(60)] + [(60, None)]
    df = spark.createDataFrame(rows, "id long, t string")
    left, right = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    grams = {i: {tuple((t or "").split()[k : k + 3]) for k in range(len((t or "").split()) - 2)} for i, t in rows}
    for threshold in (0.3, 0.78):
        want = {(a, b) for a in grams for b in grams if a % 2 == 0 and b % 2 == 1 and grams[a] and grams[b] and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= threshold}
        assert {(r["a"], r["b"]) for r in S.near_duplicate_join(left, right, "id", "t", threshold).collect()} == want


def test_snapshot_and_readiness(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v long")
    b = spark.createDataFrame([("y", 3), ("z", 4)], "k string, v long")
    assert {(r["k"], r["code"]) for r in audit.snapshot_diff(a, b, "k", ["v"]).collect()} == {("x", "removed"), ("y", "changed"), ("z", "added")}
    same = audit.table_digest(a, ["k", "v"]).first()["digest"]
    assert same == audit.table_digest(a.repartition(3).orderBy(F.desc("k")), ["k", "v"]).first()["digest"] != audit.table_digest(b, ["k", "v"]).first()["digest"]


def test_constant_labels_and_empty_tables(spark):
    empty = spark.createDataFrame([], "case_id long, domain string, label string, text string")
    assert B.naive_bayes(empty).count() == 0 and B.folds(empty).count() == 0
    assert A.consensus(spark.createDataFrame([], "unit long, label string"), "unit", "label", "x").count() == 0


def test_targets_of_few_words_and_parts_of_words_are_found(spark):
    texts = spark.createDataFrame([(1, "all of the internationalisation standardisation work"), (2, "a xinternationalisation standardisationy z"), (3, "one prefixalpha beta gamma delta epsilonsuffix two"), (4, "unrelated words only")], "doc_id long, text string")
    targets = spark.createDataFrame([(10, "Internationalisation, standardisation!"), (11, "alpha beta gamma delta epsilon"), (12, "too short"), (13, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in S.containment_join(texts, "doc_id", "text", targets, "item_id", "text").collect()}
    assert got == {(1, 10), (2, 10), (3, 11)}


def test_terms_are_literal(spark):
    rows = spark.createDataFrame([(1, "axb and c"), (2, "a.b and c++ ( x"), (3, None)], "doc_id long, text string")
    got = {(r["entity_id"], r["detail"]) for r in audit.forbidden_terms(rows, "doc_id", "text", ["a.b", "c++", "("], True).collect()}
    assert got == {("2", "a.b"), ("2", "c++"), ("2", "(")}


def test_bootstrap_intervals_as_resampling_unit_by_unit(spark):
    rng = np.random.default_rng(1)
    labels = [[rng.choice(["a", "b"]) if rng.random() < 0.4 else "a" for _ in range(3)] for _ in range(60)]
    rows = spark.createDataFrame([(u, r, x) for u, own in enumerate(labels) for r, x in enumerate(own)], "unit long, rater long, label string")
    got = {r["measure"]: (r["low"], r["high"]) for r in A.bootstrap_agreement(rows, "unit", "label", 2000, 3).collect()}
    a = np.array([[own.count("a"), own.count("b")] for own in labels], float)
    out = []
    for _ in range(2000):
        h = a[rng.integers(0, 60, 60)]
        out.append(((h * h).sum() - h.sum()) / (6 * 60))
    assert got["agreement"] == pytest.approx(np.percentile(out, [2.5, 97.5]), abs=0.03)
    assert got["alpha"][0] < got["alpha"][1] < 1


def test_pair_fields_against_plain_sets(spark):
    texts = [(1, "the red fox ran home", "alpha beta", "x"), (2, "the red fox ran away", "gamma delta", "x"), (3, "", "", "")]
    frame = spark.createDataFrame(texts, "doc_id long, one string, two string, three string")
    pairs = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (1, 9)], "a long, b long")

    def sets(t):
        w, c = t.split(), t.replace(" ", "")
        grams = lambda x, n: {tuple(x[i : i + n]) for i in range(len(x) - n + 1)}
        return [grams(w, 1), grams(w, 2), grams(c, 3) if len(c) >= 3 else {tuple(c)} if c else set()]

    share = lambda x, y: sum(len(p & q) / len(p | q) if p | q else 0.0 for p, q in zip(sets(x), sets(y), strict=True)) / 3
    got = {(r["a"], r["b"]): r for r in S.pair_fields(pairs, frame, "doc_id", ["one", "two", "three"], [1, 2], [3], 0.6).collect()}
    assert set(got) == {(1, 2), (1, 3)}
    for (a, b), r in got.items():
        want = [share(texts[a - 1][k], texts[b - 1][k]) for k in (1, 2, 3)]
        assert [r["s_one"], r["s_two"], r["s_three"]] == pytest.approx(want) and r["flag"] == (sum(x < 0.6 for x in want) >= 2)
