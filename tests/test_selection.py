"""Probe selection from moments against direct fits on the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidra.operators import selection as S
from evidra.sources.io import settled

PAIRS = "case_id long, domain string, family long, y array<int>, layers array<array<double>>"
DIM, K, ALPHAS = 3, 2, (0.01, 0.1, 1.0, 10.0)


def direct(x, y, alpha):
    """One-vs-rest ridge with a free intercept, on the rows."""
    mean, sd = x.mean(0), x.std(0)
    sd[sd == 0] = 1
    z = (x - mean) / sd
    fits = []
    for k in range(K):
        t = np.where(y == k, 1.0, -1.0)
        a = np.block([[z, np.ones((len(z), 1))], [np.sqrt(alpha) * np.eye(DIM), np.zeros((DIM, 1))]])
        fits.append(np.linalg.lstsq(a, np.concatenate([t, np.zeros(DIM)]), rcond=None)[0])
    w = np.array(fits)
    return lambda q: ((q - mean) / sd @ w[:, :DIM].T + w[:, DIM]).argmax(1)


def f1(truth, said):
    return np.mean([2 * ((truth == k) & (said == k)).sum() / max(1, (truth == k).sum() + (said == k).sum()) for k in sorted(set(truth) | set(said))])


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    n = 120
    domain, y = np.arange(n) % 4, rng.integers(0, 2, n)
    layers = rng.normal(size=(n, 2, DIM))
    layers[:, 1, 0] += 1.5 * y
    rows = spark.createDataFrame([(i, str(domain[i]), str(y[i]), layers[i].tolist()) for i in range(n)], "vec_id long, domain string, label string, layers array<array<double>>")
    labels, k = S.run_labels(rows, "vec_id", "domain", "label", 19, "s")
    assert k == K
    joined = settled(rows.join(labels, "vec_id"), "joined")
    ys = np.array([r["y"] for r in sorted(joined.select("vec_id", "y").collect())])
    fits = S.nested_fits(S.moments(joined, DIM, 20, K), DIM, 20, K)
    return domain, layers, ys, settled(S.confusions(joined, "vec_id", fits, DIM, 20, K), "cells")


def test_null_labels_are_issues_and_many_labels_fit(spark, monkeypatch):
    rng = np.random.default_rng(5)
    n, k = 2000, 250
    rows = [(i, str(i % 4), None if i % 10 == 0 else f"l{rng.integers(k):03d}", [rng.normal(size=DIM).tolist()]) for i in range(n)]
    frame = spark.createDataFrame(rows, "vec_id long, domain string, label string, layers array<array<double>>")
    assert S.unlabelled(frame, "vec_id", "label").count() == n // 10
    labels, found = S.run_labels(frame, "vec_id", "domain", "label", 1, "s")
    assert found == k and labels.count() == n - n // 10
    joined = settled(frame.join(labels, "vec_id"), "many")
    monkeypatch.setattr(S, "PIECE", 100)  # several pieces of a domain, and a chunk for each run
    monkeypatch.setattr(S, "RUNS", 1)
    cells = S.confusions(joined, "vec_id", S.nested_fits(S.moments(joined, DIM, 2, k), DIM, 2, k), DIM, 2, k)
    sums = {(r["inner"] is None, r["alpha"], r["run"]): r["n"] for r in cells.groupBy(F.when(F.col("inner").isNotNull(), "i").alias("inner"), "alpha", "run").agg(F.sum("n").alias("n")).collect()}
    assert sums == {(outer, a, run): (1 if outer else 3) * (n - n // 10) for outer in (True, False) for a in ALPHAS for run in (0, 1)}


def test_permutations_keep_counts_within_domains(data):
    domain, _, ys, _ = data
    for d in range(4):
        assert len({ys[domain == d, r].sum() for r in range(20)}) == 1
    assert len({ys[:, r].tobytes() for r in range(20)}) > 15


def test_nested_selection_and_outer_scores_against_direct_fits(data):
    domain, layers, ys, cells = data
    got = {(r["layer"], r["outer"], r["run"]): r for r in S.outer_eval(cells, S.nested_alpha(cells)).collect()}
    assert len(got) == 2 * 4 * 20
    for layer in (0, 1):
        for outer in range(4):
            for run in (0, 1, 7):
                x, y = layers[:, layer], ys[:, run]
                mean = {}
                for a in ALPHAS:
                    scores = []
                    for inner in range(4):
                        if inner != outer:
                            on, te = (domain != outer) & (domain != inner), domain == inner
                            scores.append(f1(y[te], direct(x[on], y[on], a)(x[te])))
                    mean[a] = np.mean(scores)
                best = min(ALPHAS, key=lambda a: (-round(mean[a], 9), a))
                r = got[layer, str(outer), run]
                assert r["alpha"] == best and r["inner_f1"] == pytest.approx(mean[best])
                on, te = domain != outer, domain == outer
                said = direct(x[on], y[on], best)(x[te])
                assert r["macro_f1"] == pytest.approx(f1(ys[te, 0], said))


def test_layer_and_maximum_tests(data):
    cells = data[3]
    evals = S.outer_eval(cells, S.nested_alpha(cells)).cache()
    rows = evals.groupBy("layer", "run").agg(F.avg("macro_f1").alias("f")).collect()
    f = {(r["layer"], r["run"]): r["f"] for r in rows}
    for r in S.layer_test(evals).collect():
        null = [f[r["layer"], k] for k in range(1, 20)]
        assert r["p"] == pytest.approx((1 + sum(round(x, 9) >= round(r["macro_f1"], 9) for x in null)) / 20)
    best = S.max_statistic(evals, 0.06).first()
    top = [max(f[0, k], f[1, k]) for k in range(1, 20)]
    assert best["layer"] == 1 and best["p"] == pytest.approx((1 + sum(x >= best["macro_f1"] - 1e-9 for x in top)) / 20) and best["status"] == "pass"
    assert S.max_statistic(evals, 0.01).first()["status"] == "refused"


def test_score_operator_and_endpoint_against_direct_fits(spark):
    rng = np.random.default_rng(6)
    n = 60
    y, family = np.arange(n) % 2, np.arange(n) // 2
    domain, x = family % 3, rng.normal(size=(n, 2, DIM))
    x[:, 0, 1] += 1.2 * y
    rows = spark.createDataFrame([(i, str(domain[i]), int(family[i]), [int(y[i])], x[i].tolist()) for i in range(n)], PAIRS)
    scores = S.score_operator(rows, DIM, 0.5)
    got = {(r["case_id"], r["layer"]): r["score"] for r in scores.collect()}
    for layer in (0, 1):
        for d in range(3):
            on = domain != d
            a = x[on, layer]
            mean, sd = a.mean(0), a.std(0)
            z = (a - mean) / sd
            w = z.T @ np.linalg.solve(z @ z.T + 0.5 * np.eye(len(z)), np.where(y[on] == 1, 1.0, -1.0))  # the dual form
            for i in np.flatnonzero(domain == d):
                assert got[i, layer] == pytest.approx(((x[i, layer] - mean) / sd) @ w)
    surface = spark.createDataFrame([(0.3,), (0.2,)], "macro_f1 double")
    null = S.swap_null(rows, DIM, 0.5, 99, "s", [0])
    end = S.primary_endpoint(scores, null, surface, 0, {"p": 0.05, "margin": 0.1, "rate": 0.5, "domains": 1.0}).first()
    won = sum(got[2 * f + 1, 0] > got[2 * f, 0] for f in range(n // 2))
    assert (end["observed"], end["families"]) == (won, n // 2) and end["p"] <= 0.05 and end["decision"] == "positive" and end["domains_up"] == 3
    assert end["margin"] == pytest.approx(f1(y, (np.array([got[i, 0] for i in range(n)]) >= 0).astype(int)) - 0.3)
    assert S.primary_endpoint(scores, null, surface, 0, {"p": 0.05, "margin": 0.9, "rate": 0.5, "domains": 1.0}).first()["decision"] == "null"
    other = {r["layer"]: r for r in S.sensitivity(scores, 0).collect()}
    assert other[0]["primary"] and not other[1]["primary"] and other[0]["won"] == won and other[1]["range"] == 0


def dual(x, y, alpha, on, te):
    """Scores of the tested rows by a fit on the others, in the dual form."""
    a = x[on]
    sd = a.std(0)
    sd[sd < 1e-12] = 1
    z = (a - a.mean(0)) / sd
    return ((x[te] - a.mean(0)) / sd) @ (z.T @ np.linalg.solve(z @ z.T + alpha * np.eye(len(z)), np.where(y[on] == 1, 1.0, -1.0)))


@pytest.mark.parametrize("layers", [None, [1]])
def test_swap_null_against_refits_over_the_same_draws(spark, monkeypatch, layers):
    rng = np.random.default_rng(9)
    n = 64
    y, family = np.arange(n) % 2, np.arange(n) // 2
    domain, x = family % 3, rng.normal(size=(n, 2, DIM))
    x[:, 1, 0] += 0.4 * y
    y[60:62] = 1  # two families that aren't pairs stay as they are: two positives, and one in two domains
    domain[63] = (domain[62] + 1) % 3
    rows = spark.createDataFrame([(i, str(domain[i]), int(family[i]), [int(y[i])], x[i].tolist()) for i in range(n)], PAIRS)
    monkeypatch.setattr(S, "PIECE", 7)
    labels, runs = S.swap_labels(rows, 60, "s")
    assert runs == 61
    ys = np.array([r["y"] for r in labels.orderBy("case_id").select("y").collect()])
    assert (ys[:, 0] == y).all() and (ys[60:] == y[60:, None]).all() and len({c.tobytes() for c in ys.T[1:]}) == 60
    assert (ys[:60].reshape(30, 2, 61).sum(1) == 1).all() and 0.3 < (ys[:60] != y[:60, None]).mean() < 0.7
    won = []
    for run in range(61):
        best = []
        for layer in layers or (0, 1):
            score = np.zeros(n)
            for d in range(3):
                score[domain == d] = dual(x[:, layer], ys[:, run], 0.5, domain != d, domain == d)
            pairs = (2 * ys[:60, run] - 1) * score[:60]
            best.append(int((pairs.reshape(30, 2).sum(1) > 0).sum()))
        won.append(max(best))
    got = S.swap_null(rows, DIM, 0.5, 60, "s", layers).first()
    null = sorted(won[1:])
    assert (got["observed"], got["families"], got["runs"], got["least"], got["median"], got["most"]) == (won[0], 30, 60, null[0], null[30], null[-1])
    assert got["p"] == pytest.approx((1 + sum(v >= won[0] for v in null)) / 61)
    few = spark.createDataFrame([(i, str(domain[i]), int(family[i]), [int(y[i])], x[i].tolist()) for i in range(6)], PAIRS)
    assert S.swap_labels(few, 60, "s")[1] <= 1 + 8  # three families have eight draws


def test_random_directions_are_of_the_candidate_s_norm_and_mostly_unrelated(spark):
    g = spark.createDataFrame([(0, i, 1.0 if i == 0 else 0.0, 1.0) for i in range(64)], "layer int, i int, difference double, norm double")
    got = S.random_directions(g, 200, 64, "s").collect()
    c = np.array([r["cosine"] for r in got])
    assert len(c) == 200 and abs(c.mean()) < 0.03 and 0.09 < c.std() < 0.16 and len(set(c)) == 200
