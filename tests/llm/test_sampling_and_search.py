"""Resampling, whitening and nearest neighbours against brute force, and on odd tables."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from evidra.llm import importance, whitening
from evidra.llm.ann_search import Forest, nearest
from evidra.llm.importance import resample
from evidra.llm.queries import QUERIES
from evidra.llm.whitening import whiten

SF = "/root/testdata/sf0.001"
WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text):
    w = WORDS.findall((text or "").translate(FOLD))
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain_resample(rows, target):
    """doc_id, n_features, weight, score, rank by the definition."""
    counts = []
    for texts in ([t for _, t in rows], target):
        counts.append(np.zeros(10_000, int))
        for t in texts:
            np.add.at(counts[-1], plain_features(t)[1], 1)
    s, t = counts
    gain = [math.floor(1000 * math.log((int(b) + 1) * (int(s.sum()) + 10_000) / ((int(a) + 1) * (int(t.sum()) + 10_000)))) for a, b in zip(s, t, strict=True)]
    out = []
    for doc_id, text in rows:
        n, f = plain_features(text)
        h = int(hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[x] for x in f)
        out.append((doc_id, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0]))
    ranks = {r[0]: i + 1 for i, r in enumerate(able[: 5 * len(able) // 100])}
    return sorted((r[0], *r[2:], ranks.get(r[0])) for r in out)


def test_resampling_against_the_definition(spark, monkeypatch):
    monkeypatch.setattr(importance, "PIECE", 64)  # many pieces a text
    rng = random.Random(3)
    word = lambda: rng.choice(["Straße", "ÉTÉ", "été", "a", "B2", "x_y", "don't", "日本", "İ", " "]) + rng.choice(["", "\n", "\x00", "é"])
    rows = [(i, " ".join(word() for _ in range(rng.randrange(0, 60)))) for i in range(200)] + [(200, None), (201, ""), (202, "w" * 5000), (203, " ".join(["to"] * 3000))]
    target = ["a B2 a", None, "été 日本 x y", "to to to"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("range", F.lit(1))
    got = resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), rows_per_range=40)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == plain_resample(rows, target)


def test_resampling_query_against_the_definition(spark):
    docs, target = (spark.read.parquet(f"{SF}/{t}.parquet").toPandas() for t in ("documents", "benchmark"))
    want = plain_resample(list(zip(docs["doc_id"], docs["text"], strict=True)), list(target["text"]))
    assert sorted(tuple(r) for r in QUERIES["op11_importance_resampling"](spark, SF).collect()) == want


def test_resampling_of_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample(none, none).count() == 0
    text = " ".join(f"w{i}" for i in range(30))
    rows = spark.createDataFrame([(1, text)] * 30 + [(None, text)] * 10, "doc_id long, text string")
    got = resample(rows, none, rows_per_range=7).collect()
    assert len(got) == 40 and sorted(r["rank"] for r in got if r["rank"]) == [1, 2] and len({r["weight"] for r in got}) == 1
    assert resample(rows, none, percent=100, rows_per_range=7).select("rank").distinct().count() == 40


def plain_whitening(x):
    """Integers of all rows, fit list, covariances from exact fractions."""
    x = np.floor(64 * np.asarray(x, float)).astype(object) + 1_000_000
    fit = sorted({tuple(map(int, r)) for r in x})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    d = len(s)
    v = [[Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in fit), n**3) for j in range(d)] for i in range(d)]
    return [[int(c) for c in r] for r in x], n, s, np.array([[float(c) for c in r] for r in v])


def check_whitening(rows, x):
    x, n, s, v = plain_whitening(x)
    values, unit = np.linalg.eigh(v)
    values, unit = values[::-1], unit[:, ::-1]
    k = min(16, len(s))
    got = pd.DataFrame([r.asDict() for r in rows])
    assert len(got) == len(x) * k and set(got["n"]) == {n} and set(got["component"]) == set(range(1, k + 1))
    deviation = [sum((n * c - t) ** 2 for c, t in zip(r, s, strict=True)) for r in x]
    assert {r.vec_id: int(r.deviation) for r in got.itertuples()} == dict(enumerate(deviation))
    own = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    off = np.array([[float(Fraction(c) - Fraction(t, n)) for c, t in zip(r, s, strict=True)] for r in x])
    for i in range(k):
        want = off @ unit[:, i] / math.sqrt(values[i])
        assert min(abs(own[:, i] - want).max(), abs(own[:, i] + want).max()) < 1e-6
        assert got["explained"][got["component"] == i + 1].iloc[0] == pytest.approx(values[i] / np.trace(v), rel=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


def test_whitening_against_exact_fractions(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((120, 5)) * [1, 3, 0.5, 2, 4] + [9, -5, 0, 100, 1]
    x[60:90] = x[:30]  # copies count once in the fit
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    odd = spark.createDataFrame([(1000, None), (1001, []), (1002, [1.0, None, 0.0, 0.0, 0.0]), (1003, [float("nan"), 0.0, 0.0, 0.0, 0.0]), (1004, [0.0, 0.0, float("inf"), 0.0, 0.0])], rows.schema)
    clash = rows.unionByName(odd).withColumns({c: F.lit("clash") for c in ("x", "dim", "n", "component")}).repartition(7)
    check_whitening(whiten(clash).collect(), x)


def test_whitening_of_the_query_s_table(spark):
    got = QUERIES["op12_embedding_whitening"](spark, SF).collect()
    x = [r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()]
    v = plain_whitening(np.array(x)[:, :4])[3]  # spot check of the exact matrix on a few dimensions
    y = np.floor(64 * np.array(x, float))
    assert np.allclose(v, np.cov(np.unique(y, axis=0).T, bias=True)[:4, :4])
    n, s = len(np.unique(y, axis=0)), np.unique(y + 1_000_000, axis=0).sum(0)
    assert {(r["vec_id"], r["deviation"]) for r in got} == {(i, int((((n * (r + 1_000_000)) - s) ** 2).sum())) for i, r in enumerate(y)}
    assert {r["identity_error"] < 1e-9 for r in got} == {True}


def test_squares_are_exact_at_any_size():
    rng = np.random.default_rng(4)
    for high in (100, 1 << 24, 1 << 40, 1 << 61):
        y = rng.integers(-high, high, (1100, 3))
        plain = [[int(c) for c in r] for r in y]
        pairs = [(i, j) for i in range(3) for j in range(i + 1, 3)]
        want = [sum(r[i] ** 2 for r in plain) for i in range(3)] + [sum((r[i] + r[j]) ** 2 for r in plain) for i, j in pairs]
        assert whitening.squares(whitening.centred(y, [0, 0, 0])) == want


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whiten(spark.createDataFrame([], schema)).count() == 0
    got = whiten(spark.createDataFrame([(1, [0.5, 2.0]), (1, [0.5, 2.0]), (None, [0.5, 2.0])], schema)).collect()
    assert len(got) == 6 and {(r["n"], r["whitened"], int(r["deviation"]), r["explained"], r["identity_error"]) for r in got} == {(1, None, 0, 0.0, 0.0)}
    line = whiten(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(9)] + [(9, [1e30, -1e30]), (10, [1.0])], schema)).collect()  # lengths apart, huge numbers, one direction only
    assert len(line) == 21 and {r["n"] for r in line} == {10, 1} and {r["component"] for r in line if r["whitened"] is not None} == {1}


def neighbours(x, ids, queries, k=20):
    out = {}
    for i in queries:
        s = (x * x[i]).sum(1)
        out[ids[i]] = [(ids[j], s[j]) for j in sorted(range(len(x)), key=lambda j: (-s[j], ids[j])) if j != i][:k]
    return out


def test_neighbours_of_a_small_table_are_all_found(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-2, 3, (60, 4)).astype(float)  # many ties and copies
    x[(x == 0).all(1)] = 1
    x[10:40] = x[0]
    ids = rng.permutation(200)[:60].tolist()
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    odd = spark.createDataFrame([(None, [1.0] * 4), (300, None), (320, [0.0] * 4), (340, [1.0, None, 1.0, 1.0]), (360, [float("nan")] * 4), (380, [2.0, 2.0]), (400, [])], rows.schema)
    frame = rows.unionByName(odd).withColumns({c: F.lit("clash") for c in ("key", "dim", "leaf", "score", "rank", "draw")})
    got = {}
    for r in nearest(frame, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert got == neighbours(x, ids, [i for i in range(60) if ids[i] % 20 == 0])
    few = nearest(rows.limit(5), F.lit(True)).groupBy("query_id").count().collect()
    assert [r["count"] for r in few] == [4] * 5
    assert nearest(rows.limit(0), F.lit(True)).count() == 0 and nearest(odd, F.lit(True)).count() == 0
    twice = nearest(rows.limit(1).unionAll(rows.limit(1)), F.lit(True)).collect()  # a repeated id is a row of its own
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in twice} == {(ids[0], 1, ids[0])}


@pytest.mark.parametrize("kind", ["spread", "clusters", "lengths", "deep"])
def test_recall_of_the_search(spark, kind):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((3000, 16))
    if kind == "clusters":  # a third of all rows are near copies of one vector
        x += 3 * rng.standard_normal((20, 16))[rng.integers(0, 20, 3000)]
        x[:1000] = x[0] + 0.001 * x[:1000]
    if kind == "lengths":
        x *= rng.lognormal(0, 0.7, (3000, 1))
    ids = rng.permutation(3000).tolist()
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    params = {"sample": 200} if kind == "deep" else {}  # leaves parted beyond what the sample says
    want = neighbours(x, ids, [i for i in range(3000) if ids[i] % 20 == 0])
    got, exact = {}, {}
    for r in nearest(rows, F.col("vec_id") % 20 == 0, leaf=64, block=256, **params).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
        exact[r["query_id"], r["vec_id"]] = r["score"]
    place = {v: i for i, v in enumerate(ids)}
    assert all(s == (x[place[a]] * x[place[b]]).sum() for (a, b), s in exact.items())
    assert set(got) == set(want) and all(len(set(v)) == 20 for v in got.values())
    assert np.mean([len(set(got[q]) & {v for v, _ in w}) / 20 for q, w in want.items()]) >= 0.9


def test_queue_gives_all_leaves_nearest_first():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((400, 8))
    forest = Forest(x[:100], 400, 6.0, 3, 16, 1)
    routed = forest.route(x)
    for leaf in forest.leaves:
        leaf.rows = float((routed // whole_leaf() == leaf.number).sum())
    order = list(forest.visit(x[0]))
    assert len({n for n, _ in order}) == len(order) >= 3 * 16 and sum(r for _, r in order) == pytest.approx(3 * 400)
    assert set(routed.ravel()) <= {n for n, _ in order}
    head = {n for n, _ in order[: len(order) // 4]}
    near, far = np.argsort(-x @ x[0])[:20], np.argsort(-x @ x[0])[-20:]
    met = lambda rows: np.mean([bool(set(routed[i]) & head) for i in rows])
    assert met(near) > met(far) + 0.3


def whole_leaf():
    from evidra.llm.ann_search import SUB

    return SUB
