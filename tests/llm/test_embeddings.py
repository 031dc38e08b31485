"""Recall of the forest's candidates at production parameters, and vectors of extreme length."""

import numpy as np
import pytest

from evidra.llm import embed_dedup
from evidra.llm.embed_dedup import Forest, near_vectors

DIM, N = 64, 50_000


def planted(rng, x, n, low, high):
    """``n`` vectors of ``x`` and others at a cosine of ``low`` to ``high`` with them."""
    a = x[rng.choice(len(x), n, replace=False)]
    g = rng.standard_normal(a.shape)
    g -= (g * a).sum(1, keepdims=True) * a
    g /= np.linalg.norm(g, axis=1, keepdims=True)
    c = rng.uniform(low, high, (n, 1))
    return a, c * a + np.sqrt(1 - c * c) * g


@pytest.mark.parametrize("clusters", [0, 200])
def test_planted_pairs_share_a_leaf(clusters):
    rng = np.random.default_rng(clusters + 1)
    x = rng.standard_normal((N, DIM))
    if clusters:  # vectors around centres, at cosines of about 0.5 among themselves
        x += rng.standard_normal((clusters, DIM))[rng.integers(0, clusters, N)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = planted(rng, x, 1500, 0.90, 0.95)
    every = np.concatenate([x, b])
    forest = Forest(every[rng.choice(len(every), 20_000, replace=False)], len(every), 6, 512, 0.015, 7, 0.9)
    met = [bool(set(p) & set(q)) for p, q in zip(forest.leaves(a), forest.leaves(b), strict=True)]
    assert np.mean(met) >= 0.95


def clustered(rng, n, dim, clusters, cosine):
    """Unit vectors at a cosine of about ``cosine`` with the others of their cluster, and the clusters."""
    x, c = rng.standard_normal((n, dim)), rng.standard_normal((clusters, dim))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    of = rng.integers(0, clusters, n)
    x -= (x * c[of]).sum(1, keepdims=True) * c[of]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return np.sqrt(cosine) * c[of] + np.sqrt(1 - cosine) * x, of


@pytest.mark.parametrize(("clusters", "cosine"), [(12, 0.92), (18, 0.92), (12, 0.97), (18, 0.97)])
def test_no_leaf_holds_much_more_than_a_cluster(clusters, cosine):
    rng = np.random.default_rng(clusters)
    x, of = clustered(rng, 12_000, DIM, clusters, cosine)
    forest = Forest(x, len(x), 6, 512, 0.015, 7, 0.9)
    leaves = forest.leaves(x)
    sizes = np.unique(np.concatenate(leaves), return_counts=True)[1]
    assert sizes.max() <= 2 * np.bincount(of).max()
    some = rng.choice(len(x), 100, replace=False)
    met = [bool(set(leaves[i]) & set(leaves[j])) for i in some for j in np.flatnonzero(x @ x[i] >= 0.9)[:50]]
    assert len(met) > 4000 and np.mean(met) >= 0.95


@pytest.mark.parametrize("clusters", [0, 12])
def test_links_are_found_through_the_whole_search(spark, clusters):
    """Planted partners of 1,500 vectors, spread out or among clusters of near copies: at least 0.95 of the links are counted, none that isn't one."""
    rng = np.random.default_rng(21)
    x = clustered(rng, 3000, DIM, clusters, 0.92)[0] if clusters else rng.standard_normal((3000, DIM))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    every = np.concatenate([x, planted(rng, x, 1500, 0.905, 0.95)[1]])
    links = np.zeros(len(every), np.int64)
    for i in range(0, len(every), 500):
        links[i : i + 500] = (every[i : i + 500] @ every.T >= 0.9).sum(1) - 1
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(every)], "vec_id long, embedding array<double>")
    got = np.array([r["n_links"] for r in near_vectors(rows).orderBy("vec_id").collect()])
    assert (got <= links).all() and got.sum() >= 0.95 * links.sum() > 2000


def test_leaves_are_parted_beyond_their_sample():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((8000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    a, b = planted(rng, x, 500, 0.93, 0.99)
    forest = Forest(x[:100], len(x), 6, 128, 0.015, 7, 0.9)  # a hundred vectors stand for 8,000
    sizes = np.unique(np.concatenate(forest.leaves(x)), return_counts=True)[1]
    assert np.mean(sizes) < 400 and sizes.max() < 1500
    assert np.mean([bool(set(p) & set(q)) for p, q in zip(forest.leaves(a), forest.leaves(b), strict=True)]) >= 0.9


def test_very_short_and_very_long_vectors(spark):
    rows = [(1, [1e-200, 0.0]), (2, [2e-200, 0.0]), (3, [1e200, 1.0]), (4, [2e200, 2.0]), (5, [0.0, 1e-300])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5)}
    assert embed_dedup._unit(np.array([[3e-320, 4e-320]])) == pytest.approx(np.array([[0.6, 0.8]]), rel=1e-3)
