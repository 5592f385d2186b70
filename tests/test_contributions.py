"""Leaf-path Shapley values, interaction values and drawn coalitions against their definitions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pubag.operators import explain as X
from pubag.operators.bagging import PUBagging, fit_plain
from pubag.operators.learners import registry


def _frame(spark, d, n=60, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [None if rng.random() < 0.05 else rng.gauss(0, 1) for _ in range(d)]
        rows.append((i, "ab"[i % 2], int((x[0] or 0) * (x[1] or 0) + (x[2] or 0) > 0.2), *x))
    names = [f"x{j}" for j in range(d)]
    return spark.createDataFrame(rows, f"k int, g string, y int, {', '.join(c + ' double' for c in names)}"), names


def _random_tree(rng, depth, d):
    size = 2 ** (depth + 1)
    t = {"feat": np.full(size, -1), "cut": np.full(size, -1), "value": rng.normal(size=size)}
    for node in range(1, 2 ** depth):
        if (node == 1 or t["feat"][node // 2] >= 0) and rng.random() < 0.9:
            t["feat"][node], t["cut"][node] = rng.integers(0, d), rng.integers(-1, 3)
    return t


def test_leaf_paths_equal_all_coalitions():
    from pubag.operators.learners.tree import leaf_values
    rng = np.random.default_rng(0)
    d = 5
    for _ in range(20):
        t = _random_tree(rng, 4, d)
        x, z = rng.integers(-1, 4, (7, d)), rng.integers(-1, 4, (6, d))
        v = np.array([[leaf_values(t, np.where(mask, row, z), 4).mean() for mask in X._all_masks(d)] for row in x])
        want = v @ X.shapley_matrix(d).T
        assert np.allclose(X.tree_phi(X.leaf_paths(t, d), x, z), want, atol=1e-12)


@pytest.mark.parametrize("kind, params", [("tree", {"max_depth": 3}), ("random_forest", {"n_trees": 3, "max_depth": 2})])
def test_tree_contributions_equal_coalitions_and_add_up(spark, kind, params):
    df, names = _frame(spark, 4)
    m = PUBagging(learner=registry(kind, **params), n_estimators=3, max_samples=12, seed=1, oob_score=False).fit(df, names, ["k"], axis=["g"])
    few = df.limit(12)
    a = {(r.g, r.k, r.feature): r.phi for r in X.tree_contributions(m, few, df, 10, 2).collect()}
    b = {(r.g, r.k, r.feature): r for r in X.coalition_contributions(m, few, df, 10, 2).collect()}
    assert a.keys() == b.keys() and all(math.isclose(v, b[k].phi, abs_tol=1e-9) for k, v in a.items())
    p = {r.k: r.p1 for r in m.predict_proba(few).collect()}
    for (g, k, _), r in b.items():
        assert math.isclose(r.fx, p[k], abs_tol=1e-12)
        assert math.isclose(sum(v for key, v in a.items() if key[:2] == (g, k)), r.fx - r.ef, abs_tol=1e-9)


def test_boosted_margins_and_many_features(spark):
    """More than 12 features: leaf paths are still exact, so they add up to the margin less its mean over the background."""
    df, names = _frame(spark, 15)
    m = fit_plain(df, names, ["k"], learner=registry("boosted_trees", n_trees=3, rows=1.0))
    phi = X.tree_contributions(m, df, df, 1000, 0).groupBy("k").agg(F.sum("phi").alias("s"))
    margins = {r.k: r.margin for r in m.decision_function(df).collect()}
    mean = sum(margins.values()) / len(margins)
    assert all(math.isclose(r.s, margins[r.k] - mean, abs_tol=1e-9) for r in phi.collect())


def test_interactions_add_up_and_are_not_additive_for_trees(spark):
    df, names = _frame(spark, 4, 120)
    m = fit_plain(df, names, ["k"], learner=registry("tree", max_depth=3))
    few = df.limit(8)
    inter = {}
    for r in X.interaction_values(m, few, df, 15, 0).collect():
        inter.setdefault(r.k, {})[r.feature_i, r.feature_j] = r.value
    for r in X.coalition_contributions(m, few, df, 15, 0).collect():
        own = inter[r.k]
        assert math.isclose(sum(own[r.feature, f] for f in names), r.phi, abs_tol=1e-9)
        assert all(math.isclose(own[r.feature, f], own[f, r.feature], abs_tol=1e-12) for f in names)
    assert max(abs(v["x0", "x1"]) for v in inter.values()) > 1e-3


def test_drawn_coalitions_are_near_exact_and_add_up(spark, monkeypatch):
    df, names = _frame(spark, 12, 80)
    m = PUBagging(n_estimators=2, max_samples=20, seed=1, oob_score=False).fit(df, names, ["k"])
    few = df.limit(3)
    exact = {(r.k, r.feature): r for r in X.coalition_contributions(m, few, df, 5, 0).collect()}
    monkeypatch.setattr(X, "MAX_COALITION_FEATURES", 3)
    drawn = {(r.k, r.feature): r for r in X.coalition_contributions(m, few, df, 5, 0, pairs=600).collect()}
    assert drawn.keys() == exact.keys()
    for k in {k for k, _ in exact}:
        assert math.isclose(sum(drawn[k, f].phi for f in names), exact[k, "x0"].fx - exact[k, "x0"].ef, abs_tol=1e-9)
    worst = max(abs(drawn[key].phi - exact[key].phi) for key in exact)
    assert worst < 0.02, worst
    with pytest.raises(ValueError):
        X.interaction_values(m, few, df)
