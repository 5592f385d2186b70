"""BL5 and BL6: separable data, gradients against differences and NumPy, bags that do not depend on each other."""

import random

import numpy as np
import pytest

from pubag.operators.bagging import PUBagging, fit_plain
from pubag.operators.learners import bag_sums as B
from pubag.operators.learners import registry
from pubag.operators.learners.gradient import Perceptron


def _ring(spark, n=400, noise=0.0):
    """A disc (1) in a ring (0): not separable by a line."""
    rng = random.Random(0)
    rows = []
    for i in range(n):
        y = i % 2
        r, t = (rng.uniform(0, 1) if y else rng.uniform(2, 3)) * 100, rng.uniform(0, 6.283)
        rows.append((i, y if rng.random() >= noise else 1 - y, r * np.cos(t) + 1000, r * np.sin(t) / 1000, None if i % 40 == 0 else 1.0))
    return spark.createDataFrame([(i, y, float(a), float(b), c) for i, y, a, b, c in rows], "k int, y int, a double, b double, c double")


FEATS = ["a", "b", "c"]


@pytest.mark.parametrize("kind, steps", [("kernel_svm", 40), ("mlp", 60)])
def test_separates_a_disc_from_a_ring(spark, kind, steps):
    df = _ring(spark)
    m = fit_plain(df, FEATS, ["k"], learner=registry(kind, steps=steps))
    wrong = sum(r.yhat != r.y for r in m.predict(df).collect())
    assert wrong <= 8  # 2 %
    line = fit_plain(df, FEATS, ["k"], learner=registry("kernel_svm", dim=1))
    assert sum(r.yhat != r.y for r in line.predict(df).collect()) > 40


def test_perceptron_gradient(spark):
    """Against central differences of the loss."""
    rng = np.random.default_rng(0)
    net = Perceptron(hidden=4)
    z, y, w = rng.normal(size=(30, 3)), rng.integers(0, 2, 30).astype(float), rng.integers(1, 4, 30).astype(float)
    p = rng.normal(size=net._size(3))

    def loss(p):
        w1, b1, w2, b2 = net.parts(p, 3)
        t = 1 / (1 + np.exp(-(z @ w1 + b1))) @ w2 + b2
        return (w * (np.logaddexp(0, t) - y * t)).sum()

    for i in range(len(p)):
        e = np.zeros(len(p))
        e[i] = 1e-6
        assert abs((loss(p + e) - loss(p - e)) / 2e-6 - net.gradient(p, z, y, w)[i]) < 1e-5


def test_steps_match_numpy_on_one_machine(spark):
    """Three SVM steps of two weighted bags against the formula over their whole rows."""
    df = _ring(spark, 120, 0.1)
    learner = registry("kernel_svm", dim=5, steps=3)
    m = PUBagging(learner=learner, n_estimators=2, max_samples=25, seed=4).fit(df, FEATS, ["k"])
    rows = {r.k: r for r in df.collect()}
    x = np.array([[np.nan if r[f] is None else r[f] for f in FEATS] for r in rows.values()])
    sd = np.nanstd(x, axis=0)
    mean, sd = np.nanmean(x, axis=0), np.where(sd > 0, sd, 1)
    z = dict(zip(rows, learner._fourier(np.nan_to_num((x - mean) / sd))))
    drawn = {}
    for r in m.members().collect():
        drawn.setdefault(r.bag, []).append((r.k, r.w))
    for model in m.models.collect():
        bag = [(k, 1) for k, r in rows.items() if r.y == 1] + drawn[model.bag]
        f, w = np.array([z[k] for k, _ in bag]), np.array([t for _, t in bag], dtype=float)
        s = np.array([2 * rows[k].y - 1 for k, _ in bag])
        v = ahead = np.zeros(6)
        for k in range(3):
            g = -(w * s * np.maximum(0, 1 - s * (f @ ahead))) @ f / w.sum() + 0.01 * ahead * np.array([1] * 5 + [0])
            new = ahead - g / 3.01
            ahead, v = new + k / (k + 3) * (new - v), new
        assert np.allclose(model.params, v, atol=1e-12)


@pytest.mark.parametrize("kind", ["kernel_svm", "mlp"])
def test_bags_are_independent_and_sliced(spark, monkeypatch, kind):
    df = _ring(spark, 150).withColumnRenamed("c", "g2")
    df = df.selectExpr("k", "y", "a", "b", "k % 3 AS g")
    make = lambda T, first=0: PUBagging(learner=registry(kind, steps=3), n_estimators=T, max_samples=20, seed=2).fit(df, ["a", "b"], ["k"], axis=["g"], first_bag=first)
    params = lambda m: {(r.g, r.bag): r.params for r in m.models.collect()}
    five = make(5)
    whole = params(five)
    late = params(make(2, 3))
    assert len(whole) == 15 and all(np.allclose(whole[k], v, atol=1e-9) for k, v in late.items())
    monkeypatch.setattr(B, "SLICE_BYTES", 9_000)
    sliced = params(make(5))
    assert all(np.allclose(whole[k], v, atol=1e-9) for k, v in sliced.items())
    scores = five.oob_scores(include_positives=False).collect()
    assert len(scores) == 75 and any(r.n_votes < 5 for r in scores) and all(0 <= r.oob_score <= 1 for r in scores if r.n_votes)


def test_row_weights_count_as_copies(spark):
    df = _ring(spark, 60).selectExpr("k", "y", "a", "b", "CASE WHEN k < 20 THEN 2.0D ELSE 1.0D END AS w")
    twice = df.union(df.filter("k < 20")).selectExpr("k", "y", "a", "b")
    learner = lambda: registry("mlp", hidden=3, steps=4, scale=False, alpha=0.0)
    a = fit_plain(df, ["a", "b"], ["k"], learner=learner(), weight="w").models.first().params
    b = fit_plain(twice, ["a", "b"], ["k"], learner=learner()).models.first().params
    assert np.allclose(a, b, atol=1e-9)


class _Counting:
    """NumPy that counts the numbers it takes exp of."""

    def __init__(self):
        self.numbers = 0

    def __getattr__(self, name):
        return getattr(np, name)

    def exp(self, t, **kw):
        self.numbers += np.size(t)
        return np.exp(t, **kw)


@pytest.mark.parametrize("rows, spread", [(0, 1.0), (1, 1.0), (2500, 1.0), (1025, 400.0)])
def test_hidden_layer_takes_no_exp_per_unit(monkeypatch, rows, spread):
    """Gradient and decision are those of the logistic units by NumPy's tanh, whatever the range; exp is taken once a row."""
    from pubag.operators.learners import gradient as G

    rng = np.random.default_rng(3)
    net = Perceptron(hidden=20)
    z, y, w = rng.normal(size=(rows, 9)) * spread, rng.integers(0, 2, rows).astype(float), rng.integers(1, 4, rows).astype(float)
    p = rng.normal(size=net._size(9))
    w1, b1, w2, b2 = net.parts(p, 9)
    h = (1 + np.tanh((z @ w1 + b1) / 2)) / 2
    back = w * (G.sigmoid(h @ w2 + b2) - y)
    inner = h * (1 - h) * back[:, None] * w2
    want = np.concatenate([(z.T @ inner).ravel(), inner.sum(axis=0), back @ h, [back.sum()]])
    counting = _Counting()
    monkeypatch.setattr(G, "np", counting)
    got = net.gradient(p, z, y, w)
    assert counting.numbers <= rows
    assert np.allclose(got, want, rtol=1e-11, atol=1e-11 * max(1, rows) * spread)
    m = {"w1": w1, "b1": b1, "w2": w2, "b2": b2}
    assert np.allclose(net.np_decision(m, z), h @ w2 + b2, rtol=0, atol=1e-12 * spread)


def test_tanh_by_table():
    """To the last digits between, at and beyond the grid points, without end and missing."""
    from pubag.operators.learners import gradient as G

    x = np.concatenate([np.linspace(-31, 31, 400_001), np.linspace(-2, 2, 400_001), np.arange(-3000, 3000) / 1024, (np.arange(-3000, 3000) + 0.5) / 1024, [0.0]])
    room = lambda v: [np.empty_like(v) for _ in range(3)]
    assert np.abs(G._tanh_3(x.copy(), False, *room(x)) - np.tanh(3 * x)).max() < 5e-16
    end = np.array([np.inf, -np.inf, 1e300, -40.0, np.nan])
    assert np.array_equal(G._tanh_3(end.copy(), True, *room(end)), [1, -1, 1, -1, np.nan], equal_nan=True)
