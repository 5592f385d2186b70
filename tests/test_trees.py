"""Trees over rows stored once: against a plain recursive tree, slices, draws by row key, chunks and grids."""

import numpy as np
from pyspark.sql import functions as F

from pubag.operators.bagging import PUBagging, fit_plain
from pubag.operators.learners import bag_sums as B
from pubag.operators.learners import registry
from pubag.operators.learners.tree import DecisionTree
from pubag.plans import jobs as J
from pubag.sources.fixtures import DOCS

FEATS = DOCS.features
K = ["doc_id"]


def _plain_tree(x, y, w, depth, bins=8, node=1, out=None):
    """{node: (feature, bin, value)} by scanning every split of every node's own rows."""
    out = {} if out is None else out
    value = (w * y).sum() / w.sum()
    best = None
    if node < 2 ** depth:
        total = lambda m: (w[m] * y[m]).sum() * (w[m] - w[m] * y[m]).sum() / w[m].sum()
        for f in range(x.shape[1]):
            for b in range(-1, bins):
                left = x[:, f] <= b
                if w[left].sum() >= 1 and w[~left].sum() >= 1:
                    gain = round(total(np.ones(len(x), bool)) - total(left) - total(~left), 9)
                    if gain > 1e-12 and (best is None or gain > best[0]):
                        best = (gain, f, b, left)
    out[node] = (-1, -1, value) if best is None else (best[1], best[2], value)
    if best is not None:
        for child, side in ((2 * node, best[3]), (2 * node + 1, ~best[3])):
            _plain_tree(x[side], y[side], w[side], depth, bins, child, out)
    return out


def _table(spark, n=300, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 9, (n, 3)).astype(float)
    y = ((x[:, 0] > 4) ^ (x[:, 1] > 3) | (rng.random(n) < 0.1)).astype(int)
    rows = [(i, int(y[i]), *(None if rng.random() < 0.05 else float(v) for v in x[i])) for i in range(n)]
    return spark.createDataFrame(rows, "k int, y int, a double, b double, c double")


def test_equals_a_plain_tree_in_every_bag(spark):
    df, feats = _table(spark), ["a", "b", "c"]
    m = PUBagging(learner=DecisionTree(max_depth=3, n_bins=8), n_estimators=3, max_samples=80, seed=2).fit(df, feats, ["k"])
    rows = {r.k: r for r in df.collect()}
    drawn = {}
    for r in m.estimators_samples_.collect():
        drawn.setdefault(r.bag, []).append((r.k, r.w))
    for model in m.models.collect():
        own = sorted(drawn[model.bag])
        x = np.array([[-1 if rows[k][f] is None else min(7, int((rows[k][f] - lo) // wd)) for f, lo, wd in zip(feats, model.lo, model.wd)] for k, _ in own])
        want = _plain_tree(x, np.array([rows[k].y for k, _ in own], float), np.array([w for _, w in own], float), 3)
        got = {n: (f, c, v) for n, (f, c, v) in enumerate(zip(model.feat, model.cut, model.value)) if v is not None}
        assert got.keys() == want.keys()
        assert all(got[n][:2] == want[n][:2] and abs(got[n][2] - want[n][2]) < 1e-12 for n in want)


def test_slices_and_warm_starts_change_nothing(spark, monkeypatch):
    df, feats = _table(spark), ["a", "b", "c"]
    for kind, params in (("tree", {"max_depth": 3}), ("random_forest", {"n_trees": 2, "max_depth": 2}), ("boosted_trees", {"n_trees": 3, "max_depth": 2, "drop": 0.5})):
        make = lambda T, first=0: PUBagging(learner=registry(kind, **params), n_estimators=T, max_samples=60, seed=3).fit(df, feats, ["k"], first_bag=first)  # noqa: E731, B023
        whole = {r.bag: str(r) for r in make(4).models.collect()}
        late = {r.bag: str(r) for r in make(2, 2).models.collect()}
        assert late == {b: whole[b] for b in (2, 3)}
        with monkeypatch.context() as patch:
            patch.setattr(B, "SLICE_BYTES", 1)
            assert {r.bag: str(r) for r in make(4).models.collect()} == whole


def test_equal_rows_have_draws_of_their_own(spark):
    """400 rows of two feature values: a forest's tree weighs them by Poisson draws of each row, not of each value."""
    df = spark.createDataFrame([(i, i % 2, float(i % 2)) for i in range(400)], "k int, y int, x double")
    m = fit_plain(df, ["x"], ["k"], learner=registry("random_forest", n_trees=6, max_depth=1)).models.first()
    r = df.select((F.conv(F.substring(F.md5(F.concat(F.lit("row|"), F.col("k").cast("string"))), 1, 15), 16, 10).cast("long") % B.PRIME).alias("r"))
    r = np.array([v.r for v in r.collect()])
    draws = np.array([B.row_uniform(r, *B.line(0, "forest", 0, t)) for t in range(6)])
    assert len(np.unique(draws)) == draws.size and abs(np.corrcoef(draws)[np.triu_indices(6, 1)]).max() < 0.25
    assert abs(draws.mean() - 0.5) < 0.03
    assert all(t.value[1] != 0.5 for t in m.trees[:3])


def test_chunks_with_trees(docs):
    pos, back = docs.filter("y = 1"), docs.filter("y = 0")
    out = J.chunk_cross_score(pos, back, FEATS, K, 1, 200, learner=DecisionTree(max_depth=2)).collect()
    n = back.count()
    assert len(out) == n and {r.n_votes for r in out} == {-(-n // 200) - 1}
