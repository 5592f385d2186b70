"""Models and areas that do not depend on how the rows are partitioned; null axis values; sums for many models."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pubag.operators import metrics as M
from pubag.operators.bagging import PUBagging, fit_plain
from pubag.operators.learners import bag_sums as B
from pubag.sources.fixtures import DOCS

FEATS = DOCS.features
K = ["doc_id"]


def test_same_digits_for_any_partitioning(spark, docs):
    """Models, probabilities and areas are equal to the last bit for 4, 16 and 200 partitions."""
    rows = docs.select("doc_id", "y", *FEATS).withColumn("r", F.pmod("doc_id", F.lit(2)))
    found = []
    for n in (4, 16, 200):
        df = rows.repartition(n, F.rand(n))
        m = PUBagging(n_estimators=5, max_samples=60, seed=3).fit(df, FEATS, K, axis=["r"])
        p = m.predict_proba(df)
        auc = M.roc_auc(p, "y", "p1", by=["r"]).collect()
        plain = fit_plain(df, FEATS, K).predict_proba(df)
        found.append((sorted((r.doc_id, r.p1) for r in p.collect()), sorted(map(str, m.models.collect())), sorted(map(str, auc)),
                      sorted((r.doc_id, r.p1) for r in plain.collect()), sorted(map(str, m.oob_scores().collect()))))
    assert found[0] == found[1] == found[2]


def test_saturated_scores_are_ties(spark):
    df = spark.createDataFrame([(0, 1 - 1.1e-16), (1, 1 - 3e-16), (1, 1.0), (0, 0.25), (1, 0.25 + 1e-9)], "y int, p1 double")
    # of 6 pairs of a positive and a negative two are ties near 1 and one of the two others at 0.25 is a loss
    assert M.roc_auc(df, "y", "p1").first().auc == pytest.approx((3 + 0.5 * 2) / 6)


def test_moments_are_exact(spark):
    """Means and variances against fractions, with values that cancel, weights and missing values."""
    rng = random.Random(0)
    rows = [(i, i % 2, 10.0 ** rng.randint(-6, 9) + rng.random(), 1e6 + rng.random() * 1e-3, None if i % 5 == 0 else float(rng.randint(-9, 9)), 0.1 + rng.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, y int, a double, b double, c double, w double")
    m = fit_plain(df, ["a", "b", "c"], ["k"]).models.first()
    v = fit_plain(df, ["a", "b", "c"], ["k"], weight="w").models.first()
    for cls in (0, 1):
        for j in range(3):
            known = [(Fraction(r[2 + j]), Fraction(r[5])) for r in rows if r[1] == cls and r[2 + j] is not None]
            mean = sum(x for x, _ in known) / len(known)
            var = sum((x - mean) ** 2 for x, _ in known) / len(known)
            assert m[f"mu{cls}"][j] == pytest.approx(float(mean), rel=1e-15)
            floor = min(m[f"v{cls}"][j] - float(var) for _ in (0,))
            assert floor >= 0 and math.isclose(m[f"v{cls}"][j], float(var) + floor, rel_tol=1e-12)
            total = sum(w for _, w in known)
            assert v[f"mu{cls}"][j] == pytest.approx(float(sum(x * w for x, w in known) / total), rel=1e-14)


def test_limbs_add_up():
    rng = np.random.default_rng(0)
    v = np.concatenate([rng.normal(size=500) * 10.0 ** rng.integers(-20, 3, 500), [0.0, np.nan, -999.0]])
    top = np.int64(B.exponent(np.nanmax(np.abs(v))))
    limbs = B.Exact.cut(v, top).astype(np.int64)
    unit = Fraction(2) ** int(top - B.Exact.LIMBS * B.Exact.BITS)
    for order in (np.arange(len(v)), rng.permutation(len(v))):
        total = B.Exact.whole(limbs[order].sum(axis=0)) * unit
        assert abs(total - sum(Fraction(x) for x in v if x == x)) <= len(v) * unit
    p, lack = B.squares(v[:500])
    assert all(Fraction(a) + Fraction(b) == Fraction(x) ** 2 for a, b, x in zip(p, lack, v) if abs(x) > 1e-100)


@pytest.mark.parametrize("mode, bootstrap", [("exact", True), ("poisson", True), ("exact", False)])
def test_null_axis_values_are_a_group(spark, mode, bootstrap):
    """Rows whose axis value is null are one more axis value, with bags, votes and probabilities of its own."""
    rng = random.Random(1)
    rows = [(i, ("a", "b", None)[i % 3], int(i % 6 < 3), rng.gauss(i % 6 < 3, 1), rng.gauss(0, 1)) for i in range(240)]
    df = spark.createDataFrame(rows, "k int, g string, y int, x double, z double")
    m = PUBagging(n_estimators=6, max_samples=20, seed=1, mode=mode, bootstrap=bootstrap, oob_score=bootstrap).fit(df, ["x", "z"], ["k"], axis=["g"])
    got = m.predict_proba(df).collect()
    assert len(got) == 240 and all(r.p1 is not None for r in got)
    members = m.members().groupBy("g").agg(F.sum("w").alias("n")).collect()
    assert {r.g for r in members} == {"a", "b", None}
    votes = m.oob_scores(include_positives=False).collect()
    assert len(votes) == 120 and sum(r.n_votes > 0 for r in votes if r.g is None) >= 38
    # the model of the null group is that of its rows alone under another name
    assert m.models.filter("g IS NULL").count() == 6
    plain = fit_plain(df, ["x", "z"], ["k"], axis=["g"])
    alone = fit_plain(df.filter("g IS NULL"), ["x", "z"], ["k"])
    assert plain.models.filter("g IS NULL").first().mu1 == alone.models.first().mu1


def test_models_are_trained_in_slices(spark, docs, monkeypatch):
    make = lambda: PUBagging(n_estimators=7, max_samples=40, seed=5).fit(docs.withColumn("r", F.pmod("doc_id", F.lit(3))), FEATS, K, axis=["r"])
    whole = sorted(map(str, make().models.collect()))
    for size in (1, 5_000, 60_000):
        monkeypatch.setattr(B, "SLICE_BYTES", size)
        monkeypatch.setattr(B, "BLOB_BYTES", 3_000)
        monkeypatch.setattr(B, "MERGE", 2)
        assert sorted(map(str, make().models.collect())) == whole
