"""Feature contributions (additivity) and streaming scoring."""

import math
import os
import tempfile

from pyspark.sql import functions as F

from pubag.operators import explain as X
from pubag.operators.bagging import PUBagging, fit_plain
from pubag.sources.fixtures import DOCS

FEATS = DOCS.features
K = ["doc_id"]


def test_additive_phi_sums_to_margin_gap(docs):
    m = fit_plain(docs, FEATS, K)
    d = docs.select("doc_id", *FEATS)
    phi = X.contributions(m, d)
    s = {r.doc_id: r.s for r in phi.groupBy("doc_id").agg(F.sum("phi").alias("s")).collect()}
    mg = m.decision_function(d).select("doc_id", "margin")
    mean_m = mg.agg(F.avg("margin")).first()[0]
    for r in mg.limit(50).collect():
        assert math.isclose(s[r.doc_id], r.margin - mean_m, rel_tol=1e-6, abs_tol=1e-6)
    inter = X.interactions(phi, K, FEATS)
    assert inter.filter((F.col("feature_i") != F.col("feature_j")) & (F.col("value") != 0)).count() == 0


def test_contributions_per_axis_value_sum_to_zero(docs):
    d = docs.filter("grp in ('en', 'fr')")
    m = fit_plain(d, FEATS, K, axis=["grp"])
    phi = X.contributions(m, d.select("grp", "doc_id", *FEATS))
    for r in phi.groupBy("grp", "feature").agg(F.avg("phi").alias("m"), F.max(F.abs("phi")).alias("top")).collect():
        assert abs(r.m) <= 1e-9 * max(1.0, r.top)
    two = X.coalition_contributions(fit_plain(d, FEATS[:2], K, axis=["grp"]), d.limit(2), d, 10, 1)
    for r in two.groupBy("grp", "doc_id").agg(F.sum("phi").alias("s"), F.first("fx").alias("fx"), F.first("ef").alias("ef")).collect():
        assert math.isclose(r.s, r.fx - r.ef, abs_tol=1e-9)


def test_coalition_phi_efficiency(docs):
    m = PUBagging(n_estimators=3, max_samples=50, seed=1, oob_score=False).fit(docs, FEATS[:3], K)
    ex = docs.limit(2)
    phi = X.coalition_contributions(m, ex, docs, 20, 1)
    for r in phi.groupBy("doc_id").agg(F.sum("phi").alias("s"), F.first("fx").alias("fx"),
                                       F.first("ef").alias("ef")).collect():
        assert math.isclose(r.s, r.fx - r.ef, rel_tol=1e-9, abs_tol=1e-9)


def test_score_stream_matches_batch(spark, docs):
    from pubag.streaming.scoring import score_files
    m = PUBagging(n_estimators=3, max_samples=50, seed=1, oob_score=False).fit(docs, FEATS, K)
    base = tempfile.mkdtemp(prefix="pubag-stream-", dir="/tmp")
    src = os.path.join(base, "in")
    feats = docs.select("doc_id", *FEATS)
    feats.write.parquet(src)
    q = score_files(m, spark, src, feats.schema, os.path.join(base, "out"), os.path.join(base, "ckpt"))
    q.awaitTermination(120)
    got = {r.doc_id: r.p1 for r in spark.read.parquet(os.path.join(base, "out")).collect()}
    want = {r.doc_id: r.p1 for r in m.predict_proba(feats).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-12) for k in want)
