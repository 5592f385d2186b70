"""Tree learner, MLlib path, and the experiment jobs' published direction."""

from pyspark.sql import functions as F

from pubag.operators import metrics as M
from pubag.operators.bagging import PUBagging, fit_plain
from pubag.operators.learners import registry
from pubag.operators.learners.tree import DecisionTree
from pubag.plans import jobs as J
from pubag.sources.fixtures import DOCS

FEATS = DOCS.features
K = ["doc_id"]


def test_tree_close_to_mllib(spark, docs):
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler
    ours = M.evaluate(fit_plain(docs, FEATS, K, learner=DecisionTree(max_depth=4)).predict(
        docs.select("doc_id", "y", *FEATS)), "y", "yhat").first().accuracy
    va = VectorAssembler(inputCols=FEATS, outputCol="features").transform(docs.withColumn("label", F.col("y").cast("double")))
    pr = DecisionTreeClassifier(maxDepth=4).fit(va).transform(va).withColumn("yhat", F.col("prediction").cast("int"))
    theirs = M.evaluate(pr, "y", "yhat").first().accuracy
    assert abs(ours - theirs) < 0.05


def test_tree_bags_and_oob(docs):
    m = PUBagging(learner=DecisionTree(max_depth=2), n_estimators=3, max_samples=50, seed=1).fit(docs, FEATS, K)
    s = m.oob_scores(include_positives=False)
    vals = [r.oob_score for r in s.collect() if r.oob_score is not None]
    assert vals and all(0.0 <= v <= 1.0 for v in vals)


def test_mllib_learner_oob(docs):
    m = PUBagging(learner=registry("mllib_random_forest"), n_estimators=2, max_samples=50, seed=1).fit(docs, FEATS, K)
    s = m.oob_scores(include_positives=False)
    assert s.count() == docs.filter("y = 0").count()


def test_recovery_direction(docs):
    """After hiding half of the positives, PU recall beats plain recall (the reference's finding)."""
    r = {row.model: row for row in J.hidden_label_recovery(docs, FEATS, K, 42, repeats=2, n_estimators=30).collect()}
    assert r["pu"].recall > r["mod"].recall


def test_grid_candidates_order():
    c = J.grid_candidates()
    assert len(c) == 48
    assert c[0] == {"bagging_fraction": 0.5, "feature_fraction": 0.8, "learning_rate": 0.01,
                    "min_child_samples": 18, "num_leaves": 5}
    assert c[1]["num_leaves"] == 31  # the last key varies fastest


def _area(model, rows):
    p = model.predict_proba(rows.select("doc_id", "y", *FEATS))
    return M.roc_auc(p, "y", "p1").first().auc


def test_forest_and_boosting_near_mllib(spark, docs):
    """One bag of all rows: the area under the curve on the training rows is close to MLlib's."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    va = VectorAssembler(inputCols=FEATS, outputCol="features").transform(docs.withColumn("label", F.col("y").cast("double")))
    pr = GBTClassifier(maxIter=10, maxDepth=3, stepSize=0.5, seed=1).fit(va).transform(va).withColumn("p1", vector_to_array("probability")[1])
    theirs = M.roc_auc(pr, "y", "p1").first().auc
    tree = _area(fit_plain(docs, FEATS, K, learner=DecisionTree(max_depth=3)), docs)
    forest = _area(fit_plain(docs, FEATS, K, learner=registry("random_forest", n_trees=12, max_depth=5)), docs)
    # its margin is half the log-odds, so its step of 0.5 is a step of 1 here
    boosted = _area(fit_plain(docs, FEATS, K, learner=registry("boosted_trees", n_trees=10, learning_rate=1.0, rows=1.0, features=1.0)), docs)
    dart = _area(fit_plain(docs, FEATS, K, learner=registry("boosted_trees", n_trees=10, rows=0.8, drop=0.3)), docs)
    assert forest > tree and boosted > tree and dart > tree
    assert boosted > theirs - 0.03


def test_boosting_matches_numpy(spark):
    """Two rounds of depth 1 on one feature, against the gradients worked out here."""
    import numpy as np
    rng = np.random.default_rng(0)
    x = np.round(rng.random(200), 6)
    y = (rng.random(200) < 0.2 + 0.6 * (x > 0.5)).astype(int)
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(x, y))], "k int, x double, y int")
    m = fit_plain(df, ["x"], ["k"], learner=registry("boosted_trees", n_trees=2, max_depth=1, learning_rate=0.3, rows=1.0, features=1.0))
    cuts = sorted({np.sort(x)[max(0, int(np.ceil(k / 32 * 200)) - 1)] for k in range(1, 32)})
    bins = np.searchsorted(cuts, x)
    margin = np.zeros(200)
    for _ in range(2):
        p = 1 / (1 + np.exp(-margin))
        g, w = y - p, p * (1 - p)
        gain = [(g[bins <= b].sum() ** 2 / w[bins <= b].sum() + g[bins > b].sum() ** 2 / w[bins > b].sum(), -b) for b in range(31)
                if (bins <= b).any() and (bins > b).any()]
        cut = -max(gain)[1]
        margin += 0.3 * np.where(bins <= cut, g[bins <= cut].sum() / w[bins <= cut].sum(), g[bins > cut].sum() / w[bins > cut].sum())
    got = {r.k: r.p1 for r in m.predict_proba(df).collect()}
    assert all(abs(got[i] - 1 / (1 + np.exp(-margin[i]))) < 1e-9 for i in range(200))


def test_forest_of_all_bags_in_one_fit(docs):
    """A bag's forest does not depend on how many bags are fitted with it; its rows out of bag get votes."""
    make = lambda T: PUBagging(learner=registry("random_forest", n_trees=3), n_estimators=T, max_samples=60, seed=1, oob_score=False)
    few, more = make(2).fit(docs, FEATS, K), make(4).fit(docs, FEATS, K)
    a = {(r.doc_id, r.bag): r.p1 for r in few.predict_per_bag(docs).collect()}
    b = {(r.doc_id, r.bag): r.p1 for r in more.predict_per_bag(docs).collect()}
    assert len(b) == 4 * docs.count() and all(abs(b[k] - v) < 1e-12 for k, v in a.items())
