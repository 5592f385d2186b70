"""PU1 / PU2 as stages: params, a Pipeline, saving and loading with every learner."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer

from pubag.operators.bagging import PUBagging
from pubag.operators.learners import registry
from pubag.pipeline import PUClassificationModel, PUClassifier
from pubag.sources.fixtures import DOCS

FEATS = DOCS.features[:3]
SMALL = {"gnb": "{}", "tree": '{"max_depth": 2}', "random_forest": '{"n_trees": 2, "max_depth": 2}',
         "boosted_trees": '{"n_trees": 2, "max_depth": 2}', "kernel_svm": '{"dim": 4, "steps": 2}', "mlp": '{"hidden": 3, "steps": 2}'}


@pytest.mark.parametrize("kind", list(SMALL))
def test_models_of_all_learners_save_and_load(docs, tmp_path, kind):
    est = PUClassifier(learner=kind, learnerParams=SMALL[kind], featureCols=FEATS, keyCols=["doc_id"], numBags=3, maxSamples="40", seed=5)
    model = est.fit(docs)
    want = {r.doc_id: (r.p1, r.yhat) for r in model.transform(docs).collect()}
    model.write().overwrite().save(str(tmp_path / "m"))
    loaded = PUClassificationModel.load(str(tmp_path / "m"))
    assert loaded.uid == model.uid and loaded.getOrDefault("numBags") == 3
    assert {r.doc_id: (r.p1, r.yhat) for r in loaded.transform(docs).collect()} == want


def test_pipeline_and_params(docs, tmp_path):
    est = PUClassifier(featureCols=["f1", "lf2"], keyCols=["doc_id"], numBags=2, maxSamples="n_pos", predictionCol="z", seed=1)
    pipe = Pipeline(stages=[SQLTransformer(statement="SELECT *, ln(f2 + 1) AS lf2 FROM __THIS__"), est])
    fitted = pipe.fit(docs)
    rows = fitted.transform(docs).select("doc_id", "p1", "z").collect()
    direct = PUBagging(learner=registry("gnb"), n_estimators=2, max_samples="n_pos", seed=1).fit(
        docs.selectExpr("*", "ln(f2 + 1) AS lf2"), ["f1", "lf2"], ["doc_id"])
    want = {r.doc_id: r.p1 for r in direct.predict_proba(docs.selectExpr("doc_id", "f1", "ln(f2 + 1) AS lf2")).collect()}
    assert {r.doc_id: r.p1 for r in rows} == want and all(r.z == int(r.p1 > 1 - r.p1) for r in rows)
    fitted.write().overwrite().save(str(tmp_path / "p"))
    again = PipelineModel.load(str(tmp_path / "p"))
    assert {r.doc_id: r.p1 for r in again.transform(docs).collect()} == want
    est.write().overwrite().save(str(tmp_path / "e"))
    assert PUClassifier.load(str(tmp_path / "e")).extractParamMap().keys() == est.extractParamMap().keys()
    assert est.copy({est.numBags: 7}).getOrDefault("numBags") == 7
