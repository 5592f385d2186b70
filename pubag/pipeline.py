"""PU1 and PU2 as ``pyspark.ml`` stages: an Estimator and a Model with Params, for Pipelines and tuning.

``PUClassifier`` fits ``PUBagging`` with any registered learner; ``PUClassificationModel`` adds probability and
prediction columns. Both save to a folder and load again, alone or inside a Pipeline; a loaded model predicts as
before (out-of-bag scores need the training rows and are those of ``fit``).
"""

from __future__ import annotations

import json
import os

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame


class _PUParams(Params):
    learner = Param(Params._dummy(), "learner", "name of a registered base learner", TypeConverters.toString)
    learnerParams = Param(Params._dummy(), "learnerParams", "its settings as JSON", TypeConverters.toString)
    featureCols = Param(Params._dummy(), "featureCols", "feature columns", TypeConverters.toListString)
    keyCols = Param(Params._dummy(), "keyCols", "columns that identify a row", TypeConverters.toListString)
    axisCols = Param(Params._dummy(), "axisCols", "columns whose values have models of their own", TypeConverters.toListString)
    labelCol = Param(Params._dummy(), "labelCol", "0 (unlabelled) or 1 (positive)", TypeConverters.toString)
    weightCol = Param(Params._dummy(), "weightCol", "row weights (empty: none)", TypeConverters.toString)
    numBags = Param(Params._dummy(), "numBags", "bags", TypeConverters.toInt)
    maxSamples = Param(Params._dummy(), "maxSamples", "draws a bag: a number of rows, a share of the unlabelled rows, or n_pos", TypeConverters.toString)
    mode = Param(Params._dummy(), "mode", "exact or poisson", TypeConverters.toString)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)
    probabilityCol = Param(Params._dummy(), "probabilityCol", "p(positive), added by transform", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "0 or 1, added by transform", TypeConverters.toString)

    def _defaults(self):
        self._setDefault(learner="gnb", learnerParams="{}", axisCols=[], labelCol="y", weightCol="", numBags=10, maxSamples="1.0", mode="exact", seed=0,
                         probabilityCol="p1", predictionCol="yhat")


def _draws(text: str):
    if text == "n_pos":
        return text
    return int(text) if text.lstrip("+-").isdigit() else float(text)


class PUClassifier(Estimator, _PUParams, MLReadable, MLWritable):
    @keyword_only
    def __init__(self, *, learner=None, learnerParams=None, featureCols=None, keyCols=None, axisCols=None, labelCol=None, weightCol=None, numBags=None,
                 maxSamples=None, mode=None, seed=None, probabilityCol=None, predictionCol=None):
        super().__init__()
        self._defaults()
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _bagging(self):
        from pubag.operators.bagging import PUBagging
        from pubag.operators.learners import registry

        g = self.getOrDefault
        return PUBagging(learner=registry(g("learner"), **json.loads(g("learnerParams"))), n_estimators=g("numBags"), max_samples=_draws(g("maxSamples")),
                         seed=g("seed"), mode=g("mode"))

    def _fit(self, dataset: DataFrame) -> PUClassificationModel:
        g = self.getOrDefault
        fitted = self._bagging().fit(dataset, g("featureCols"), g("keyCols"), g("labelCol"), g("axisCols"), g("weightCol") or None)
        return self._copyValues(PUClassificationModel(fitted))

    def write(self) -> MLWriter:
        return DefaultParamsWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return DefaultParamsReader(cls)


class PUClassificationModel(Model, _PUParams, MLReadable, MLWritable):
    """``ensemble`` is the fitted :class:`pubag.operators.bagging.PUModel`."""

    def __init__(self, ensemble=None):
        super().__init__()
        self._defaults()
        self.ensemble = ensemble

    def _transform(self, dataset: DataFrame) -> DataFrame:
        from pubag.operators.metrics import argmax_class

        p = self.getOrDefault("probabilityCol")
        return self.ensemble.predict_proba(dataset, p).withColumn(self.getOrDefault("predictionCol"), argmax_class(p))

    def write(self) -> MLWriter:
        return _ModelWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ModelReader()


class _ModelWriter(MLWriter):
    def __init__(self, model: PUClassificationModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        from pubag.sources.io import save_ensemble

        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        save_ensemble(self.model.ensemble, os.path.join(path, "ensemble"))


class _ModelReader(MLReader):
    def load(self, path: str) -> PUClassificationModel:
        from pubag.sources.io import load_ensemble

        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = PUClassificationModel(load_ensemble(self.sparkSession, os.path.join(path, "ensemble")))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
