"""MLlib's own learners, for comparison with BL3 to BL6 (names ``mllib_…``): one distributed fit per
(axis, bag), submitted concurrently.

Their fits cannot be folded into one pass for all bags, so each bag's rows are a
filtered view of the (checkpointed) bagged table and every bag is an ordinary
MLlib fit using ``weightCol`` for the bootstrap multiplicity; learners without
weights (the MLP) get their rows replicated w times (the reference's row path).
Fits run from a small driver thread pool, so several Spark jobs share the
cluster; the models stay MLlib models and predictions come back as a long
(axis…, key…, bag, p1) table averaged by key.

Mapping of the reference's learners:
  random_forest  RandomForestClassifier(numTrees=10, seed=0), registered as mllib_random_forest
  boosted_trees  GBTClassifier with the tuned settings (step 0.5, subsample 0.5,
                 feature fraction 0.8, min rows per node 18, depth 3 ~ 5 leaves), registered
                 as mllib_boosted_trees; no drop-out
  kernel_svm     random Fourier features of the RBF kernel (gamma = 1/d, hash-drawn
                 weights, Box-Muller) + LinearSVC; hard votes, no probabilities.
  mlp            MultilayerPerceptronClassifier(layers=[d, 100, 2]); no weights ->
                 rows replicated by multiplicity.
"""

from __future__ import annotations

import hashlib
import math
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Number of random Fourier features and concurrent fits.
RFF_DIM = 100
PARALLEL_FITS = 4


def _u01(*parts) -> float:
    return (int(hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()[:15], 16) + 0.5) / float(2 ** 60)


def rff_columns(features: list[str], seed, dim: int = RFF_DIM, gamma: float | None = None) -> list[Column]:
    """sqrt(2/D) cos(w.x + b), w ~ N(0, 2 gamma) by Box-Muller on hash uniforms, b ~ U(0, 2 pi)."""
    d = len(features)
    gamma = gamma if gamma is not None else 1.0 / d
    sd = math.sqrt(2.0 * gamma)
    cols = []
    for k in range(dim):
        dot = None
        for j, f in enumerate(features):
            u1, u2 = _u01(seed, "rff", k, j, 1), _u01(seed, "rff", k, j, 2)
            wkj = sd * math.sqrt(-2.0 * math.log(u1)) * math.cos(2 * math.pi * u2)
            t = F.coalesce(F.col(f).cast("double"), F.lit(0.0)) * F.lit(wkj)
            dot = t if dot is None else dot + t
        b = 2 * math.pi * _u01(seed, "rff-b", k)
        cols.append((F.lit(math.sqrt(2.0 / dim)) * F.cos(dot + F.lit(b))).alias(f"_rff{k}"))
    return cols


class MLlibLearner:
    external = True
    takes_weight = True

    def __init__(self, kind: str, seed: int = 0, scale: bool = True, **params):
        self.kind = kind
        self.seed = seed
        self.params = params
        self.has_proba = kind != "kernel_svm"
        self.takes_weight = kind != "mlp"
        self.scale = scale

    # -- feature vector ------------------------------------------------------------
    def _vector(self, df: DataFrame, features: list[str]) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        if self.kind == "kernel_svm":
            df = df.select("*", *rff_columns(features, self.seed))
            cols = [f"_rff{k}" for k in range(RFF_DIM)]
        else:
            cols = list(features)
        filled = df.fillna(0.0, subset=cols)
        return VectorAssembler(inputCols=cols, outputCol="_features", handleInvalid="keep").transform(filled)

    def _estimator(self, d: int):
        from pyspark.ml import classification as C

        p = dict(self.params)
        common = dict(featuresCol="_features", labelCol="_label")
        if self.kind == "random_forest":
            return C.RandomForestClassifier(numTrees=p.get("numTrees", 10), seed=self.seed, weightCol="_w", **common)
        if self.kind == "boosted_trees":
            return C.GBTClassifier(maxIter=p.get("maxIter", 20), stepSize=p.get("stepSize", 0.5),
                                   subsamplingRate=p.get("subsamplingRate", 0.5),
                                   featureSubsetStrategy=p.get("featureSubsetStrategy", "0.8"),
                                   minInstancesPerNode=p.get("minInstancesPerNode", 18), maxDepth=p.get("maxDepth", 3),
                                   seed=self.seed, weightCol="_w", **common)
        if self.kind == "kernel_svm":
            return C.LinearSVC(maxIter=p.get("maxIter", 50), regParam=p.get("regParam", 0.01), weightCol="_w", **common)
        if self.kind == "mlp":
            return C.MultilayerPerceptronClassifier(layers=[d, p.get("hidden", 100), 2], seed=self.seed,
                                                    maxIter=p.get("maxIter", 100), **common)
        raise ValueError(self.kind)

    # -- fit: one MLlib model per (axis, bag) ---------------------------------------
    def fit_external(self, bagged: DataFrame, features: list[str], axis: list[str], label: str = "y") -> dict:
        from pubag.session import kept

        data = bagged.select(*axis, "bag", F.col(label).cast("double").alias("_label"),
                             F.col("w").cast("double").alias("_w"), *features)
        if not self.takes_weight:
            data = data.withColumn("_rep", F.explode(F.array_repeat(F.lit(1), F.col("_w").cast("int")))).drop("_rep")
        data = kept(self._vector(data, features).select(*axis, "bag", "_label", "_w", "_features"))
        keys = [tuple(r) for r in data.select(*axis, "bag").distinct().orderBy(*axis, "bag").collect()]
        cols = [*axis, "bag"]

        def one(k):
            cond = None
            for c, v in zip(cols, k):
                e = F.col(c) == F.lit(v)
                cond = e if cond is None else cond & e
            return k, self._estimator(len(features)).fit(data.filter(cond))

        with ThreadPoolExecutor(max_workers=PARALLEL_FITS) as pool:
            return dict(pool.map(one, keys))

    # -- scoring: long table (axis…, key…, bag, p1) ---------------------------------
    def score_long(self, df: DataFrame, models: dict, features: list[str], axis: list[str], keep: list[str]) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        vec = self._vector(df, features)
        outs = []
        for k, model in models.items():
            cond = None
            for c, v in zip(axis, k[:-1]):
                e = F.col(c) == F.lit(v)
                cond = e if cond is None else cond & e
            part = vec.filter(cond) if cond is not None else vec
            t = model.transform(part)
            if self.has_proba:
                p = vector_to_array("probability")[1]
            else:
                p = F.col("prediction").cast("double")
            outs.append(t.select(*keep, F.lit(int(k[-1])).alias("bag"), p.alias("_p")))
        out = outs[0]
        for o in outs[1:]:
            out = out.unionByName(o)
        return out
