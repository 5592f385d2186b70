"""Metric edge cases (FIXTURES §C) and cross-checks."""

import math

from pyspark.sql import functions as F

from pubag.operators import metrics as M
from pubag.operators import relational as R


def test_roc_ties_collapse(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.5, 1), (0.1, 0)], "score double, y int")
    pts = sorted((r.fpr, r.tpr) for r in M.roc_curve(df).collect())
    assert pts == [(0.0, 0.0), (0.5, 1.0), (1.0, 1.0)]
    auc = M.roc_auc(df).first().auc
    assert math.isclose(auc, 0.75)


def test_auc_matches_mllib(spark, docs):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    d = docs.select(F.col("y").cast("double").alias("label"), F.try_divide("f4", "f1").alias("score"))
    ours = M.roc_auc(d, "label", "score").first().auc
    theirs = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label",
                                           metricName="areaUnderROC").evaluate(d)
    assert math.isclose(ours, theirs, rel_tol=1e-6)


def test_argmax_tie_goes_to_class0(spark):
    df = spark.createDataFrame([(0.5,), (0.6,)], "p double")
    assert [r.c for r in df.select(M.argmax_class("p").alias("c")).collect()] == [0, 1]


def test_empty_denominators(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "y int, yhat int")
    e = M.evaluate(df).first()
    assert e.f1 == 0.0 and e.precision is None and e.recall == 0.0


def test_threshold_equal_in_neither_class(spark):
    df = spark.createDataFrame([(1, 0.5)], "k int, score double")
    assert R.reliable_negatives(df, 0.5).count() == 0
    assert R.pseudo_positives(df, 0.5).count() == 0


def test_union_missing_columns_null(spark):
    a = spark.createDataFrame([(1, 2.0)], "k int, f8 double")
    b = spark.createDataFrame([(2,)], "k int")
    rows = {r.k: r.f8 for r in R.union_tables([a, b]).collect()}
    assert rows == {1: 2.0, 2: None}


def test_class_mean_fill_all_null_stays_null(spark):
    from pubag.functions.nulls import fill_class_mean
    df = spark.createDataFrame([(1, 1, None), (2, 1, None), (3, 0, 4.0), (4, 0, None)], "k int, y int, f double")
    out = {r.k: r.f for r in fill_class_mean(df, ["f"]).collect()}
    assert out == {1: None, 2: None, 3: 4.0, 4: 4.0}


def test_mean_prediction_zero_when_no_vote(spark):
    preds = spark.createDataFrame([(1, 0.4), (1, 0.6)], "k int, p double")
    uni = spark.createDataFrame([(1,), (2,)], "k int")
    out = {r.k: (r.score, r.n_votes) for r in R.mean_prediction(preds, uni, "k").collect()}
    assert out == {1: (0.5, 2), 2: (0.0, 0)}


def test_scores_piled_up_still_spread(spark):
    """99 % of the scores within 1e-6 of the range: several partitions share them, the sums are exact."""
    rows = [(i, (i * 7919) % 1000, 1 if (i * 31) % 3 == 0 else 0) for i in range(20_000)]
    df = spark.createDataFrame(rows, "i int, r int, y int")
    score = F.when(F.col("i") % 100 == 0, F.col("r") / 1000.0).otherwise(F.lit(0.5) + (F.col("i") * F.lit(1e-11)))
    counts = M._score_counts(df.withColumn("score", score), "y", "score", [])
    got = sorted(((r.score, r.tp, r.fp) for r in M._cumulative(counts, []).collect()), reverse=True)
    by = {r.score: (r.pos, r.neg) for r in counts.collect()}
    tp = fp = 0
    for s, a, b in got:
        tp, fp = tp + by[s][0], fp + by[s][1]
        assert (a, b) == (tp, fp)
    assert len(got) == len(by)
    spread = counts.repartitionByRange(8, F.desc("score")).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in spread) < len(by) / 3
