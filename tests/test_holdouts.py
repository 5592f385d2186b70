"""EX6: plain models of hold-outs from the statistics of the rows, which are not copied per hold-out."""

from pyspark.sql import functions as F

from pubag.operators.bagging import fit_plain
from pubag.operators.learners.gnb import GaussianNB
from pubag.plans import jobs as J


def test_models_of_holdouts_are_those_of_the_rows_left(spark):
    """A row may be held out several times or never; the models are equal to the last bit."""
    rows = spark.range(0, 200, 1, 4).select(
        (F.col("id") % 3).cast("int").alias("resample"), "id", (F.col("id") % 2).cast("int").alias("y"), F.rand(1).alias("x"), (F.rand(2) * 1e6).alias("z"),
        F.filter(F.array(*[F.when(F.col("id") % (b + 5) == 0, F.lit(b)) for b in range(4)]), lambda v: v.isNotNull()).alias("_out"))
    rows = rows.checkpoint()
    got = J._holdout_models(rows, ["x", "z"], ["id"], ["resample", "holdout"], "_out", 4, GaussianNB())
    left = rows.withColumn("holdout", F.explode(F.array_except(F.array(*[F.lit(b) for b in range(4)]), "_out")))
    want = fit_plain(left, ["x", "z"], ["id"], axis=["resample", "holdout"])
    cols = ["resample", "holdout", "bag", "n0", "mu0", "v0", "n1", "mu1", "v1"]
    read = lambda m: sorted(tuple(map(str, r)) for r in m.models.select(*cols).collect())
    assert len(read(got)) == 12 and read(got) == read(want)


def test_equal_rows_are_held_out_one_by_one(spark, monkeypatch):
    """Of rows that agree in everything, exactly ``n_test`` per class are scored, and no row is copied for a plain fit."""
    df = spark.range(0, 60, 1, 2).select((F.col("id") % 20).alias("id"), (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 20).cast("double").alias("a"),
                                         (F.col("id") % 7 * 0.0 + F.col("id") % 20).alias("b"), (F.col("id") % 20 * 2.0).alias("c"))
    seen = []
    monkeypatch.setattr(J, "fit_plain", lambda *a, **k: 1 / 0)
    monkeypatch.setattr(J.M, "evaluate", lambda pred, *a, **k: seen.append(pred) or (_ for _ in ()).throw(StopIteration))
    try:
        J.feature_ablation(df, ["a", "c"], ["b"], ["id"], 1, n_test=4, resamples=2, holdouts=3, n_estimators=2)
    except StopIteration:
        pass
    got = seen[0].groupBy("variant", "resample", "holdout", "y_true").count().collect()
    assert len(got) == 4 * 2 * 3 * 2 and all(r["count"] == 4 for r in got)
