"""Evaluation: confusion counts, accuracy/recall/precision/F1/TPR, ROC curve and AUC.

All metrics of one evaluation come from a single aggregate (AG14) grouped by
whatever axis columns the caller has (repeat, model, variant, cell, fold…).

ROC / AUC: scores are first reduced to distinct values with their positive and
negative counts. Cumulative counts in descending score order need a running
sum; instead of one window over the whole table (one task), the distinct
scores are range-partitioned, one sum per partition gives its offset, and the
running sum runs inside each partition. AUC is then a plain sum:
sum_i neg_i * (2 * tp_i - pos_i) / (2 * P * N), the trapezoid rule with the
previous point recovered from the row's own counts (no lag needed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pubag.session import kept


# Fixed value: scores are told apart in units of its inverse when they are ranked for an area.
TIES = 1e12


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def confusion(df: DataFrame, y: str = "y", yhat: str = "yhat", by=()) -> DataFrame:
    """AG14: tp, fp, tn, fn per axis value (four conditional sums, one aggregate)."""
    yc, pc = _c(y), _c(yhat)
    return df.groupBy(*by).agg(
        F.sum(F.when((yc == 1) & (pc == 1), 1).otherwise(0)).cast("bigint").alias("tp"),
        F.sum(F.when((yc == 0) & (pc == 1), 1).otherwise(0)).cast("bigint").alias("fp"),
        F.sum(F.when((yc == 0) & (pc == 0), 1).otherwise(0)).cast("bigint").alias("tn"),
        F.sum(F.when((yc == 1) & (pc == 0), 1).otherwise(0)).cast("bigint").alias("fn"),
    )


def accuracy(tp="tp", fp="fp", tn="tn", fn="fn") -> Column:
    """ME1."""
    return F.try_divide((F.col(tp) + F.col(tn)).cast("double"), (F.col(tp) + F.col(fp) + F.col(tn) + F.col(fn)).cast("double"))


def recall(tp="tp", fn="fn") -> Column:
    """ME3 (= ME2 TPR): tp / (tp + fn), NULL when there are no positives."""
    return F.try_divide(F.col(tp).cast("double"), (F.col(tp) + F.col(fn)).cast("double"))


def precision(tp="tp", fp="fp") -> Column:
    """ME4: tp / (tp + fp), NULL when nothing is predicted positive."""
    return F.try_divide(F.col(tp).cast("double"), (F.col(tp) + F.col(fp)).cast("double"))


def f1(tp="tp", fp="fp", fn="fn") -> Column:
    """ME5: 2tp / (2tp + fp + fn), 0 when undefined."""
    return F.coalesce(F.try_divide((2 * F.col(tp)).cast("double"), (2 * F.col(tp) + F.col(fp) + F.col(fn)).cast("double")),
                      F.lit(0.0))


def balanced_accuracy(tp="tp", fp="fp", tn="tn", fn="fn") -> Column:
    """ME7: 'AUC' of hard labels = (TPR + TNR) / 2."""
    tnr = F.try_divide(F.col(tn).cast("double"), (F.col(tn) + F.col(fp)).cast("double"))
    return (recall(tp, fn) + tnr) / F.lit(2.0)


def evaluate(df: DataFrame, y: str = "y", yhat: str = "yhat", by=()) -> DataFrame:
    """ME8 (+ME1-ME5, ME7): every hard-label metric from one aggregate."""
    c = confusion(df, y, yhat, by)
    return c.select(*by, "tp", "fp", "tn", "fn",
                    accuracy().alias("accuracy"), recall().alias("recall"), precision().alias("precision"),
                    f1().alias("f1"), balanced_accuracy().alias("auc_hard"))


def tpr(df: DataFrame, y: str = "y", yhat: str = "yhat", by=()) -> DataFrame:
    """ME2: share of positives predicted positive."""
    return df.filter(_c(y) == 1).groupBy(*by).agg(F.avg(_c(yhat).cast("double")).alias("tpr"))


def argmax_class(p1) -> Column:
    """WI3 (two classes): class 1 only if p1 > p0; ties go to class 0."""
    p = _c(p1)
    return F.when(p > F.lit(1.0) - p, 1).otherwise(0).cast("int")


def argmax_k(df: DataFrame, key, cls: str = "cls", p: str = "p") -> DataFrame:
    """WI3 (k classes): highest probability per row, the first class wins ties."""
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(F.col(p).desc(), F.col(cls))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def _score_counts(df: DataFrame, y: str, score, by: list[str]) -> DataFrame:
    return df.filter(_c(score).isNotNull()).groupBy(*by, _c(score).alias("score")).agg(
        F.sum(F.when(_c(y) == 1, 1).otherwise(0)).cast("bigint").alias("pos"),
        F.sum(F.when(_c(y) == 1, 0).otherwise(1)).cast("bigint").alias("neg"),
    )


def _cumulative(d: DataFrame, by: list[str]) -> DataFrame:
    """Add tp/fp = positives/negatives with score >= this score (descending running sums) and the
    totals P and N per axis value.

    Distinct scores are range-partitioned (axis, score descending): cut points follow the
    data, so scores piled up in a narrow range still spread over tasks. One sum per range
    partition gives the offsets; only the first axis value of a partition can have started
    before it, so the table of offsets has at most one row per partition.
    """
    names = [f"_k_{i}" for i in range(len(by))]
    n = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    d = kept(d.repartitionByRange(n, *by, F.desc("score")).withColumn("_part", F.spark_partition_id()))

    def same(*more: Column) -> Column:
        on = F.lit(True)
        for b, k in zip(by, names):
            on = on & F.col(b).eqNullSafe(F.col(k))
        for m in more:
            on = on & m
        return on

    renamed = [F.col(b).alias(k) for b, k in zip(by, names)]
    per = d.groupBy("_part", *by).agg(F.sum("pos").alias("_bp"), F.sum("neg").alias("_bn"))
    ahead = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (per.select(F.col("_part").alias("_part2"), *renamed, F.sum("_bp").over(ahead).alias("_op"), F.sum("_bn").over(ahead).alias("_on"))
               .filter(F.col("_op").isNotNull()))
    inside = Window.partitionBy("_part", *by).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    out = d.join(F.broadcast(offsets), same(F.col("_part") == F.col("_part2")), "left")
    for name, value, off in (("tp", "pos", "_op"), ("fp", "neg", "_on")):
        out = out.withColumn(name, (F.coalesce(off, F.lit(0)) + F.sum(value).over(inside)).cast("bigint"))
    out = out.drop("_part", "_part2", "_op", "_on", *names)
    totals = d.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    if not by:
        one = totals.first()  # two numbers
        return out.withColumns({"P": F.lit(one["P"]).cast("bigint"), "N": F.lit(one["N"]).cast("bigint")})
    return out.join(totals.select(*renamed, "P", "N"), same()).drop(*names)


def roc_curve(df: DataFrame, y: str = "y", score: str = "score", by=()) -> DataFrame:
    """WI1: (threshold, fpr, tpr) at every distinct score, descending, plus the origin.

    Tied scores are one point. fpr/tpr are NULL when a class is absent.
    """
    by = list(by)
    d = _cumulative(_score_counts(df, y, score, by), by)
    pts = d.select(*by, F.col("score").alias("threshold"),
                   F.try_divide(F.col("fp").cast("double"), F.col("N").cast("double")).alias("fpr"),
                   F.try_divide(F.col("tp").cast("double"), F.col("P").cast("double")).alias("tpr"))
    origin = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    origin = origin.select(*by, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"),
                           F.lit(0.0).alias("tpr"))
    return pts.unionByName(origin)


def roc_auc(df: DataFrame, y: str = "y", score: str = "score", by=()) -> DataFrame:
    """WI2 / ME6: trapezoid area under the ROC curve per axis value (NULL if a class is absent).

    Scores that agree to 12 decimals are ties: near 0 and 1 saturated probabilities lie closer than the
    rounding of a sum of votes, and their order would be that of the summation."""
    by = list(by)
    d = _cumulative(_score_counts(df, y, F.rint(_c(score) * F.lit(TIES)), by), by)
    area = F.sum((F.col("neg") * (2 * F.col("tp") - F.col("pos"))).cast("double"))
    return d.groupBy(*by).agg(
        F.try_divide(area, F.lit(2.0) * F.first("P").cast("double") * F.first("N").cast("double")).alias("auc"))
