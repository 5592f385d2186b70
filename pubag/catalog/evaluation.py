"""Registered queries: ROC/AUC, argmax, confusion counts and hard-label metrics (WI1-3, AG14, ME*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pubag.catalog import sqlfrag as Q
from pubag.catalog.common import SEED, r6, with_sql
from pubag.operators import metrics as M
from pubag.operators.bagging import PUBagging
from pubag.sources.fixtures import DOCS, VEC_DIM, pu_docs, pu_vec

FEATS = DOCS.features


def _score():
    return F.try_divide(F.col("f4"), F.col("f1"))


def wi1_roc_curve(spark, sf):
    d = pu_docs(spark, sf).withColumn("score", _score())
    r = M.roc_curve(d, "y", "score", by=["grp"])
    return r.select("grp", r6("threshold").alias("threshold"), r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


def wi2_auc(spark, sf):
    d = pu_docs(spark, sf).withColumn("score", _score())
    return M.roc_auc(d, "y", "score", by=["grp"]).select("grp", r6("auc").alias("auc"))


def wi3_argmax_class(spark, sf):
    """WI3: k classes: the class with the highest score (the embedding dims), first wins ties."""
    v = pu_vec(spark, sf)
    long = v.select("vec_id", F.posexplode(F.array(*[F.round(F.col(f"e{i}"), 1) for i in range(VEC_DIM)])).alias("cls", "p"))
    return M.argmax_k(long, "vec_id", "cls", "p").select("vec_id", F.col("cls").cast("int").alias("cls"))


def _pred(spark, sf):
    """Ensemble predictions of the documents with a quality label (the truth)."""
    d = pu_docs(spark, sf)
    m = PUBagging(n_estimators=10, max_samples=100, seed=SEED).fit(d, FEATS, "doc_id")
    p = m.predict_proba(d.filter(F.col("y_true").isNotNull()).select("doc_id", "grp", "y_true", *FEATS))
    return p.withColumn("yhat", M.argmax_class("p1"))


def ag14_confusion(spark, sf):
    return M.confusion(_pred(spark, sf), "y_true", "yhat", by=["grp"])


def _metric(col_fn, name):
    def q(spark, sf):
        c = M.confusion(_pred(spark, sf), "y_true", "yhat", by=["grp"])
        return c.select("grp", r6(col_fn()).alias(name))
    return q


me1_accuracy = _metric(M.accuracy, "accuracy")
me3_recall = _metric(M.recall, "recall")
me4_precision = _metric(M.precision, "precision")
me5_f1 = _metric(M.f1, "f1")
me7_auc_of_hard_labels = _metric(M.balanced_accuracy, "auc_hard")


def me2_tpr(spark, sf):
    return M.tpr(_pred(spark, sf), "y_true", "yhat", by=["grp"]).select("grp", r6("tpr").alias("tpr"))


def me6_roc_auc(spark, sf):
    return M.roc_auc(_pred(spark, sf), "y_true", "p1", by=["grp"]).select("grp", r6("auc").alias("auc"))


def me8_evaluate_model(spark, sf):
    e = M.evaluate(_pred(spark, sf), "y_true", "yhat", by=["grp"])
    return e.select("grp", r6("f1").alias("f1"), r6("accuracy").alias("accuracy"), r6("recall").alias("recall"))


QUERIES = {
    "wi1_roc_curve": wi1_roc_curve, "wi2_auc": wi2_auc, "wi3_argmax_class": wi3_argmax_class,
    "ag14_confusion": ag14_confusion, "me1_accuracy": me1_accuracy, "me2_tpr": me2_tpr, "me3_recall": me3_recall,
    "me4_precision": me4_precision, "me5_f1": me5_f1, "me6_roc_auc": me6_roc_auc,
    "me7_auc_of_hard_labels": me7_auc_of_hard_labels, "me8_evaluate_model": me8_evaluate_model,
}

# ---------------------------------------------------------------------------------- SQL

D = [Q.PU_DOCS]
SC = "sc AS (SELECT grp, y, f4 / nullif(f1, 0) AS score FROM pu_docs)"
CNT = """cnt AS (SELECT grp, score, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos,
  sum(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS neg FROM sc WHERE score IS NOT NULL GROUP BY grp, score),
cum AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
  sum(pos) OVER (PARTITION BY grp) AS P, sum(neg) OVER (PARTITION BY grp) AS N
  FROM cnt WINDOW w AS (PARTITION BY grp ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

_FIT = Q.gnb_fit_ctes("pu_docs", ["doc_id"], FEATS, SEED, 10, 100)
_PRED = f"""pred AS (
  SELECT r.doc_id, any_value(r.grp) AS grp, any_value(r.y_true) AS y_true, avg({Q.gnb_p1(FEATS)}) AS p1
  FROM pu_docs r, g_model m WHERE r.y_true IS NOT NULL GROUP BY r.doc_id),
pr AS (SELECT *, CASE WHEN p1 > 1.0 - p1 THEN 1 ELSE 0 END AS yhat FROM pred),
cf AS (SELECT grp,
  CAST(sum(CASE WHEN y_true = 1 AND yhat = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN y_true = 0 AND yhat = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN y_true = 0 AND yhat = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
  CAST(sum(CASE WHEN y_true = 1 AND yhat = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM pr GROUP BY grp)"""


def _cf(expr, name):
    return with_sql(D + [_FIT, _PRED], f"SELECT grp, {Q.r6(expr)} AS {name} FROM cf")


ACC = "(tp + tn) / nullif(tp + fp + tn + fn, 0)"
REC = "tp / nullif(tp + fn, 0)"
PREC = "tp / nullif(tp + fp, 0)"
F1 = "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0)"

SQL = {
    "wi1_roc_curve": with_sql(D + [SC, CNT], f"""SELECT grp, {Q.r6('score')} AS threshold,
 {Q.r6('fp / nullif(N, 0)')} AS fpr, {Q.r6('tp / nullif(P, 0)')} AS tpr FROM cum
UNION ALL SELECT DISTINCT grp, NULL, 0.0, 0.0 FROM sc"""),
    "wi2_auc": with_sql(D + [SC, CNT], f"""SELECT grp, {Q.r6('sum(neg * (2 * tp - pos)) / (2.0 * any_value(P) * any_value(N))')}
 AS auc FROM cum GROUP BY grp"""),
    "wi3_argmax_class": """SELECT vec_id, CAST(cls AS INTEGER) AS cls FROM (
  SELECT vec_id, cls, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, cls) AS rn FROM (
    SELECT vec_id, i - 1 AS cls, round(CAST(embedding[i] AS DOUBLE), 1) AS p FROM embeddings, range(1, 65) t(i)))
WHERE rn = 1""",
    "ag14_confusion": with_sql(D + [_FIT, _PRED], "SELECT * FROM cf"),
    "me1_accuracy": _cf(ACC, "accuracy"),
    "me2_tpr": with_sql(D + [_FIT, _PRED], f"SELECT grp, {Q.r6('avg(yhat)')} AS tpr FROM pr WHERE y_true = 1 GROUP BY grp"),
    "me3_recall": _cf(REC, "recall"),
    "me4_precision": _cf(PREC, "precision"),
    "me5_f1": _cf(F1, "f1"),
    "me6_roc_auc": with_sql(D + [_FIT, _PRED, """c2 AS (SELECT grp, round(p1, 12) AS score, sum(CASE WHEN y_true = 1 THEN 1 ELSE 0 END) AS pos,
  sum(CASE WHEN y_true = 1 THEN 0 ELSE 1 END) AS neg FROM pr GROUP BY grp, round(p1, 12)),
k2 AS (SELECT *, sum(pos) OVER w AS tp, sum(pos) OVER (PARTITION BY grp) AS P, sum(neg) OVER (PARTITION BY grp) AS N
  FROM c2 WINDOW w AS (PARTITION BY grp ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""],
        f"SELECT grp, {Q.r6('sum(neg * (2 * tp - pos)) / nullif(2.0 * any_value(P) * any_value(N), 0)')} AS auc FROM k2 GROUP BY grp"),
    "me7_auc_of_hard_labels": _cf(f"({REC} + tn / nullif(tn + fp, 0)) / 2.0", "auc_hard"),
    "me8_evaluate_model": with_sql(D + [_FIT, _PRED], f"SELECT grp, {Q.r6(F1)} AS f1, {Q.r6(ACC)} AS accuracy, "
                                                      f"{Q.r6(REC)} AS recall FROM cf"),
}
