"""Registered queries: the remaining ensemble / join / aggregate operators (PU2, PU3, PU8, PU11,
AG5, AG7, AG9, AG10, FI6, JO3, JO4, JO6, JO9, SE4, PU12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pubag.catalog import sqlfrag as Q
from pubag.catalog.common import n_pos, M_OOB, SEED, T_OOB, r6, with_sql
from pubag.operators import relational as R
from pubag.operators import sampling as S
from pubag.operators.bagging import PUBagging
from pubag.plans import jobs as J
from pubag.sources.fixtures import DOCS, pu_docs, table

FEATS = DOCS.features
K = ["doc_id"]


def _fit(spark, sf, T=10, m=100, df=None, **kw):
    df = pu_docs(spark, sf) if df is None else df
    return df, PUBagging(n_estimators=T, max_samples=m, seed=SEED, **kw).fit(df, FEATS, K)


def _model_cols(model):
    """The whole model table: class weights, means and variances of every feature."""
    return model.models.select("bag", r6("n0").alias("n0"), r6("n1").alias("n1"), *[
        r6(F.col(c)[j]).alias(f"{c}_{j}") for c in ("mu0", "v0", "mu1", "v1") for j in range(len(FEATS))])


def pu2_fit(spark, sf):
    """PU2: all bags of the flagship configuration (T=100, m=100) fitted in one job."""
    _, m = _fit(spark, sf, T=T_OOB, m=M_OOB)
    return _model_cols(m)


def pu3_weight_path(spark, sf):
    """PU3: user sample weights (1 + line count) multiplied into the bag multiplicities."""
    d = pu_docs(spark, sf).withColumn("uw", (F.col("f5") + 1).cast("double"))
    m = PUBagging(n_estimators=10, max_samples=100, seed=SEED).fit(d, FEATS, K, weight="uw")
    return _model_cols(m)


def pu8_predict_log_proba(spark, sf):
    """PU8 / AG10 / SC6: log of the ensemble mean probability by log-sum-exp over bags."""
    d, m = _fit(spark, sf)
    lp = m.predict_log_proba(d.select("doc_id", *FEATS))
    return lp.select("doc_id", r6("log_p0").alias("log_p0"), r6("log_p1").alias("log_p1"))


def pu11_fitted_attributes(spark, sf):
    """PU11: per bag the feature count, distinct in-bag unlabelled rows and draws."""
    _, m = _fit(spark, sf)
    nf = F.element_at(F.array(*[F.lit(len(set(f))) for f in m.estimators_features_]), F.col("bag") + 1)
    return m.members().groupBy("bag").agg(F.countDistinct("doc_id").cast("bigint").alias("n_inbag"),
                                          F.sum("w").cast("bigint").alias("n_draws")).withColumn("n_features", nf)


def pu11_oob_decision_function(spark, sf):
    """PU11: oob_decision_function_ of every training row (null: no bag left it out)."""
    _, m = _fit(spark, sf)
    return m.oob_decision_function_.select("doc_id", r6("p0").alias("p0"), r6("p1").alias("p1"))


def pu11_estimators_samples(spark, sf):
    """PU11: estimators_samples_, the in-bag rows of every bag."""
    _, m = _fit(spark, sf)
    return m.estimators_samples_.select("bag", "doc_id", "w")


def sc8_validation(spark, sf):
    """SC8: parameter and input checks, each tried on the documents: (case, rejected)."""
    d = pu_docs(spark, sf)
    good = PUBagging(n_estimators=2, max_samples=10, seed=SEED, warm_start=True, oob_score=False)
    model = good.fit(d, FEATS, K)
    tries = {
        "no bags": lambda: PUBagging(n_estimators=0),
        "out-of-bag scores without replacement": lambda: PUBagging(bootstrap=False, oob_score=True),
        "out-of-bag scores with a warm start": lambda: PUBagging(warm_start=True, oob_score=True),
        "more draws than unlabelled rows": lambda: PUBagging(max_samples=10 ** 12).fit(d, FEATS, K),
        "no draws": lambda: PUBagging(max_samples=0.0).fit(d, FEATS, K),
        "more features than there are": lambda: PUBagging(max_features=len(FEATS) + 1, max_samples=10).fit(d, FEATS, K),
        "labels other than 0 and 1": lambda: PUBagging(max_samples=10).fit(d.withColumn("y", F.col("y") + 1), FEATS, K),
        "rows without a feature": lambda: model.predict_proba(d.drop(FEATS[0])),
        "fewer bags in a warm start": lambda: PUBagging(n_estimators=1, max_samples=10, seed=SEED, warm_start=True, oob_score=False).extend(model, d),
        "a larger sample than the table": lambda: S.sample_n(d, d.count() + 1, K, SEED),
        "a fit as it should be": lambda: model.predict_proba(d).count(),
    }
    out = []
    for case, act in tries.items():
        try:
            act()
            out.append((case, False))
        except ValueError:
            out.append((case, True))
    return spark.createDataFrame(out, "case string, rejected boolean")


def ag5_draw_counts(spark, sf):
    """AG5: dense multiplicity of every unlabelled row in every bag (0 when not drawn)."""
    u = pu_docs(spark, sf).filter(F.col("y") < 1)
    draws = _position_lookup(spark, sf)
    return R.draw_counts(draws, u, K, 10).select("bag", "doc_id", "w")


def _position_lookup(spark, sf):
    u = pu_docs(spark, sf).filter(F.col("y") < 1)
    n_u = u.count()
    pos = S.dense_position(u, K, SEED, "pos")
    dr = S.bootstrap_draws(spark, 10, 100, n_u, SEED, aggregate=False)
    return dr.join(pos.select("pos", "doc_id"), "pos").select("bag", "draw", "doc_id")


def jo4_position_lookup(spark, sf):
    """JO4: each drawn ordinal mapped to its unlabelled row."""
    return _position_lookup(spark, sf).select("bag", F.col("draw").cast("bigint").alias("draw"), "doc_id")


def ag9_ensemble_vote(spark, sf):
    """AG9: share of the bags voting class 1."""
    d, m = _fit(spark, sf)
    return m.vote_share(d.select("doc_id", *FEATS)).select("doc_id", r6("vote1").alias("vote1"))


def fi6_is_oob(spark, sf):
    """FI6: (bag, row) pairs where the unlabelled row is out of bag."""
    d, m = _fit(spark, sf)
    u = d.filter(F.col("y") < 1).select("doc_id").withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(9))))
    return u.join(m.members().select("bag", "doc_id"), ["bag", "doc_id"], "left_anti")


def jo6_rows_x_bags(spark, sf):
    """JO6: every row against every estimator."""
    d, m = _fit(spark, sf)
    return m.predict_per_bag(d.select("doc_id", *FEATS)).select("doc_id", "bag", r6("p1").alias("p1"))


def jo9_attach_truth(spark, sf):
    """JO9 (+SA17): hide half of the positives, fit, predict, compare with the labels kept before hiding."""
    d = pu_docs(spark, sf).drop("y_true")
    hid = S.hide_labels(d, n_pos(d) // 2, K, SEED)
    _, m = _fit(spark, sf, df=hid)
    pred = m.predict(hid.select("doc_id", "y", *FEATS))
    return R.attach_truth(pred, d, K, "y", "y_orig").select("doc_id", "y", "y_orig", "yhat")


def se4_missing_classes(spark, sf):
    """SE4: class codes absent from a 5-row hash sample of the embeddings."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").alias("cls"))
    seen = S.sample_n(e, 5, ["vec_id"], SEED, "seen").select("cls").distinct()
    return R.missing_classes(e.select("cls").distinct(), seen)


def _ex7(spark, sf):
    d = pu_docs(spark, sf)
    pos, back = d.filter(F.col("y") == 1), d.filter(F.col("y") == 0)
    size = pos.count()
    return pos, back, size


def pu12_chunk_cross_score(spark, sf):
    pos, back, size = _ex7(spark, sf)
    return J.chunk_cross_score(pos, back, FEATS, K, SEED, size).select("doc_id", r6("score").alias("score"), "n_votes")


def jo3_except_chunk(spark, sf):
    """JO3: (row, chunk model) pairs where the model did not train on the row's chunk."""
    pos, back, size = _ex7(spark, sf)
    b = S.chunks(back, K, SEED, size)
    n = b.agg(F.max("chunk")).first()[0] + 1
    x = b.select("doc_id", "chunk", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("model_chunk"))
    return x.filter(F.col("model_chunk") != F.col("chunk")).select("doc_id", "model_chunk")


QUERIES = {
    "pu2_fit": pu2_fit, "pu3_weight_path": pu3_weight_path, "pu8_predict_log_proba": pu8_predict_log_proba,
    "ag10_ensemble_log_proba": pu8_predict_log_proba, "pu11_fitted_attributes": pu11_fitted_attributes,
    "pu11_oob_decision_function": pu11_oob_decision_function, "pu11_estimators_samples": pu11_estimators_samples, "sc8_validation": sc8_validation,
    "ag5_draw_counts": ag5_draw_counts, "jo4_position_lookup": jo4_position_lookup,
    "ag9_ensemble_vote": ag9_ensemble_vote, "fi6_is_oob": fi6_is_oob, "jo6_rows_x_bags": jo6_rows_x_bags,
    "jo9_attach_truth": jo9_attach_truth, "se4_missing_classes": se4_missing_classes,
    "pu12_chunk_cross_score": pu12_chunk_cross_score,
    "ex7_cross_score_background": pu12_chunk_cross_score, "jo3_except_chunk": jo3_except_chunk,
}

# ---------------------------------------------------------------------------------- SQL

D = [Q.PU_DOCS]


def _fit_sql(T=10, m=100, src="pu_docs", weight=None):
    return Q.gnb_fit_ctes(src, K, FEATS, SEED, T, m, weight=weight)


_MODEL_COLS = ", ".join(["bag"] + [f"{Q.r6(c)} AS {c}" for c in ["n0", "n1"] + [
    f"{c}_{j}" for c in ("mu0", "v0", "mu1", "v1") for j in range(len(FEATS))]])


def _model_sql(T, m, weight=None, src_ctes=()):
    return with_sql(D + list(src_ctes) + [_fit_sql(T, m, weight=weight)],
                    f"SELECT {_MODEL_COLS} FROM g_model")


_L0, _L1 = Q.gnb_lj(FEATS, 0), Q.gnb_lj(FEATS, 1)
_LP = f"""lp AS (SELECT doc_id, l0 - (mx + ln(exp(l0 - mx) + exp(l1 - mx))) AS lp0,
  l1 - (mx + ln(exp(l0 - mx) + exp(l1 - mx))) AS lp1 FROM (
  SELECT r.doc_id, {_L0} AS l0, {_L1} AS l1, greatest({_L0}, {_L1}) AS mx FROM pu_docs r, g_model m))"""
_LPS = f"""SELECT doc_id, {Q.r6('max(lp0) + ln(sum(exp(lp0 - mx0))) - ln(10.0)')} AS log_p0,
 {Q.r6('max(lp1) + ln(sum(exp(lp1 - mx1))) - ln(10.0)')} AS log_p1
FROM (SELECT *, max(lp0) OVER (PARTITION BY doc_id) AS mx0, max(lp1) OVER (PARTITION BY doc_id) AS mx1 FROM lp)
GROUP BY doc_id"""
_RAW = f"""raw AS (SELECT d.bag, d.draw, u.doc_id FROM (
  SELECT bag, draw, {Q.H(Q.ht(Q.q(SEED), Q.q('boot'), Q.vc('bag'), Q.vc('draw')))} % (SELECT count(*) FROM g_u) AS pos
  FROM g_draws) d JOIN g_upos u ON d.pos = u.pos)"""
_P1 = Q.gnb_p1(FEATS)
_HID = f"""hid AS (SELECT d.doc_id, CAST(CASE WHEN h.doc_id IS NOT NULL THEN 0 ELSE d.y END AS INTEGER) AS y,
  {', '.join('d.' + f for f in FEATS)} FROM pu_docs d LEFT JOIN (SELECT doc_id FROM (SELECT doc_id,
  row_number() OVER (ORDER BY {Q.hk(SEED, 'hide', Q.vc('doc_id'))}, doc_id) AS rn FROM pu_docs WHERE y = 1) WHERE rn <=
  (SELECT count(*) // 2 FROM pu_docs WHERE y = 1)) h
  ON d.doc_id = h.doc_id)"""
_EX7 = f"""c_p AS (SELECT doc_id, 1 AS y, {', '.join(FEATS)} FROM pu_docs WHERE y = 1),
c_sz AS (SELECT count(*) AS sz FROM c_p),
c_b AS (SELECT doc_id, 0 AS y, {', '.join(FEATS)},
  CAST((row_number() OVER (ORDER BY {Q.hk(SEED, 'chunk', Q.vc('doc_id'))}, doc_id) - 1) // (SELECT sz FROM c_sz) AS INTEGER) AS chunk
  FROM pu_docs WHERE y = 0),
c_n AS (SELECT max(chunk) + 1 AS n FROM c_b),
c_rows AS (SELECT doc_id, y, {', '.join(FEATS)} FROM c_p UNION ALL SELECT doc_id, y, {', '.join(FEATS)} FROM c_b),
c_bagged AS (SELECT CAST(i AS INTEGER) AS bag, y, 1 AS w, {', '.join(FEATS)} FROM c_p, range(0, (SELECT n FROM c_n)) t(i)
  UNION ALL SELECT chunk AS bag, y, 1 AS w, {', '.join(FEATS)} FROM c_b),
{Q.gnb_model_ctes('c', FEATS, 'c_rows', 'c_bagged', floor_by_bag=True)},
c_votes AS (SELECT r.doc_id, avg({_P1}) AS s, count(*) AS n FROM c_b r JOIN c_model m ON m.bag <> r.chunk GROUP BY r.doc_id)"""
_EX7_SEL = f"""SELECT b.doc_id, {Q.r6('coalesce(v.s, 0.0)')} AS score, CAST(coalesce(v.n, 0) AS INTEGER) AS n_votes
FROM c_b b LEFT JOIN c_votes v ON b.doc_id = v.doc_id"""

SQL = {
    "pu2_fit": _model_sql(T_OOB, M_OOB),
    "pu3_weight_path": with_sql(D + ["wd AS (SELECT *, CAST(f5 + 1 AS DOUBLE) AS uw FROM pu_docs)",
                                     Q.gnb_fit_ctes("wd", K, FEATS, SEED, 10, 100, weight="uw")],
                                f"SELECT {_MODEL_COLS} FROM g_model"),
    "pu8_predict_log_proba": with_sql(D + [_fit_sql(), _LP], _LPS),
    "pu11_fitted_attributes": with_sql(D + [_fit_sql()], f"""SELECT bag, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_inbag,
 CAST(sum(w) AS BIGINT) AS n_draws, {len(FEATS)} AS n_features FROM g_bags GROUP BY bag"""),
    "pu11_oob_decision_function": with_sql(D + [Q.gnb_oob("pu_docs", K, FEATS, SEED, 10, 100)],
                                           f"SELECT doc_id, {Q.r6('1.0 - oob_score')} AS p0, {Q.r6('oob_score')} AS p1 FROM g_oob"),
    "pu11_estimators_samples": with_sql(D + [_fit_sql()], """SELECT bag, doc_id, CAST(w AS INTEGER) AS w FROM g_bags
 UNION ALL SELECT CAST(i AS INTEGER), doc_id, 1 FROM g_p, range(0, 10) t(i)"""),
    "sc8_validation": """SELECT * FROM (VALUES ('no bags', true), ('out-of-bag scores without replacement', true),
 ('out-of-bag scores with a warm start', true), ('more draws than unlabelled rows', (SELECT count(*) FROM documents) < 1000000000000), ('no draws', true),
 ('more features than there are', true), ('labels other than 0 and 1', true), ('rows without a feature', true), ('fewer bags in a warm start', true),
 ('a larger sample than the table', true), ('a fit as it should be', false)) t("case", rejected)""",
    "ag5_draw_counts": with_sql(D + [_fit_sql(), _RAW], """SELECT b.bag, u.doc_id,
 CAST(coalesce(c.w, 0) AS INTEGER) AS w FROM g_u u CROSS JOIN (SELECT CAST(i AS INTEGER) AS bag FROM range(0, 10) t(i)) b
 LEFT JOIN (SELECT bag, doc_id, count(*) AS w FROM raw GROUP BY bag, doc_id) c ON c.bag = b.bag AND c.doc_id = u.doc_id"""),
    "jo4_position_lookup": with_sql(D + [_fit_sql(), _RAW], "SELECT bag, CAST(draw AS BIGINT) AS draw, doc_id FROM raw"),
    "ag9_ensemble_vote": with_sql(D + [_fit_sql()], f"""SELECT r.doc_id,
 {Q.r6(f'avg(CASE WHEN {_P1} > 0.5 THEN 1.0 ELSE 0.0 END)')} AS vote1 FROM pu_docs r, g_model m GROUP BY r.doc_id"""),
    "fi6_is_oob": with_sql(D + [_fit_sql()], """SELECT u.doc_id, b.bag FROM g_u u,
 (SELECT CAST(i AS INTEGER) AS bag FROM range(0, 10) t(i)) b
 WHERE NOT EXISTS (SELECT 1 FROM g_bags g WHERE g.doc_id = u.doc_id AND g.bag = b.bag)"""),
    "jo6_rows_x_bags": with_sql(D + [_fit_sql()], f"SELECT r.doc_id, m.bag, {Q.r6(_P1)} AS p1 FROM pu_docs r, g_model m"),
    "jo9_attach_truth": with_sql(D + [_HID, _fit_sql(src="hid")], f"""SELECT h.doc_id, h.y, o.y AS y_orig,
 CAST(CASE WHEN avg({Q.gnb_p1(FEATS, row='h')}) > 0.5 THEN 1 ELSE 0 END AS INTEGER) AS yhat
 FROM hid h JOIN pu_docs o ON h.doc_id = o.doc_id, g_model m GROUP BY h.doc_id, h.y, o.y"""),
    "se4_missing_classes": f"""SELECT DISTINCT label AS cls FROM embeddings EXCEPT
SELECT DISTINCT label FROM (SELECT label FROM embeddings ORDER BY {Q.hk(SEED, 'seen', Q.vc('vec_id'))}, vec_id LIMIT 5)""",
    "pu12_chunk_cross_score": with_sql(D + [_EX7], _EX7_SEL),
    "jo3_except_chunk": with_sql(D + [_EX7], """SELECT b.doc_id, CAST(i AS INTEGER) AS model_chunk
FROM c_b b, range(0, (SELECT n FROM c_n)) t(i) WHERE i <> b.chunk"""),
}
SQL["ag10_ensemble_log_proba"] = SQL["pu8_predict_log_proba"]
SQL["ex7_cross_score_background"] = SQL["pu12_chunk_cross_score"]
