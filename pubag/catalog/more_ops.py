"""Registered queries: operators shown by a shared job (AG8, AG11, AG12, AG13, SO5) and the
remaining sources / ensemble operators (IO2, IO6, FC2, PU10)."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from pubag.catalog import ensemble, ensemble_more, experiments, explain
from pubag.catalog import sqlfrag as Q
from pubag.catalog.common import SEED, r6, with_sql
from pubag.operators import explain as X
from pubag.operators import relational as R
from pubag.operators import sampling as S
from pubag.operators.bagging import PUBagging, fit_plain
from pubag.sources import io
from pubag.sources.fixtures import DOCS, pu_docs

FEATS = DOCS.features
K = ["doc_id"]


def io2_read_manifest(spark, sf):
    """IO2 (+SE1): the feature table split into one file per group and class, listed in two
    headerless manifests paired by line; read back in one scan with group and role."""
    d = pu_docs(spark, sf).select("doc_id", "y", *FEATS, "grp")
    base = io.scratch_path(spark, "io2")
    langs = sorted(r[0] for r in d.select("grp").distinct().collect())  # one pair of files each
    pos_lines, neg_lines = [], []
    for g in langs:
        for y, lines in ((1, pos_lines), (0, neg_lines)):
            name = f"tables/{g} {'pos' if y else 'neg'}+.csv"  # nested, and not the same when URL-encoded
            part = d.filter((F.col("grp") == g) & (F.col("y") == y)).drop("grp")
            part.write.option("header", True).csv(os.path.join(base, name))
            lines.append(name)
    spark.createDataFrame([(x,) for x in pos_lines], "v string").coalesce(1).write.text(os.path.join(base, "pos_list"))
    spark.createDataFrame([(x,) for x in neg_lines], "v string").coalesce(1).write.text(os.path.join(base, "neg_list"))
    man = io.read_manifest(spark, os.path.join(base, "pos_list"), os.path.join(base, "neg_list"))
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("y", T.IntegerType())]
                          + [T.StructField(f, T.DoubleType()) for f in FEATS])
    out = io.read_groups(spark, man, schema, base_dir=base, group_names=langs, fmt="csv")
    return out.select("doc_id", "grp", "role", "y", *[r6(f).alias(f) for f in FEATS])


def io6_save_load_model(spark, sf):
    """IO6: an ensemble with one model set per repeat, written, read back, and asked to predict."""
    d = S.repeats(pu_docs(spark, sf), 2)
    m = PUBagging(n_estimators=5, max_samples=100, seed=SEED, oob_score=False).fit(d, FEATS, K, axis=["repeat"])
    back = io.load_ensemble(spark, io.save_ensemble(m, io.scratch_path(spark, "io6")))
    p = back.predict_proba(d.select("repeat", "doc_id", *FEATS))
    return p.select(F.col("repeat").cast("int").alias("repeat"), "doc_id", r6("p1").alias("p1"))


def ag7_mean_prediction(spark, sf):
    """AG7: mean of the predictions that a row got from bags that did not draw it, 0 without one."""
    d = pu_docs(spark, sf)
    m = PUBagging(n_estimators=10, max_samples=100, seed=SEED).fit(d, FEATS, K)
    u = d.filter(F.col("y") == 0)
    preds = m.predict_per_bag(u.select("doc_id", *FEATS), "p").join(m.members().select("doc_id", "bag"), ["doc_id", "bag"], "left_anti")
    return R.mean_prediction(preds, u, K).select("doc_id", r6("score").alias("score"), "n_votes")


def ag12_repeat_mean(spark, sf):
    """AG12: mean TPR over the ten repeats of EX4, per model."""
    return R.repeat_mean(experiments.ex4_repeat_eval(spark, sf), ["model"], "tpr").select("model", r6("tpr").alias("tpr"))


def ag13_grand_mean(spark, sf):
    """AG13: grand mean of the AUC over the held-out groups of EX2 and the groups and repeats of EX3, per kind of model."""
    plain = experiments.ex2_group_holdout_plain(spark, sf).select("auc").withColumn("model", F.lit("mod"))
    pu = experiments.ex3_group_holdout_pu(spark, sf).select("auc").withColumn("model", F.lit("pu"))
    return R.repeat_mean(plain.unionByName(pu), ["model"], "auc").select("model", r6("auc").alias("auc"))


def sa9_feature_bag(spark, sf):
    """SA9: every bag sees three of the six features; prediction by those, variance floor included."""
    d = pu_docs(spark, sf)
    m = PUBagging(n_estimators=10, max_samples=100, max_features=0.5, seed=SEED, oob_score=False).fit(d, FEATS, K)
    return m.predict_proba(d.select("doc_id", *FEATS)).select("doc_id", r6("p1").alias("p1"))


def sa10_bag_seeds(spark, sf):
    """SA10: bags 5 to 9 drawn alone are those of a fit with ten bags."""
    m = PUBagging(n_estimators=5, max_samples=100, seed=SEED).fit(pu_docs(spark, sf), FEATS, K, first_bag=5)
    return m.members().select("doc_id", "bag", "w")


def pu1_parameters(spark, sf):
    """PU1: draws per bag from a share of the unlabelled rows of each group."""
    m = PUBagging(n_estimators=3, max_samples=0.25, seed=SEED).fit(pu_docs(spark, sf), FEATS, K, axis=["grp"])
    return m.members().groupBy("grp", "bag").agg(F.sum("w").cast("bigint").alias("draws"))


def sa6_warm_start_axis(spark, sf):
    """SA6 with an axis and a warm start: bags 2 and 3 of each group, 20 distinct rows each."""
    u = pu_docs(spark, sf).filter(F.col("y") < 1)
    return S.subsample_members(u, K, 2, 20, SEED, axis=["grp"], first_bag=2).select("grp", "bag", "doc_id")


def fc1_axis_contributions(spark, sf):
    """FC1 with an axis: one plain model per group, contributions against the group's own background."""
    d = pu_docs(spark, sf)
    phi = X.contributions(fit_plain(d, FEATS, K, axis=["grp"]), d.select("grp", "doc_id", *FEATS))
    return phi.select("grp", "doc_id", "feature", r6("phi").alias("phi"))


def fc2_interactions(spark, sf):
    """FC2: pairwise contribution values of the additive log-odds (phi on the diagonal)."""
    d = pu_docs(spark, sf)
    phi = X.contributions(fit_plain(d, FEATS, K), d.select("doc_id", *FEATS))
    return X.interactions(phi, K, FEATS).select("doc_id", "feature_i", "feature_j", r6("value").alias("value"))


def pu10_warm_start(spark, sf):
    """PU10 / SA10: 5 bags, then a warm start to 10: the model equals a 10-bag fit."""
    d = pu_docs(spark, sf)
    a = PUBagging(n_estimators=5, max_samples=100, seed=SEED, oob_score=False).fit(d, FEATS, K)
    b = PUBagging(n_estimators=10, max_samples=100, seed=SEED, oob_score=False, warm_start=True).extend(a, d)
    return ensemble_more._model_cols(b)


QUERIES = {
    "ag8_ensemble_mean_proba": ensemble.pu6_predict_proba,
    "ag11_ensemble_decision": ensemble.pu9_decision_function,
    "ag7_mean_prediction": ag7_mean_prediction,
    "ag12_repeat_mean": ag12_repeat_mean,
    "ag13_grand_mean": ag13_grand_mean,
    "sa9_feature_bag": sa9_feature_bag,
    "sa10_bag_seeds": sa10_bag_seeds,
    "pu1_parameters": pu1_parameters,
    "sa6_warm_start_axis": sa6_warm_start_axis,
    "fc1_axis_contributions": fc1_axis_contributions,
    "so5_feature_ranking": explain.fc4_contribution_summary,
    "io2_read_manifest": io2_read_manifest,
    "io6_save_load_model": io6_save_load_model,
    "fc2_interactions": fc2_interactions,
    "pu10_warm_start": pu10_warm_start,
}

_R6F = ", ".join(f"{Q.r6(f)} AS {f}" for f in FEATS)
_FIT2 = f"""x2 AS (SELECT d.*, CAST(r.i AS INTEGER) AS repeat FROM pu_docs d, range(0, 2) r(i)),
{Q.pu_axis_ctes("m2", "x2", ["repeat"], K, FEATS, SEED, 5, "100")}"""



def _feature_bag_sql(T: int, k: int) -> str:
    """Prediction of T bags that use k features each, chosen by the smallest hashes."""
    d = range(len(FEATS))
    pick = f"""fb AS (SELECT bag, j FROM (SELECT b.i AS bag, j.i AS j, row_number() OVER (PARTITION BY b.i ORDER BY
    {Q.H(Q.ht(Q.q(SEED), Q.q('feat'), Q.vc('b.i'), Q.vc('j.i')))}, j.i) AS rn
  FROM range(0, {T}) b(i), range(0, {len(FEATS)}) j(i)) WHERE rn <= {k}),
mk AS (SELECT bag, {', '.join(f'max(CASE WHEN j = {j} THEN 1 ELSE 0 END) AS k_{j}' for j in d)} FROM fb GROUP BY bag),
mx AS (SELECT mk.*, maxvar, greatest({', '.join(f'k_{j} * coalesce(var_{j}, 0.0)' for j in d)}) AS used FROM mk, g_glob2),
mf AS (SELECT m.bag, n0, n1, {', '.join(f'mu{c}_{j}, v{c}_{j} - 1e-9 * maxvar + 1e-9 * used AS v{c}_{j}' for c in (0, 1) for j in d)},
  {', '.join(f'k_{j}' for j in d)} FROM g_model m JOIN mx ON mx.bag = m.bag)"""

    def joint(c):
        return f"(ln(n{c}) - 0.5 * (" + " + ".join(
            f"k_{j} * coalesce(ln(v{c}_{j}) + ({f} - mu{c}_{j}) * ({f} - mu{c}_{j}) / v{c}_{j}, 0.0)" for j, f in enumerate(FEATS)) + "))"

    p1 = f"avg(1.0 / (1.0 + exp(least(greatest({joint(0)} - {joint(1)}, -700.0), 700.0))))"
    return with_sql([Q.PU_DOCS, Q.gnb_fit_ctes("pu_docs", K, FEATS, SEED, T, 100), pick],
                    f"SELECT r.doc_id, {Q.r6(p1)} AS p1 FROM pu_docs r, mf GROUP BY r.doc_id")


def _axis_phi_sql() -> str:
    """Log-odds terms of one plain model per group less their mean in the group."""
    def term(j, f):
        one, zero = (f"ln(m.v{c}_{j}) + (r.{f} - m.mu{c}_{j}) * (r.{f} - m.mu{c}_{j}) / m.v{c}_{j}" for c in (1, 0))
        return f"coalesce(-0.5 * (({one}) - ({zero})), 0.0)"

    rows = " UNION ALL ".join(f"SELECT r.grp, r.doc_id, '{f}' AS feature, {term(j, f)} AS g FROM pu_docs r JOIN gp_model m ON m.grp = r.grp"
                              for j, f in enumerate(FEATS))
    return with_sql([Q.PU_DOCS, Q.gnb_plain_ctes("pu_docs", K, FEATS, axis=["grp"]), f"t AS ({rows})"],
                    f"SELECT grp, doc_id, feature, {Q.r6('g - avg(g) OVER (PARTITION BY grp, feature)')} AS phi FROM t")


SQL = {
    "ag8_ensemble_mean_proba": ensemble.SQL["pu6_predict_proba"],
    "ag11_ensemble_decision": ensemble.SQL["pu9_decision_function"],
    "ag7_mean_prediction": with_sql([Q.PU_DOCS, Q.gnb_oob("pu_docs", K, FEATS, SEED, 10, 100)],
                                    f"SELECT doc_id, {Q.r6('coalesce(oob_score, 0.0)')} AS score, n_votes FROM g_oob WHERE y = 0"),
    "ag12_repeat_mean": f"SELECT model, {Q.r6('avg(tpr)')} AS tpr FROM ({experiments.SQL['ex4_repeat_eval']}) GROUP BY model",
    "ag13_grand_mean": f"""SELECT model, {Q.r6('avg(auc)')} AS auc FROM (
  SELECT 'mod' AS model, auc FROM ({experiments.SQL['ex2_group_holdout_plain']})
  UNION ALL SELECT 'pu', auc FROM ({experiments.SQL['ex3_group_holdout_pu']})) GROUP BY model""",
    "sa9_feature_bag": _feature_bag_sql(10, 3),
    "sa10_bag_seeds": with_sql([Q.PU_DOCS, Q.gnb_fit_ctes("pu_docs", K, FEATS, SEED, 10, 100)],
                               "SELECT doc_id, bag, CAST(w AS INTEGER) AS w FROM g_bags WHERE bag >= 5"),
    "pu1_parameters": with_sql([Q.PU_DOCS], """SELECT grp, CAST(b.i AS INTEGER) AS bag, CAST(floor(0.25 * n) AS BIGINT) AS draws
FROM (SELECT grp, count(*) AS n FROM pu_docs WHERE y = 0 GROUP BY grp), range(0, 3) b(i)"""),
    "sa6_warm_start_axis": with_sql([Q.PU_DOCS], f"""SELECT grp, bag, doc_id FROM (
  SELECT u.grp, b.bag, u.doc_id, row_number() OVER (PARTITION BY u.grp, b.bag ORDER BY
    {Q.H(Q.ht(Q.q(SEED), Q.q('sub'), 'u.grp', Q.vc('b.bag'), Q.vc('u.doc_id')))}, u.doc_id) AS rn
  FROM (SELECT * FROM pu_docs WHERE y < 1) u, (SELECT CAST(i AS INTEGER) AS bag FROM range(2, 4) t(i)) b) WHERE rn <= 20"""),
    "fc1_axis_contributions": _axis_phi_sql(),
    "so5_feature_ranking": explain.SQL["fc4_contribution_summary"],
    "io2_read_manifest": with_sql([Q.PU_DOCS], f"""SELECT doc_id, grp, CASE WHEN y = 1 THEN 'pos' ELSE 'neg' END AS role,
 y, {_R6F} FROM pu_docs"""),
    "io6_save_load_model": with_sql([Q.PU_DOCS, _FIT2], f"""SELECT r.repeat, r.doc_id, {Q.r6(f'avg({Q.gnb_p1(FEATS)})')} AS p1
FROM x2 r JOIN m2_model m ON m.repeat = r.repeat GROUP BY r.repeat, r.doc_id"""),
    "fc2_interactions": with_sql([Q.PU_DOCS, explain._FIT, explain._G, explain._E, explain._PHI],
                                 "SELECT p.doc_id, p.feature AS feature_i, f.feature_j, " + Q.r6(
                                     "CASE WHEN p.feature = f.feature_j THEN p.phi ELSE 0.0 END") + " AS value FROM phi p, "
                                 "(SELECT unnest([" + ", ".join(f"'{f}'" for f in FEATS) + "]) AS feature_j) f"),
    "pu10_warm_start": ensemble_more._model_sql(10, 100),
}
