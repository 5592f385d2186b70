"""Registered queries: the experiment jobs (EX1-EX13) and the operators they introduce (PU12, AG7, AG12, AG13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pubag.catalog.common import SEED, n_pos, r6
from pubag.operators import sampling as S
from pubag.plans import jobs as J
from pubag.sources.fixtures import DOCS, pu_docs

FEATS = DOCS.features
K = ["doc_id"]

# Repeats, ensemble sizes and thresholds of the experiments; sizes are shares of the positives.
EX5_REPEATS = 10
EX5_T = 100
EX9_THRESHOLDS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]


def ex5_hidden_label_recovery(spark, sf):
    """EX5 (+AG12 repeat mean): plain vs PU recovery of hidden positives."""
    r = J.hidden_label_recovery(pu_docs(spark, sf), FEATS, K, SEED, repeats=EX5_REPEATS, hide_frac=0.5,
                                n_estimators=EX5_T, max_samples="n_pos")
    return r.select("model", r6("accuracy").alias("accuracy"), r6("recall").alias("recall"), r6("f1").alias("f1"))


def ex9_reliability_grid(spark, sf):
    """EX9: 9 x 9 upper-triangular TPR / F1 grid over OOB-score thresholds."""
    d = pu_docs(spark, sf)
    sp = S.stratified_split(d, K, SEED, 0.2)
    train, valid = sp.filter(~F.col("is_test")), sp.filter(F.col("is_test"))
    oob = J.oob_score_background(train, FEATS, K, SEED, n_estimators=100, max_samples=100)
    scores = oob.join(train.select(*K, *FEATS), K).withColumnRenamed("oob_score", "score")
    g = J.reliability_grid(scores, train.filter(F.col("y") == 1), valid.filter(F.col("y") == 1),
                           valid.filter(F.col("y") == 0), FEATS, K, SEED, EX9_THRESHOLDS, repeats=10,
                           n_estimators=10, max_samples=1.0)
    return g.select("i", "j", r6("tpr").alias("tpr"), r6("f1").alias("f1"), "n")


def ex10_hide_sweep_eval(spark, sf):
    """EX10: 0 to 70 % of the positives hidden in 15 levels, T = 100."""
    d = pu_docs(spark, sf)
    n = n_pos(d)
    r = J.hide_sweep_eval(d, FEATS, K, SEED, levels=[n * k // 20 for k in range(15)], n_estimators=100, max_samples=100)
    return r.select("level", "model", r6("f1").alias("f1"), r6("accuracy").alias("accuracy"), r6("recall").alias("recall"))


def ex11_external_validation(spark, sf):
    """EX11: the external test set is one group's positives and as many background rows, both held
    out from the pool (the reference's second species); 5 repeats, T = 100."""
    d = pu_docs(spark, sf)
    test = d.filter((F.col("grp") == "en") & (F.col("y") == 1))
    pool = d.join(test.select(*K), K, "left_anti")
    test = test.unionByName(S.sample_n(pool.filter(F.col("y") == 0), test.count(), K, SEED, "exttest"))
    pool = pool.join(test.select(*K), K, "left_anti")
    r = J.external_validation(pool, test, FEATS, K, SEED, repeats=5, n_estimators=100, max_samples=100)
    return r.select("repeat", "model", r6("f1").alias("f1"), r6("auc").alias("auc"))


def ex1_single_feature_eval(spark, sf):
    d = pu_docs(spark, sf)
    r = J.single_feature_eval(d, FEATS, K, SEED, n_test=n_pos(d) // 20)
    return r.select("feature", r6("auc").alias("auc"), r6("tpr").alias("tpr"))


def ex2_group_holdout_plain(spark, sf):
    r = J.group_holdout_eval(pu_docs(spark, sf), FEATS, K, SEED, pu=False)
    return r.select("fold", r6("auc").alias("auc"), r6("tpr").alias("tpr"))


def ex3_group_holdout_pu(spark, sf):
    """EX3: 10 repeats of the matched negatives, each group left out, PU."""
    r = J.group_holdout_eval(pu_docs(spark, sf), FEATS, K, SEED, pu=True, n_estimators=10, max_samples=1.0, repeats=10)
    return r.select("repeat", "fold", r6("auc").alias("auc"), r6("tpr").alias("tpr"))


def ex4_repeat_eval(spark, sf):
    d = pu_docs(spark, sf)
    r = J.repeat_eval(d, FEATS, K, SEED, repeats=10, n_test=n_pos(d) // 20, n_estimators=10)
    return r.select("repeat", "model", r6("tpr").alias("tpr"), r6("auc").alias("auc"))


def _sources(d):
    """Rows of the three sources of the new feature: known (f7), predicted (its estimate from punctuation and
    lines) and both together; src tells a row's own table."""
    predicted = F.try_divide(F.col("f4") + F.col("f5"), F.col("f1"))
    cols = [*K, "y", *FEATS]
    known, guess = d.select(*cols, "f7", F.lit("known").alias("src")), d.select(*cols, predicted.alias("f7"), F.lit("predicted").alias("src"))
    of = lambda df, name: df.withColumn("source", F.lit(name))
    return of(known, "known").unionByName(of(guess, "predicted")).unionByName(of(known.unionByName(guess), "both"))


def ex6_feature_ablation(spark, sf):
    """EX6 (+AG13 grand mean, PR5): f7 (nulls -> class mean) as the new feature over the base six, from three
    sources, 10 negative resamples x 10 hold-outs each."""
    from pubag.functions.nulls import fill_class_mean
    d = pu_docs(spark, sf)
    rows = fill_class_mean(_sources(d), ["f7"], parts=["source"])
    r = J.feature_ablation(rows, FEATS, ["f7"], [*K, "src"], SEED, n_test=n_pos(d) // 20, n_estimators=10, parts=["source"])
    return r.select("source", "variant", r6("tpr").alias("tpr"), r6("f1").alias("f1"))


def ex13_training_table_for_explain(spark, sf):
    d = pu_docs(spark, sf)
    pos = d.filter(F.col("y") == 1)
    u = d.filter(F.col("y") == 0)
    sc = u.withColumn("_s", F.try_divide(F.col("f4"), F.col("f1")))
    pseudo_pool = sc.filter(F.col("_s") > 0.025).drop("_s")
    neg_pool = sc.filter(F.col("_s") <= 0.025).drop("_s")
    t = J.training_table_for_explain(pos, pseudo_pool, neg_pool, K, SEED, n_pseudo=n_pos(d) // 7, features=FEATS + ["f7"])
    return t.select("doc_id", "y", "is_test", r6("f7").alias("f7"))


QUERIES = {
    "ex1_single_feature_eval": ex1_single_feature_eval,
    "ex2_group_holdout_plain": ex2_group_holdout_plain,
    "ex3_group_holdout_pu": ex3_group_holdout_pu,
    "ex4_repeat_eval": ex4_repeat_eval,
    "ex5_hidden_label_recovery": ex5_hidden_label_recovery,
    "ex6_feature_ablation": ex6_feature_ablation,
    "ex9_reliability_grid": ex9_reliability_grid,
    "ex10_hide_sweep_eval": ex10_hide_sweep_eval,
    "ex11_external_validation": ex11_external_validation,
    "ex13_training_table_for_explain": ex13_training_table_for_explain,
}

SQL: dict[str, str] = {}


def _oob_of(kind, T, **params):
    def q(spark, sf):
        from pubag.operators.bagging import PUBagging
        from pubag.operators.learners import registry
        m = PUBagging(learner=registry(kind, **params), n_estimators=T, max_samples=100, seed=SEED).fit(
            pu_docs(spark, sf), FEATS, K)
        return m.oob_scores(include_positives=False).select("doc_id", r6("oob_score").alias("oob_score"), "n_votes")
    return q


QUERIES.update({
    "bl3_random_forest": _oob_of("random_forest", 100),
    "bl4_boosted_trees": _oob_of("boosted_trees", 100, drop=0.1),
    "bl5_kernel_svm": _oob_of("kernel_svm", 100),
    "bl6_mlp": _oob_of("mlp", 100),
})

# The other learners of EX5 (forest of 10 trees, boosted trees with dart, tree, SVM, perceptron) and of
# EX10 (boosted trees, forest, perceptron); Gaussian NB is in the queries above.
LEARNERS = {
    "forest": ("random_forest", {"n_trees": 10}),
    "boosted": ("boosted_trees", {"drop": 0.1}),
    "tree": ("tree", {}),
    "svm": ("kernel_svm", {}),
    "mlp": ("mlp", {}),
}


def _learner(name):
    from pubag.operators.learners import registry
    kind, params = LEARNERS[name]
    return registry(kind, **params)


def _ex5_with(name):
    def q(spark, sf):
        r = J.hidden_label_recovery(pu_docs(spark, sf), FEATS, K, SEED, repeats=EX5_REPEATS, hide_frac=0.5, n_estimators=EX5_T,
                                    max_samples="n_pos", learner=_learner(name))
        return r.select("model", r6("accuracy").alias("accuracy"), r6("recall").alias("recall"), r6("f1").alias("f1"))
    return q


def _ex10_with(name):
    def q(spark, sf):
        d = pu_docs(spark, sf)
        n = n_pos(d)
        r = J.hide_sweep_eval(d, FEATS, K, SEED, levels=[n * k // 20 for k in range(15)], n_estimators=100, max_samples=100, learner=_learner(name))
        return r.select("level", "model", r6("f1").alias("f1"), r6("accuracy").alias("accuracy"), r6("recall").alias("recall"))
    return q


QUERIES.update({f"ex5_hidden_label_recovery_{name}": _ex5_with(name) for name in LEARNERS})
QUERIES.update({f"ex10_hide_sweep_eval_{name}": _ex10_with(name) for name in ("boosted", "forest", "mlp")})

# ---------------------------------------------------------------------------------- SQL
from pubag.catalog import sqlfrag as Q  # noqa: E402
from pubag.catalog.common import with_sql  # noqa: E402

_F = ", ".join(FEATS)
_DK = Q.vc("doc_id")
_EX5_TRAIN = f"""rep AS (SELECT CAST(i AS INTEGER) AS repeat FROM range(0, {EX5_REPEATS}) t(i)),
x5 AS (SELECT r.repeat, d.doc_id, d.y, {', '.join('d.' + f for f in FEATS)} FROM pu_docs d, rep r),
x5n AS (SELECT repeat, count(*) AS n FROM x5 WHERE y = 1 GROUP BY repeat),
x5neg AS (SELECT * FROM (SELECT x.*, row_number() OVER (PARTITION BY x.repeat ORDER BY
    {Q.H(Q.ht(Q.q(SEED), Q.q('under'), Q.vc('x.repeat'), Q.vc('x.doc_id')))}, x.doc_id) AS rn FROM x5 x WHERE y = 0) z
  JOIN x5n USING (repeat) WHERE rn <= n),
x5pos AS (SELECT x.*, row_number() OVER (PARTITION BY x.repeat ORDER BY
    {Q.H(Q.ht(Q.q(SEED), Q.q('hide'), Q.vc('x.repeat'), Q.vc('x.doc_id')))}, x.doc_id) AS rk FROM x5 x WHERE y = 1),
train5 AS (
  SELECT p.repeat, p.doc_id, 1 AS y_true, CAST(CASE WHEN p.rk <= floor(n.n * 0.5) THEN 0 ELSE 1 END AS INTEGER) AS y,
         {', '.join('p.' + f for f in FEATS)}
  FROM x5pos p JOIN x5n n USING (repeat)
  UNION ALL SELECT repeat, doc_id, 0, 0, {_F} FROM x5neg)"""
_EX5_PRED = f"""pred5 AS (
  SELECT 'mod' AS model, r.repeat, r.doc_id, any_value(r.y_true) AS y_true, avg({Q.gnb_p1(FEATS)}) AS p1
  FROM train5 r JOIN gp_model m ON m.repeat = r.repeat GROUP BY r.repeat, r.doc_id
  UNION ALL
  SELECT 'pu', r.repeat, r.doc_id, any_value(r.y_true), avg({Q.gnb_p1(FEATS)})
  FROM train5 r JOIN h5_model m ON m.repeat = r.repeat GROUP BY r.repeat, r.doc_id),
ev5 AS (SELECT model, repeat,
  sum(CASE WHEN y_true = 1 AND p1 > 1.0 - p1 THEN 1 ELSE 0 END) AS tp,
  sum(CASE WHEN y_true = 0 AND p1 > 1.0 - p1 THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN y_true = 0 AND NOT p1 > 1.0 - p1 THEN 1 ELSE 0 END) AS tn,
  sum(CASE WHEN y_true = 1 AND NOT p1 > 1.0 - p1 THEN 1 ELSE 0 END) AS fn FROM pred5 GROUP BY model, repeat)"""

SQL["ex5_hidden_label_recovery"] = with_sql(
    [Q.PU_DOCS, _EX5_TRAIN, Q.gnb_plain_ctes("train5", K, FEATS, axis=["repeat"]),
     Q.pu_axis_ctes("h5", "train5", ["repeat"], K, FEATS, SEED, EX5_T, "n_p"), _EX5_PRED],
    f"""SELECT model, {Q.r6('avg((tp + tn) / (tp + fp + tn + fn))')} AS accuracy,
 {Q.r6('avg(tp / nullif(tp + fn, 0))')} AS recall,
 {Q.r6('avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0))')} AS f1 FROM ev5 GROUP BY model""")

# EX13: training table for the contribution plots
_EX13 = f"""sc13 AS (SELECT *, f4 / nullif(f1, 0) AS s FROM pu_docs WHERE y = 0),
ps13 AS (SELECT doc_id, 1 AS y, f7 FROM sc13 WHERE s > 0.025 ORDER BY {Q.hk(SEED, 'pseudo', _DK)}, doc_id
  LIMIT (SELECT count(*) // 7 FROM pu_docs WHERE y = 1)),
p13 AS (SELECT doc_id, 1 AS y, f7 FROM pu_docs WHERE y = 1 UNION ALL SELECT * FROM ps13),
n13 AS (SELECT doc_id, 0 AS y, f7 FROM sc13 WHERE s <= 0.025 ORDER BY {Q.hk(SEED, 'neg', _DK)}, doc_id
  LIMIT (SELECT count(*) FROM p13)),
t13 AS (SELECT doc_id, y, coalesce(f7, 0.0) AS f7 FROM p13 UNION ALL SELECT doc_id, y, coalesce(f7, 0.0) FROM n13)"""
SQL["ex13_training_table_for_explain"] = with_sql([Q.PU_DOCS, _EX13, Q.stratified_n("t13", "n13s", 0.2)], f"""SELECT doc_id, y,
 row_number() OVER (PARTITION BY y ORDER BY {Q.hk(SEED, 'strat', _DK)}, doc_id) <= n_test
 AS is_test, {Q.r6('f7')} AS f7 FROM t13 JOIN n13s USING (y)""")

# EX2 / EX3: leave one group out with matched negatives
_LOGO = f"""m2 AS (SELECT * FROM (SELECT d.*, row_number() OVER (PARTITION BY grp ORDER BY {Q.hk(SEED, 'matched', _DK)}, doc_id) AS rn
  FROM pu_docs d WHERE y = 0) z JOIN (SELECT grp, count(*) AS n FROM pu_docs WHERE y = 1 GROUP BY grp) c USING (grp)
  WHERE rn <= n),
b2 AS (SELECT doc_id, grp, y, {_F} FROM pu_docs WHERE y = 1 UNION ALL SELECT doc_id, grp, y, {_F} FROM m2),
g2 AS (SELECT DISTINCT grp AS fold FROM b2),
tr2 AS (SELECT g.fold, b.doc_id, b.y, {', '.join('b.' + f for f in FEATS)} FROM b2 b JOIN g2 g ON b.grp <> g.fold),
te2 AS (SELECT g.fold, b.doc_id, b.y AS y_true, {', '.join('b.' + f for f in FEATS)} FROM b2 b JOIN g2 g ON b.grp = g.fold)"""


def _logo_sql(model_ctes: str, mprefix: str) -> str:
    pred = f"""pr2 AS (SELECT r.fold, r.doc_id, any_value(r.y_true) AS y_true, avg({Q.gnb_p1(FEATS)}) AS p1
  FROM te2 r JOIN {mprefix}_model m ON m.fold = r.fold GROUP BY r.fold, r.doc_id)"""
    return with_sql([Q.PU_DOCS, _LOGO, model_ctes, pred, Q.auc_ctes("a2", "pr2", ["fold"])],
                    f"""SELECT a.fold, {Q.r6('a.auc')} AS auc, {Q.r6('t.tpr')} AS tpr FROM a2 a JOIN
 (SELECT fold, avg(CASE WHEN p1 > 1.0 - p1 THEN 1.0 ELSE 0.0 END) AS tpr FROM pr2 WHERE y_true = 1 GROUP BY fold) t
 USING (fold)""")


SQL["ex2_group_holdout_plain"] = _logo_sql(Q.gnb_plain_ctes("tr2", K, FEATS, axis=["fold"]), "gp")

_LOGO3 = f"""rp3 AS (SELECT CAST(i AS INTEGER) AS repeat FROM range(0, 10) t(i)),
x3 AS (SELECT r.repeat, d.doc_id, d.grp, d.y, {', '.join('d.' + f for f in FEATS)} FROM pu_docs d, rp3 r),
m3 AS (SELECT * FROM (SELECT x.*, row_number() OVER (PARTITION BY x.repeat, x.grp ORDER BY
    {Q.H(Q.ht(Q.q(SEED), Q.q('matched'), Q.vc('x.repeat'), Q.vc('x.doc_id')))}, x.doc_id) AS rn FROM x3 x WHERE y = 0) z
  JOIN (SELECT repeat, grp, count(*) AS n FROM x3 WHERE y = 1 GROUP BY repeat, grp) c USING (repeat, grp) WHERE rn <= n),
b3 AS (SELECT repeat, doc_id, grp, y, {_F} FROM x3 WHERE y = 1 UNION ALL SELECT repeat, doc_id, grp, y, {_F} FROM m3),
g3 AS (SELECT DISTINCT grp AS fold FROM b3),
tr3 AS (SELECT b.repeat, g.fold, b.doc_id, b.y, {', '.join('b.' + f for f in FEATS)} FROM b3 b JOIN g3 g ON b.grp <> g.fold)"""
SQL["ex3_group_holdout_pu"] = with_sql(
    [Q.PU_DOCS, _LOGO3, Q.pu_axis_ctes("h3", "tr3", ["repeat", "fold"], K, FEATS, SEED, 10, "n_u"),
     f"""pr3 AS (SELECT r.repeat, r.grp AS fold, r.doc_id, any_value(r.y) AS y_true, avg({Q.gnb_p1(FEATS)}) AS p1
  FROM b3 r JOIN h3_model m ON m.repeat = r.repeat AND m.fold = r.grp GROUP BY r.repeat, r.grp, r.doc_id)""",
     Q.auc_ctes("a3", "pr3", ["repeat", "fold"])],
    f"""SELECT a.repeat, a.fold, {Q.r6('a.auc')} AS auc, {Q.r6('t.tpr')} AS tpr FROM a3 a JOIN
 (SELECT repeat, fold, avg(CASE WHEN p1 > 1.0 - p1 THEN 1.0 ELSE 0.0 END) AS tpr FROM pr3 WHERE y_true = 1 GROUP BY repeat, fold) t USING (repeat, fold)""")

# EX4: repeats of matched negatives + hold-out, plain vs PU
_EX4 = f"""rp4 AS (SELECT CAST(i AS INTEGER) AS repeat FROM range(0, 10) t(i)),
x4 AS (SELECT r.repeat, d.doc_id, d.grp, d.y, {', '.join('d.' + f for f in FEATS)} FROM pu_docs d, rp4 r),
m4 AS (SELECT * FROM (SELECT x.*, row_number() OVER (PARTITION BY x.repeat, x.grp ORDER BY
    {Q.H(Q.ht(Q.q(SEED), Q.q('matched'), Q.vc('x.repeat'), Q.vc('x.doc_id')))}, x.doc_id) AS rn FROM x4 x WHERE y = 0) z
  JOIN (SELECT repeat, grp, count(*) AS n FROM x4 WHERE y = 1 GROUP BY repeat, grp) c USING (repeat, grp) WHERE rn <= n),
b4 AS (SELECT repeat, doc_id, y, {_F} FROM x4 WHERE y = 1 UNION ALL SELECT repeat, doc_id, y, {_F} FROM m4),
t4 AS (SELECT * FROM (SELECT b.*, row_number() OVER (PARTITION BY b.repeat, b.y ORDER BY
    {Q.H(Q.ht(Q.q(SEED), Q.q('holdout'), Q.vc('b.repeat'), Q.vc('b.doc_id')))}, b.doc_id) AS rn FROM b4 b) WHERE rn <= (SELECT count(*) // 20 FROM pu_docs WHERE y = 1)),
tr4 AS (SELECT b.* FROM b4 b WHERE NOT EXISTS (SELECT 1 FROM t4 t WHERE t.repeat = b.repeat AND t.doc_id = b.doc_id))"""
_EX4_PRED = f"""pr4 AS (
  SELECT 'mod' AS model, r.repeat, r.doc_id, any_value(r.y) AS y_true, avg({Q.gnb_p1(FEATS)}) AS p1
  FROM t4 r JOIN gp_model m ON m.repeat = r.repeat GROUP BY r.repeat, r.doc_id
  UNION ALL
  SELECT 'pu', r.repeat, r.doc_id, any_value(r.y), avg({Q.gnb_p1(FEATS)})
  FROM t4 r JOIN h4_model m ON m.repeat = r.repeat GROUP BY r.repeat, r.doc_id)"""
SQL["ex4_repeat_eval"] = with_sql(
    [Q.PU_DOCS, _EX4, Q.gnb_plain_ctes("tr4", K, FEATS, axis=["repeat"]),
     Q.pu_axis_ctes("h4", "tr4", ["repeat"], K, FEATS, SEED, 10, "n_u"), _EX4_PRED,
     Q.auc_ctes("a4", "pr4", ["repeat", "model"])],
    f"""SELECT a.repeat, a.model, {Q.r6('t.tpr')} AS tpr, {Q.r6('a.auc')} AS auc FROM a4 a JOIN
 (SELECT repeat, model, avg(CASE WHEN p1 > 1.0 - p1 THEN 1.0 ELSE 0.0 END) AS tpr FROM pr4 WHERE y_true = 1
  GROUP BY repeat, model) t USING (repeat, model)""")

# EX1: one plain model per feature on the matched hold-out
_EX1 = f"""m1 AS (SELECT * FROM (SELECT d.*, row_number() OVER (PARTITION BY grp ORDER BY {Q.hk(SEED, 'matched', _DK)}, doc_id) AS rn
  FROM pu_docs d WHERE y = 0) z JOIN (SELECT grp, count(*) AS n FROM pu_docs WHERE y = 1 GROUP BY grp) c USING (grp)
  WHERE rn <= n),
b1 AS (SELECT doc_id, y, {_F} FROM pu_docs WHERE y = 1 UNION ALL SELECT doc_id, y, {_F} FROM m1),
te1 AS (SELECT * FROM (SELECT b.*, row_number() OVER (PARTITION BY y ORDER BY {Q.hk(SEED, 'holdout', _DK)}, doc_id) AS rn
  FROM b1 b) WHERE rn <= (SELECT count(*) // 20 FROM pu_docs WHERE y = 1)),
tr1 AS (SELECT * FROM b1 WHERE doc_id NOT IN (SELECT doc_id FROM te1)),
ltr1 AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, doc_id, y, {f} AS x FROM tr1" for f in FEATS)}),
lte1 AS ({' UNION ALL '.join(f"SELECT '{f}' AS feature, doc_id, y AS y_true, {f} AS x FROM te1" for f in FEATS)})"""
_EX1_PRED = f"""pr1 AS (SELECT r.feature, r.doc_id, r.y_true, {Q.gnb_p1(['x'])} AS p1
  FROM lte1 r JOIN gp_model m ON m.feature = r.feature)"""
SQL["ex1_single_feature_eval"] = with_sql(
    [Q.PU_DOCS, _EX1, Q.gnb_plain_ctes("ltr1", K, ["x"], axis=["feature"]), _EX1_PRED, Q.auc_ctes("a1", "pr1", ["feature"])],
    f"""SELECT a.feature, {Q.r6('a.auc')} AS auc, {Q.r6('t.tpr')} AS tpr FROM a1 a JOIN
 (SELECT feature, avg(CASE WHEN p1 > 1.0 - p1 THEN 1.0 ELSE 0.0 END) AS tpr FROM pr1 WHERE y_true = 1 GROUP BY feature) t
 USING (feature)""")


def _ev_sql(pred: str, by: str) -> str:
    return f"""SELECT {by},
  sum(CASE WHEN y_true = 1 AND p1 > 1.0 - p1 THEN 1 ELSE 0 END) AS tp,
  sum(CASE WHEN y_true = 0 AND p1 > 1.0 - p1 THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN y_true = 0 AND NOT p1 > 1.0 - p1 THEN 1 ELSE 0 END) AS tn,
  sum(CASE WHEN y_true = 1 AND NOT p1 > 1.0 - p1 THEN 1 ELSE 0 END) AS fn FROM {pred} GROUP BY {by}"""


_ACC = "(tp + tn) / (tp + fp + tn + fn)"
_REC = "tp / nullif(tp + fn, 0)"
_F1 = "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0)"

# EX10: hide sweep on the stratified training part, metrics on the untouched test part
_EX10 = f"""{Q.stratified_n("pu_docs", "n10", 0.2)},
s10 AS (SELECT pu_docs.*, row_number() OVER (PARTITION BY y ORDER BY {Q.hk(SEED, 'strat', _DK)}, doc_id)
   <= n_test AS is_test FROM pu_docs JOIN n10 USING (y)),
tr10 AS (SELECT doc_id, y, {_F} FROM s10 WHERE NOT is_test),
te10 AS (SELECT doc_id, y AS y_true, {_F} FROM s10 WHERE is_test),
lv10 AS (SELECT CAST((SELECT count(*) FROM pu_docs WHERE y = 1) * k // 20 AS INTEGER) AS level FROM range(0, 15) t(k)),
rk10 AS (SELECT doc_id, row_number() OVER (ORDER BY {Q.hk(SEED, 'hide', _DK)}, doc_id) AS rk FROM tr10 WHERE y = 1),
sw10 AS (SELECT l.level, t.doc_id, CAST(CASE WHEN r.rk IS NOT NULL AND r.rk <= l.level THEN 0 ELSE t.y END AS INTEGER) AS y,
  {', '.join('t.' + f for f in FEATS)} FROM tr10 t LEFT JOIN rk10 r ON t.doc_id = r.doc_id, lv10 l),
ev10 AS (SELECT l.level, t.* FROM te10 t, lv10 l),
pr10 AS (
  SELECT 'mod' AS model, r.level, r.doc_id, any_value(r.y_true) AS y_true, avg({Q.gnb_p1(FEATS)}) AS p1
  FROM ev10 r JOIN gp_model m ON m.level = r.level GROUP BY r.level, r.doc_id
  UNION ALL
  SELECT 'pu', r.level, r.doc_id, any_value(r.y_true), avg({Q.gnb_p1(FEATS)})
  FROM ev10 r JOIN h10_model m ON m.level = r.level GROUP BY r.level, r.doc_id)"""
SQL["ex10_hide_sweep_eval"] = with_sql(
    [Q.PU_DOCS, _EX10[:_EX10.index(",\npr10 AS")], Q.gnb_plain_ctes("sw10", K, FEATS, axis=["level"]),
     Q.pu_axis_ctes("h10", "sw10", ["level"], K, FEATS, SEED, 100, "100"), _EX10[_EX10.index("pr10 AS"):],
     f"e10 AS ({_ev_sql('pr10', 'level, model')})"],
    f"SELECT level, model, {Q.r6(_F1)} AS f1, {Q.r6(_ACC)} AS accuracy, {Q.r6(_REC)} AS recall FROM e10")

# EX6: feature ablation, three sources of the new feature, 10 resamples x 10 hold-outs
_F7 = FEATS + ["f7"]
_X6 = ["source", "resample", "holdout"]
_EX6 = f"""k6 AS (SELECT doc_id, y, {_F}, f7, 'known' AS src FROM pu_docs),
g6 AS (SELECT doc_id, y, {_F}, (f4 + f5) / nullif(f1, 0) AS f7, 'predicted' AS src FROM pu_docs),
u6 AS (SELECT *, 'known' AS source FROM k6 UNION ALL SELECT *, 'predicted' FROM g6 UNION ALL SELECT *, 'both' FROM k6 UNION ALL SELECT *, 'both' FROM g6),
d6 AS (SELECT * REPLACE (coalesce(f7, avg(f7) OVER (PARTITION BY source, y)) AS f7) FROM u6),
x6 AS (SELECT CAST(i AS INTEGER) AS resample, d.* FROM d6 d, range(0, 10) t(i)),
n6 AS (SELECT source, resample, count(*) AS n FROM x6 WHERE y = 1 GROUP BY source, resample),
ng6 AS (SELECT * FROM (SELECT x.*, row_number() OVER (PARTITION BY x.source, x.resample ORDER BY
    {Q.H(Q.ht(Q.q(SEED), Q.q('balanced'), Q.vc('x.resample'), Q.vc('x.doc_id'), 'x.src'))}, x.doc_id, x.src) AS rn FROM x6 x WHERE y = 0) z
  JOIN n6 USING (source, resample) WHERE rn <= n),
b6 AS (SELECT source, resample, doc_id, src, y, {', '.join(_F7)} FROM x6 WHERE y = 1 UNION ALL SELECT source, resample, doc_id, src, y, {', '.join(_F7)} FROM ng6),
r6_ AS (SELECT CAST(i AS INTEGER) AS holdout, b.* FROM b6 b, range(0, 10) t(i)),
h6_ AS (SELECT *, row_number() OVER (PARTITION BY source, resample, holdout, y ORDER BY
    {Q.H(Q.ht(Q.q(SEED), Q.q('holdout'), Q.vc('holdout'), Q.vc('doc_id'), 'src'))}, doc_id, src) <= (SELECT count(*) // 20 FROM pu_docs WHERE y = 1) AS held FROM r6_),
tr6 AS (SELECT * EXCLUDE (held) FROM h6_ WHERE NOT held),
te6 AS (SELECT * EXCLUDE (held, y), y AS y_true FROM h6_ WHERE held)"""
_ON6 = " AND ".join(f"m.{a} = r.{a}" for a in _X6)
_EX6_PRED = "pr6 AS (" + " UNION ALL ".join(
    f"SELECT '{v}' AS variant, r.source, r.resample, r.holdout, r.doc_id, r.src, any_value(r.y_true) AS y_true, avg({Q.gnb_p1(fs)}) AS p1 "
    f"FROM te6 r JOIN {pfx}_model m ON {_ON6} GROUP BY r.source, r.resample, r.holdout, r.doc_id, r.src"
    for v, fs, pfx in (("F1_mod", ["f7"], "v1"), ("F6_mod", FEATS, "v6"), ("F7_mod", _F7, "v7"), ("F7_pu", _F7, "h6"))) + ")"
_K6 = [*K, "src"]
SQL["ex6_feature_ablation"] = with_sql(
    [Q.PU_DOCS, _EX6, Q.gnb_plain_ctes("tr6", _K6, ["f7"], "v1", axis=_X6),
     Q.gnb_plain_ctes("tr6", _K6, FEATS, "v6", axis=_X6), Q.gnb_plain_ctes("tr6", _K6, _F7, "v7", axis=_X6),
     Q.pu_axis_ctes("h6", "tr6", _X6, _K6, _F7, SEED, 10, "n_u"), _EX6_PRED,
     f"e6 AS ({_ev_sql('pr6', 'source, variant, resample, holdout')}),"
     f"s6 AS (SELECT source, variant, resample, avg({_REC}) AS tpr, avg({_F1}) AS f1 FROM e6 GROUP BY source, variant, resample)"],
    f"SELECT source, variant, {Q.r6('avg(tpr)')} AS tpr, {Q.r6('avg(f1)')} AS f1 FROM s6 GROUP BY source, variant")

# EX11: external validation set
_EX11 = f"""tp11 AS (SELECT * FROM pu_docs WHERE grp = 'en' AND y = 1),
po11 AS (SELECT * FROM pu_docs WHERE doc_id NOT IN (SELECT doc_id FROM tp11)),
tn11 AS (SELECT * FROM po11 WHERE y = 0 ORDER BY {Q.hk(SEED, 'exttest', _DK)}, doc_id LIMIT (SELECT count(*) FROM tp11)),
te11 AS (SELECT doc_id, y AS y_true, {_F} FROM tp11 UNION ALL SELECT doc_id, y, {_F} FROM tn11),
pl11 AS (SELECT * FROM po11 WHERE doc_id NOT IN (SELECT doc_id FROM tn11)),
nc11 AS (SELECT min(c) AS n FROM (SELECT y, count(*) AS c FROM pl11 GROUP BY y)),
rp11 AS (SELECT CAST(i AS INTEGER) AS repeat FROM range(0, 5) t(i)),
tr11 AS (SELECT repeat, doc_id, y, {_F} FROM (SELECT r.repeat, p.*, row_number() OVER (PARTITION BY r.repeat, p.y ORDER BY
    {Q.H(Q.ht(Q.q(SEED), Q.q('ext'), Q.vc('r.repeat'), Q.vc('p.doc_id')))}, p.doc_id) AS rn FROM pl11 p, rp11 r)
  WHERE rn <= (SELECT n FROM nc11)),
ev11 AS (SELECT r.repeat, t.* FROM te11 t, rp11 r)"""
_EX11_PRED = f"""pr11 AS (
  SELECT 'mod' AS model, r.repeat, r.doc_id, any_value(r.y_true) AS y_true, avg({Q.gnb_p1(FEATS)}) AS p1
  FROM ev11 r JOIN gp_model m ON m.repeat = r.repeat GROUP BY r.repeat, r.doc_id
  UNION ALL
  SELECT 'pu', r.repeat, r.doc_id, any_value(r.y_true), avg({Q.gnb_p1(FEATS)})
  FROM ev11 r JOIN h11_model m ON m.repeat = r.repeat GROUP BY r.repeat, r.doc_id)"""
SQL["ex11_external_validation"] = with_sql(
    [Q.PU_DOCS, _EX11, Q.gnb_plain_ctes("tr11", K, FEATS, axis=["repeat"]),
     Q.pu_axis_ctes("h11", "tr11", ["repeat"], K, FEATS, SEED, 100, "100"), _EX11_PRED,
     f"e11 AS ({_ev_sql('pr11', 'repeat, model')})", Q.auc_ctes("a11", "pr11", ["repeat", "model"])],
    f"SELECT e.repeat, e.model, {Q.r6(_F1)} AS f1, {Q.r6('a.auc')} AS auc FROM e11 e JOIN a11 a USING (repeat, model)")


def ex12_nested_grid_search(spark, sf):
    """EX12 / SO3: outer 5-fold x 48 candidates x inner 3-fold, all in one histogram-tree job."""
    r = J.nested_grid_search(pu_docs(spark, sf), FEATS, K, SEED, outer_k=5, inner_k=3)
    return r.select("outer_fold", "cand_id", "num_leaves", "min_child_samples", r6("auc_hard").alias("auc_hard"))


def ex12_nested_grid_search_boosted(spark, sf):
    """EX12 on boosted trees, 10 rounds: the learning rate of a candidate counts."""
    from pubag.operators.learners import registry
    learner = registry("boosted_trees", n_trees=10, max_depth=max(J.LEAVES_TO_DEPTH.values()), rows=1.0)
    r = J.nested_grid_search(pu_docs(spark, sf), FEATS, K, SEED, outer_k=5, inner_k=3, learner=learner)
    return r.select("outer_fold", "cand_id", "learning_rate", "num_leaves", "min_child_samples", "feature_fraction", "bagging_fraction",
                    r6("auc_hard").alias("auc_hard"))


QUERIES["ex12_nested_grid_search"] = ex12_nested_grid_search
QUERIES["ex12_nested_grid_search_boosted"] = ex12_nested_grid_search_boosted
QUERIES["so3_best_candidate"] = ex12_nested_grid_search

# EX9: reliability grid over OOB-score thresholds
_TH = ", ".join(repr(float(t)) for t in EX9_THRESHOLDS)
_EX9 = f"""{Q.stratified_n("pu_docs", "n9", 0.2)},
s9 AS (SELECT pu_docs.*, row_number() OVER (PARTITION BY y ORDER BY {Q.hk(SEED, 'strat', _DK)}, doc_id)
   <= n_test AS is_test FROM pu_docs JOIN n9 USING (y)),
tr9 AS (SELECT * FROM s9 WHERE NOT is_test),
va9 AS (SELECT * FROM s9 WHERE is_test),
{Q.gnb_oob("tr9", K, FEATS, SEED, 100, 100, prefix="o9")},
sc9 AS (SELECT o.doc_id, o.oob_score AS score, {', '.join('t.' + f for f in FEATS)} FROM o9_oob o
  JOIN tr9 t ON o.doc_id = t.doc_id WHERE o.y = 0),
th9 AS (SELECT i - 1 AS i, th FROM (SELECT unnest([{_TH}]) AS th, generate_subscripts([{_TH}], 1) AS i)),
rp9 AS (SELECT CAST(r AS INTEGER) AS repeat FROM range(0, 10) t(r)),
ng9 AS (SELECT CAST(t.i AS INTEGER) AS i, r.repeat, s.doc_id, {', '.join('s.' + f for f in FEATS)}
  FROM sc9 s JOIN th9 t ON s.score < t.th, rp9 r),
ps9 AS (SELECT CAST(t.i AS INTEGER) AS j, r.repeat, s.doc_id, {', '.join('s.' + f for f in FEATS)}
  FROM sc9 s JOIN th9 t ON s.score > t.th, rp9 r
  UNION ALL SELECT CAST(t.i AS INTEGER), r.repeat, p.doc_id, {', '.join('p.' + f for f in FEATS)}
  FROM tr9 p, th9 t, rp9 r WHERE p.y = 1),
sz9 AS (SELECT a.i, b.j, a.repeat, least(a.nn, b.np) AS n FROM
  (SELECT i, repeat, count(*) AS nn FROM ng9 GROUP BY i, repeat) a JOIN
  (SELECT j, repeat, count(*) AS np FROM ps9 GROUP BY j, repeat) b ON a.repeat = b.repeat AND a.i <= b.j
  WHERE least(a.nn, b.np) > 0),
sel9 AS (
  SELECT z.i, z.j, g.repeat, g.doc_id, 0 AS y, {', '.join('g.' + f for f in FEATS)} FROM (SELECT x.*, row_number() OVER (
      PARTITION BY x.i, x.repeat ORDER BY
      {Q.H(Q.ht(Q.q(SEED), Q.q('gneg'), Q.vc('x.i'), Q.vc('x.repeat'), Q.vc('x.doc_id')))}, x.doc_id) AS rn FROM ng9 x) g
    JOIN sz9 z ON g.i = z.i AND g.repeat = z.repeat WHERE g.rn <= z.n
  UNION ALL
  SELECT z.i, z.j, g.repeat, g.doc_id, 1 AS y, {', '.join('g.' + f for f in FEATS)} FROM (SELECT x.*, row_number() OVER (
      PARTITION BY x.j, x.repeat ORDER BY
      {Q.H(Q.ht(Q.q(SEED), Q.q('gpos'), Q.vc('x.j'), Q.vc('x.repeat'), Q.vc('x.doc_id')))}, x.doc_id) AS rn FROM ps9 x) g
    JOIN sz9 z ON g.j = z.j AND g.repeat = z.repeat WHERE g.rn <= z.n),
{Q.pu_axis_ctes("h9", "sel9", ["i", "j", "repeat"], K, FEATS, SEED, 10, "n_u")},
vp9 AS (SELECT doc_id, 1 AS y_true, {_F} FROM va9 WHERE y = 1),
vb9 AS (SELECT doc_id, 0 AS y_true, {_F} FROM va9 WHERE y = 0 ORDER BY {Q.hk(SEED, 'bvalid', _DK)}, doc_id
  LIMIT (SELECT count(*) FROM vp9)),
vv9 AS (SELECT * FROM vp9 UNION ALL SELECT * FROM vb9),
pr9 AS (SELECT m.i, m.j, m.repeat, r.doc_id, any_value(r.y_true) AS y_true, avg({Q.gnb_p1(FEATS)}) AS p1
  FROM vv9 r, h9_model m GROUP BY m.i, m.j, m.repeat, r.doc_id),
ev9 AS (SELECT i, j, repeat, avg(CASE WHEN y_true = 1 THEN (CASE WHEN p1 > 0.5 THEN 1.0 ELSE 0.0 END) END) AS tpr,
  sum(CASE WHEN y_true = 1 AND p1 > 0.5 THEN 1 ELSE 0 END) AS tp,
  sum(CASE WHEN y_true = 0 AND p1 > 0.5 THEN 1 ELSE 0 END) AS fp,
  sum(CASE WHEN y_true = 1 AND NOT p1 > 0.5 THEN 1 ELSE 0 END) AS fn FROM pr9 GROUP BY i, j, repeat)"""
SQL["ex9_reliability_grid"] = with_sql([Q.PU_DOCS, _EX9], f"""SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j,
 {Q.r6('avg(tpr)')} AS tpr, {Q.r6('avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0))')} AS f1,
 CAST(count(*) AS INTEGER) AS n FROM ev9 GROUP BY i, j""")


def _ex12_sql(outer_k: int = 5, inner_k: int = 3, nb: int = 32) -> str:
    """EX12 in SQL: undersampled ofo folds, inner folds, 48 candidates, one tree per (ofo, cand, inner)."""
    # the grid spelled out here: settings in the order of their names, the last varying fastest
    import hashlib
    import itertools

    def hv(*parts):
        return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)

    d = len(FEATS)
    rows = []
    for ci, (bagging, share, _rate, leaf, leaves) in enumerate(itertools.product([0.5, 1.0], [0.8, 1.0], [0.01, 0.5], [18, 19, 20], [5, 31])):
        order = sorted(range(d), key=lambda j: (hv(SEED, "featfrac", ci, j), j))
        allowed = sorted(order[:max(1, int(share * d))])
        rows.append(f"({ci}, {({5: 3, 31: 5})[leaves]}, {float(leaf)!r}, {bagging!r}, [{', '.join(map(str, allowed))}], '{leaves}', '{leaf}')")
    depth = 5
    ax = "ofo, cand, k"
    bins = ", ".join(
        f"CASE WHEN t.{f} IS NULL THEN -1 ELSE CAST(least(greatest(floor((t.{f} - r.lo{j}) / r.wd{j}), 0), {nb - 1}) AS INTEGER) END AS b{j}"
        for j, f in enumerate(FEATS))
    rng = ", ".join(f"min({f}) AS lo{j}, max({f}) AS hi{j}" for j, f in enumerate(FEATS))
    wd = ", ".join(f"lo{j}, CASE WHEN hi{j} > lo{j} THEN (hi{j} - lo{j}) / {nb}.0 ELSE 1.0 END AS wd{j}" for j in range(d))
    ctes = [Q.PU_DOCS, f"""cp12 AS (SELECT * FROM (VALUES {', '.join(rows)}) t(cand, cap, minleaf, bf, allowed, nl, mcs)),
o12 AS (SELECT doc_id, y, {_F}, CAST((row_number() OVER (PARTITION BY y ORDER BY {Q.hk(SEED, 'outer', _DK)}, doc_id) - 1)
  % {outer_k} AS INTEGER) AS fold FROM pu_docs),
r12 AS (SELECT o.*, CAST(t.i AS INTEGER) AS ofo FROM o12 o, range(0, {outer_k}) t(i) WHERE o.fold <> t.i),
n12 AS (SELECT ofo, count(*) AS n FROM r12 WHERE y = 1 GROUP BY ofo),
s12 AS (SELECT ofo, doc_id, y, {_F} FROM r12 WHERE y = 1 UNION ALL
  SELECT ofo, doc_id, y, {_F} FROM (SELECT r.*, row_number() OVER (PARTITION BY r.ofo ORDER BY
    {Q.H(Q.ht(Q.q(SEED), Q.q('under'), Q.vc('r.ofo'), Q.vc('r.doc_id')))}, r.doc_id) AS rn FROM r12 r WHERE y = 0) z
  JOIN n12 USING (ofo) WHERE rn <= n),
i12 AS (SELECT s.*, CAST((row_number() OVER (PARTITION BY s.ofo, s.y ORDER BY
    {Q.H(Q.ht(Q.q(SEED), Q.q('inner'), Q.vc('s.ofo'), Q.vc('s.doc_id')))}, s.doc_id) - 1) % {inner_k} AS INTEGER) AS ifold
  FROM s12 s),
t12 AS (SELECT i.ofo, c.cand, CAST(k.i AS INTEGER) AS k, i.doc_id, i.y, {', '.join('i.' + f for f in FEATS)}
  FROM i12 i, range(0, {inner_k}) k(i), cp12 c
  WHERE i.ifold <> k.i AND CAST({Q.H(Q.ht(Q.q(SEED), Q.q('bagfrac'), Q.vc('i.ofo'), Q.vc('c.cand'), Q.vc('CAST(k.i AS INTEGER)'), Q.vc('i.doc_id')))} AS DOUBLE)
    / 1152921504606846976.0 < c.bf),
rng AS (SELECT {rng} FROM t12),
rng2 AS (SELECT {wd} FROM rng),
cur0 AS (SELECT t.ofo, t.cand, t.k, CAST(t.y AS DOUBLE) AS y, 1.0 AS w, 1 AS node, {bins} FROM t12 t, rng2 r)"""]
    nodes = []
    for L in range(depth + 1):
        ctes.append(f"tot{L} AS (SELECT {ax}, node, sum(w) AS W, sum(w * y) AS WY FROM cur{L} GROUP BY {ax}, node)")
        if L == depth:
            nodes.append(f"SELECT {ax}, node, W, WY, -1 AS feat, -1 AS thr FROM tot{L}")
            break
        ex = " UNION ALL ".join(f"SELECT {ax}, node, w, y, {j} AS feat, b{j} AS bin FROM cur{L}" for j in range(d))
        ctes.append(f"""hist{L} AS (SELECT x.ofo, x.cand, x.k, x.node, x.feat, x.bin, any_value(c.minleaf) AS minleaf,
  sum(x.w) AS hw, sum(x.w * x.y) AS hwy FROM ({ex}) x JOIN cp12 c ON c.cand = x.cand
  WHERE c.cap > {L} AND list_contains(c.allowed, x.feat) GROUP BY x.ofo, x.cand, x.k, x.node, x.feat, x.bin),
cum{L} AS (SELECT *, sum(hw) OVER w AS lw, sum(hwy) OVER w AS lwy FROM hist{L}
  WINDOW w AS (PARTITION BY {ax}, node, feat ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
cand{L} AS (SELECT c.ofo, c.cand, c.k, c.node, c.feat, c.bin,
  t.WY * (t.W - t.WY) / t.W - c.lwy * (c.lw - c.lwy) / c.lw - (t.WY - c.lwy) * ((t.W - c.lw) - (t.WY - c.lwy)) / (t.W - c.lw) AS gain
  FROM cum{L} c JOIN tot{L} t USING (ofo, cand, k, node) WHERE c.lw >= c.minleaf AND t.W - c.lw >= c.minleaf),
best{L} AS (SELECT ofo, cand, k, node, feat, bin AS thr FROM (SELECT *, row_number() OVER (PARTITION BY {ax}, node
  ORDER BY round(gain, 9) DESC, feat, bin) AS rk FROM cand{L}) WHERE rk = 1 AND gain > 1e-12),
cur{L + 1} AS (SELECT c.ofo, c.cand, c.k, c.y, c.w, 2 * c.node + CASE WHEN (CASE s.feat
  {' '.join(f'WHEN {j} THEN c.b{j}' for j in range(d))} END) > s.thr THEN 1 ELSE 0 END AS node,
  {', '.join('c.b' + str(j) for j in range(d))}
  FROM cur{L} c JOIN best{L} s ON c.ofo = s.ofo AND c.cand = s.cand AND c.k = s.k AND c.node = s.node)""")
        nodes.append(f"SELECT t.ofo, t.cand, t.k, t.node, t.W, t.WY, coalesce(s.feat, -1) AS feat, coalesce(s.thr, -1) AS thr "
                     f"FROM tot{L} t LEFT JOIN best{L} s ON t.ofo = s.ofo AND t.cand = s.cand AND t.k = s.k AND t.node = s.node")
    ctes.append("nodes AS (" + " UNION ALL ".join(nodes) + ")")
    ctes.append(f"""v0 AS (SELECT i.ofo, c.cand, i.ifold AS k, i.doc_id, i.y AS y_true, 1 AS node, {bins.replace('t.', 'i.')}
  FROM i12 i, cp12 c, rng2 r)""")
    bsel = ", ".join(f"b{j}" for j in range(d))
    for L in range(depth):
        pick = "CASE n.feat " + " ".join(f"WHEN {j} THEN v.b{j}" for j in range(d)) + " END"
        ctes.append(f"""v{L + 1} AS (SELECT v.ofo, v.cand, v.k, v.doc_id, v.y_true, CASE WHEN n.feat < 0 THEN v.node
  ELSE 2 * v.node + CASE WHEN {pick} > n.thr THEN 1 ELSE 0 END END AS node, {bsel}
  FROM v{L} v JOIN nodes n ON n.ofo = v.ofo AND n.cand = v.cand AND n.k = v.k AND n.node = v.node)""")
    ctes.append(f"""pr12 AS (SELECT v.ofo, v.cand, v.k, v.y_true, coalesce(n.WY / n.W, 0.0) AS p1 FROM v{depth} v
  JOIN nodes n ON n.ofo = v.ofo AND n.cand = v.cand AND n.k = v.k AND n.node = v.node),
e12 AS (SELECT ofo, cand, k,
  (sum(CASE WHEN y_true = 1 AND p1 > 0.5 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN y_true = 1 THEN 1 ELSE 0 END), 0)
   + sum(CASE WHEN y_true = 0 AND NOT p1 > 0.5 THEN 1 ELSE 0 END) / nullif(sum(CASE WHEN y_true = 0 THEN 1 ELSE 0 END), 0))
   / 2.0 AS auc_hard FROM pr12 GROUP BY ofo, cand, k),
sc12 AS (SELECT ofo, cand, avg(auc_hard) AS auc_hard FROM e12 GROUP BY ofo, cand),
b12 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ofo ORDER BY auc_hard DESC, cand) AS rk FROM sc12)
  WHERE rk = 1)""")
    return with_sql(ctes, f"""SELECT CAST(b.ofo AS INTEGER) AS outer_fold, CAST(b.cand AS INTEGER) AS cand_id,
 c.nl AS num_leaves, c.mcs AS min_child_samples, {Q.r6('b.auc_hard')} AS auc_hard FROM b12 b JOIN cp12 c USING (cand)""")


SQL["ex12_nested_grid_search"] = _ex12_sql()
SQL["so3_best_candidate"] = SQL["ex12_nested_grid_search"]
