"""Registered queries: PU ensemble fit / OOB / predict (PU*, EX8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pubag.catalog import sqlfrag as Q
from pubag.catalog.common import M_OOB, SEED, T_OOB, r6, with_sql
from pubag.operators.bagging import PUBagging
from pubag.sources.fixtures import DOCS, pu_docs

FEATS = DOCS.features


def _fit_docs(spark, sf, T=T_OOB, m=M_OOB, **kw):
    df = pu_docs(spark, sf)
    return df, PUBagging(n_estimators=T, max_samples=m, seed=SEED, **kw).fit(df, FEATS, DOCS.key)


def ex8_oob_score_background(spark, sf):
    """EX8: P ∪ U -> T=100 bags of 100 draws -> OOB score of every unlabelled row."""
    _, model = _fit_docs(spark, sf)
    s = model.oob_scores(include_positives=False)
    return s.select("doc_id", "y", r6("oob_score").alias("oob_score"), "n_votes")


def pu4_oob_score(spark, sf):
    """PU4: OOB score of every training row; positives are NULL with 0 votes."""
    _, model = _fit_docs(spark, sf)
    s = model.oob_scores(include_positives=True)
    return s.select("doc_id", "y", r6("oob_score").alias("oob_score"), "n_votes")


def pu5_oob_accuracy(spark, sf):
    _, model = _fit_docs(spark, sf)
    return model.oob_score_().select(r6("oob_accuracy").alias("oob_accuracy"))


def pu6_predict_proba(spark, sf):
    df, model = _fit_docs(spark, sf, T=10, m=100)
    return model.predict_proba(df.select("doc_id", *FEATS)).select("doc_id", r6("p1").alias("p1"))


def pu7_predict(spark, sf):
    df, model = _fit_docs(spark, sf, T=10, m=100)
    return model.predict(df.select("doc_id", *FEATS)).select("doc_id", "yhat")


def pu9_decision_function(spark, sf):
    df, model = _fit_docs(spark, sf, T=10, m=100)
    return model.decision_function(df.select("doc_id", *FEATS)).select("doc_id", r6("margin").alias("margin"))


def sa11_membership(spark, sf):
    _, model = _fit_docs(spark, sf, T=10, m=100)
    return model.members().select("doc_id", "bag", "w")


def bl1_gaussian_nb_model(spark, sf):
    """BL1: per-bag model table (class counts, means and variances)."""
    _, model = _fit_docs(spark, sf, T=10, m=100)
    return model.models.select(
        "bag", r6("n0").alias("n0"), r6("n1").alias("n1"),
        *[r6(F.col(c)[j]).alias(f"{c}_{j}") for c in ("mu0", "v0", "mu1", "v1") for j in range(len(FEATS))],
    )


QUERIES = {
    "ex8_oob_score_background": ex8_oob_score_background,
    "pu4_oob_score": pu4_oob_score,
    "pu5_oob_accuracy": pu5_oob_accuracy,
    "pu6_predict_proba": pu6_predict_proba,
    "pu7_predict": pu7_predict,
    "pu9_decision_function": pu9_decision_function,
    "sa11_membership": sa11_membership,
    "bl1_gaussian_nb_model": bl1_gaussian_nb_model,
}

_K = ["doc_id"]


def _oob_sql(where: str) -> str:
    return with_sql([Q.PU_DOCS, Q.gnb_oob("pu_docs", _K, FEATS, SEED, T_OOB, M_OOB)],
                    f"SELECT doc_id, y, {Q.r6('oob_score')} AS oob_score, n_votes FROM g_oob {where}")


def _pred_sql(expr: str, alias: str) -> str:
    fit = Q.gnb_fit_ctes("pu_docs", _K, FEATS, SEED, 10, 100)
    return with_sql([Q.PU_DOCS, fit], f"""SELECT r.doc_id, {expr} AS {alias}
FROM pu_docs r, g_model m GROUP BY r.doc_id""")


SQL = {
    "ex8_oob_score_background": _oob_sql("WHERE y = 0"),
    "pu4_oob_score": _oob_sql(""),
    "pu5_oob_accuracy": with_sql(
        [Q.PU_DOCS, Q.gnb_oob("pu_docs", _K, FEATS, SEED, T_OOB, M_OOB)],
        "SELECT " + Q.r6("avg(CASE WHEN (CASE WHEN coalesce(oob_score > 0.5, false) THEN 1 ELSE 0 END) = y "
                        "THEN 1.0 ELSE 0.0 END)") + " AS oob_accuracy FROM g_oob"),
    "pu6_predict_proba": _pred_sql(Q.r6(f"avg({Q.gnb_p1(FEATS)})"), "p1"),
    "pu7_predict": _pred_sql(f"CAST(CASE WHEN avg({Q.gnb_p1(FEATS)}) > 0.5 THEN 1 ELSE 0 END AS INTEGER)", "yhat"),
    "pu9_decision_function": _pred_sql(Q.r6(f"avg({Q.gnb_margin(FEATS)})"), "margin"),
    "sa11_membership": with_sql([Q.PU_DOCS, Q.gnb_fit_ctes("pu_docs", _K, FEATS, SEED, 10, 100)],
                                "SELECT doc_id, bag, CAST(w AS INTEGER) AS w FROM g_bags"),
    "bl1_gaussian_nb_model": with_sql(
        [Q.PU_DOCS, Q.gnb_fit_ctes("pu_docs", _K, FEATS, SEED, 10, 100)],
        "SELECT bag, " + Q.r6("n0") + " AS n0, " + Q.r6("n1") + " AS n1, "
        + ", ".join(f"{Q.r6(f'{c}_{j}')} AS {c}_{j}" for c in ("mu0", "v0", "mu1", "v1") for j in range(len(FEATS)))
        + " FROM g_model"),
}


# --- BL2: histogram decision trees for all bags ------------------------------------


def _tree_model(spark, sf, depth):
    from pubag.operators.learners.tree import DecisionTree
    d = pu_docs(spark, sf)
    return d, PUBagging(learner=DecisionTree(max_depth=depth), n_estimators=10, max_samples=100,
                        seed=SEED).fit(d, FEATS, DOCS.key)


def bl2_decision_tree(spark, sf):
    """BL2 (depth 1): per bag the chosen split and the two leaf values."""
    _, m = _tree_model(spark, sf, 1)
    return m.models.select("bag", F.col("feat")[1].alias("feat"), F.col("cut")[1].alias("thr"),
                           r6(F.col("value")[2]).alias("v_left"), r6(F.col("value")[3]).alias("v_right"))


def bl2_decision_tree_oob(spark, sf):
    """BL2 (depth 3) inside PU bagging: OOB scores of the unlabelled documents."""
    _, m = _tree_model(spark, sf, 3)
    return m.oob_scores(include_positives=False).select("doc_id", r6("oob_score").alias("oob_score"), "n_votes")


QUERIES["bl2_decision_tree"] = bl2_decision_tree
QUERIES["bl2_decision_tree_oob"] = bl2_decision_tree_oob


def _stump_sql() -> str:
    nb = 32
    fit = Q.gnb_fit_ctes("pu_docs", _K, FEATS, SEED, 10, 100)
    rng = ", ".join(f"min({f}) AS lo{j}, max({f}) AS hi{j}" for j, f in enumerate(FEATS))
    wd = ", ".join(f"lo{j}, CASE WHEN hi{j} > lo{j} THEN (hi{j} - lo{j}) / {nb}.0 ELSE 1.0 END AS wd{j}"
                   for j in range(len(FEATS)))
    ex = " UNION ALL ".join(
        f"SELECT b.bag, b.y, b.w, {j} AS feat, CASE WHEN b.{f} IS NULL THEN -1 ELSE "
        f"CAST(least(greatest(floor((b.{f} - r.lo{j}) / r.wd{j}), 0), {nb - 1}) AS INTEGER) END AS bin "
        f"FROM g_bagged b, rng2 r" for j, f in enumerate(FEATS))
    return with_sql([Q.PU_DOCS, fit, f"rng AS (SELECT {rng} FROM g_rows)", f"rng2 AS (SELECT {wd} FROM rng)",
                     f"ex AS ({ex})",
                     "hist AS (SELECT bag, feat, bin, sum(w) AS hw, sum(w * y) AS hwy FROM ex GROUP BY bag, feat, bin)",
                     """cum AS (SELECT *, sum(hw) OVER w AS lw, sum(hwy) OVER w AS lwy FROM hist
  WINDOW w AS (PARTITION BY bag, feat ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
                     "tot AS (SELECT bag, CAST(sum(w) AS DOUBLE) AS W, CAST(sum(w * y) AS DOUBLE) AS WY FROM g_bagged GROUP BY bag)",
                     """cand AS (SELECT c.bag, c.feat, c.bin, CAST(c.lw AS DOUBLE) AS lw, CAST(c.lwy AS DOUBLE) AS lwy, t.W, t.WY,
  t.WY * (t.W - t.WY) / t.W - CAST(c.lwy AS DOUBLE) * (CAST(c.lw AS DOUBLE) - CAST(c.lwy AS DOUBLE)) / CAST(c.lw AS DOUBLE)
  - (t.WY - c.lwy) * ((t.W - c.lw) - (t.WY - c.lwy)) / (t.W - c.lw) AS gain
  FROM cum c JOIN tot t USING (bag) WHERE c.lw >= 1.0 AND t.W - c.lw >= 1.0)""",
                     """best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bag ORDER BY round(gain, 9) DESC, feat, bin) AS rk
  FROM cand) WHERE rk = 1 AND gain > 1e-12)"""],
                    f"""SELECT t.bag, CAST(coalesce(b.feat, -1) AS INTEGER) AS feat, CAST(coalesce(b.bin, -1) AS INTEGER) AS thr,
 {Q.r6('b.lwy / b.lw')} AS v_left, {Q.r6('(b.WY - b.lwy) / (b.W - b.lw)')} AS v_right
FROM tot t LEFT JOIN best b USING (bag)""")


SQL["bl2_decision_tree"] = _stump_sql()


def _tree_oob_sql(depth: int = 3, nb: int = 32) -> str:
    """Level-wise histogram trees for the 10 bags in SQL, then OOB traversal of the U rows."""
    fit = Q.gnb_fit_ctes("pu_docs", _K, FEATS, SEED, 10, 100)
    d = len(FEATS)
    rng = ", ".join(f"min({f}) AS lo{j}, max({f}) AS hi{j}" for j, f in enumerate(FEATS))
    wd = ", ".join(f"lo{j}, CASE WHEN hi{j} > lo{j} THEN (hi{j} - lo{j}) / {nb}.0 ELSE 1.0 END AS wd{j}"
                   for j in range(d))

    def bins(alias):
        return ", ".join(
            f"CASE WHEN {alias}.{f} IS NULL THEN -1 ELSE CAST(least(greatest(floor(({alias}.{f} - r.lo{j}) / r.wd{j}), 0), "
            f"{nb - 1}) AS INTEGER) END AS b{j}" for j, f in enumerate(FEATS))

    bsel = ", ".join(f"b{j}" for j in range(d))
    ctes = [Q.PU_DOCS, fit, f"rng AS (SELECT {rng} FROM g_rows)", f"rng2 AS (SELECT {wd} FROM rng)",
            f"cur0 AS (SELECT b.bag, CAST(b.y AS DOUBLE) AS y, CAST(b.w AS DOUBLE) AS w, 1 AS node, {bins('b')} "
            f"FROM g_bagged b, rng2 r)"]
    nodes = []
    for L in range(depth + 1):
        ctes.append(f"tot{L} AS (SELECT bag, node, sum(w) AS W, sum(w * y) AS WY FROM cur{L} GROUP BY bag, node)")
        if L == depth:
            nodes.append(f"SELECT bag, node, W, WY, -1 AS feat, -1 AS thr FROM tot{L}")
            break
        ex = " UNION ALL ".join(f"SELECT bag, node, w, y, {j} AS feat, b{j} AS bin FROM cur{L}" for j in range(d))
        ctes.append(f"""hist{L} AS (SELECT bag, node, feat, bin, sum(w) AS hw, sum(w * y) AS hwy FROM ({ex}) GROUP BY ALL),
cum{L} AS (SELECT *, sum(hw) OVER w AS lw, sum(hwy) OVER w AS lwy FROM hist{L}
  WINDOW w AS (PARTITION BY bag, node, feat ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
cand{L} AS (SELECT c.bag, c.node, c.feat, c.bin,
  t.WY * (t.W - t.WY) / t.W - c.lwy * (c.lw - c.lwy) / c.lw - (t.WY - c.lwy) * ((t.W - c.lw) - (t.WY - c.lwy)) / (t.W - c.lw) AS gain
  FROM cum{L} c JOIN tot{L} t USING (bag, node) WHERE c.lw >= 1.0 AND t.W - c.lw >= 1.0),
best{L} AS (SELECT bag, node, feat, bin AS thr FROM (SELECT *, row_number() OVER (PARTITION BY bag, node
  ORDER BY round(gain, 9) DESC, feat, bin) AS rk FROM cand{L}) WHERE rk = 1 AND gain > 1e-12),
cur{L + 1} AS (SELECT c.bag, c.y, c.w, 2 * c.node + CASE WHEN (CASE s.feat {' '.join(f'WHEN {j} THEN c.b{j}' for j in range(d))} END)
  > s.thr THEN 1 ELSE 0 END AS node, {', '.join('c.b' + str(j) for j in range(d))}
  FROM cur{L} c JOIN best{L} s ON c.bag = s.bag AND c.node = s.node)""")
        nodes.append(f"SELECT t.bag, t.node, t.W, t.WY, coalesce(s.feat, -1) AS feat, coalesce(s.thr, -1) AS thr FROM tot{L} t "
                     f"LEFT JOIN best{L} s ON t.bag = s.bag AND t.node = s.node")
    ctes.append("nodes AS (" + " UNION ALL ".join(nodes) + ")")
    # traversal of every U row in every bag that left it out
    ctes.append(f"""u0 AS (SELECT u.doc_id, m.bag, 1 AS node, {bins('u')} FROM g_u u, rng2 r,
  (SELECT DISTINCT bag FROM g_model) m WHERE NOT EXISTS (SELECT 1 FROM g_bags g WHERE g.doc_id = u.doc_id AND g.bag = m.bag))""")
    for L in range(depth):
        pick = "CASE n.feat " + " ".join(f"WHEN {j} THEN u.b{j}" for j in range(d)) + " END"
        ctes.append(f"""u{L + 1} AS (SELECT u.doc_id, u.bag, CASE WHEN n.feat < 0 THEN u.node
  ELSE 2 * u.node + CASE WHEN {pick} > n.thr THEN 1 ELSE 0 END END AS node, {bsel}
  FROM u{L} u JOIN nodes n ON n.bag = u.bag AND n.node = u.node)""")
    ctes.append(f"""pv AS (SELECT u.doc_id, coalesce(n.WY / n.W, 0.0) AS p FROM u{depth} u
  JOIN nodes n ON n.bag = u.bag AND n.node = u.node)""")
    return with_sql(ctes, f"""SELECT u.doc_id, {Q.r6('v.s')} AS oob_score, CAST(coalesce(v.n, 0) AS INTEGER) AS n_votes
FROM g_u u LEFT JOIN (SELECT doc_id, avg(p) AS s, count(*) AS n FROM pv GROUP BY doc_id) v ON u.doc_id = v.doc_id""")


SQL["bl2_decision_tree_oob"] = _tree_oob_sql(3)
