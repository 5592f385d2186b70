"""Registered queries: feature contributions (FC1, FC3, FC4 / SO5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pubag.catalog import sqlfrag as Q
from pubag.catalog.common import SEED, r6, with_sql
from pubag.operators import explain as X
from pubag.operators import sampling as S
from pubag.operators.bagging import PUBagging, fit_plain
from pubag.sources.fixtures import DOCS, pu_docs

FEATS = DOCS.features
K = ["doc_id"]


def _phi(spark, sf):
    d = pu_docs(spark, sf)
    m = fit_plain(d, FEATS, K)
    return X.contributions(m, d.select("doc_id", *FEATS))


def fc1_contributions(spark, sf):
    """FC1: exact Shapley values of the plain Gaussian NB log-odds for every document."""
    return _phi(spark, sf).select("doc_id", "feature", r6("phi").alias("phi"))


def fc4_contribution_summary(spark, sf):
    """FC4 / SO5: mean |phi| per feature and its rank."""
    s = X.contribution_summary(_phi(spark, sf))
    return s.select("feature", r6("mean_abs_phi").alias("mean_abs_phi"), r6("mean_phi").alias("mean_phi"),
                    F.col("rank").cast("int").alias("rank"))


def fc3_pu_contributions(spark, sf):
    """FC3: coalition Shapley values of the PU ensemble probability for 5 sampled test rows,
    background = 100 sampled training rows (the reference's sample sizes)."""
    d = pu_docs(spark, sf)
    sp = S.stratified_split(d, K, SEED, 0.2)
    train, test = sp.filter(~F.col("is_test")), sp.filter(F.col("is_test"))
    m = PUBagging(n_estimators=10, max_samples="n_pos", seed=SEED, oob_score=False).fit(train, FEATS, K)
    explain_rows = S.sample_n(test, 5, K, SEED, "shap-x")
    phi = X.coalition_contributions(m, explain_rows, train, 100, SEED)
    return phi.select("doc_id", "feature", r6("phi").alias("phi"), r6("fx").alias("fx"), r6("ef").alias("ef"))


# Background rows, depth and features of the checked tree and interaction values.
BACKGROUND, TREE_DEPTH, FEW = 20, 2, FEATS[:3]


def fc1_tree_contributions(spark, sf):
    """FC1 on a tree: Shapley values of its probability for every document, by leaf paths."""
    from pubag.operators.learners.tree import DecisionTree
    d = pu_docs(spark, sf)
    m = fit_plain(d, FEATS, K, learner=DecisionTree(max_depth=TREE_DEPTH, quantiles=True))
    phi = X.tree_contributions(m, d.select("doc_id", *FEATS), d, BACKGROUND, SEED)
    return phi.select("doc_id", "feature", r6("phi").alias("phi"))


def fc1_boosted_contributions(spark, sf):
    """FC1 on bagged boosted trees (dart): Shapley values of the mean margin for every document."""
    from pubag.operators.learners import registry
    d = pu_docs(spark, sf)
    m = PUBagging(learner=registry("boosted_trees", n_trees=10, drop=0.1), n_estimators=10, max_samples="n_pos", seed=SEED, oob_score=False).fit(d, FEATS, K)
    return X.tree_contributions(m, d.select("doc_id", *FEATS), d, BACKGROUND, SEED).select("doc_id", "feature", r6("phi").alias("phi"))


def fc2_interaction_values(spark, sf):
    """FC2: Shapley interaction values of the PU ensemble's probability over three features, every document."""
    d = pu_docs(spark, sf)
    m = PUBagging(n_estimators=10, max_samples=100, seed=SEED, oob_score=False).fit(d, FEW, K)
    v = X.interaction_values(m, d.select("doc_id", *FEW), d, BACKGROUND, SEED)
    return v.select("doc_id", "feature_i", "feature_j", r6("value").alias("value"))


def fc3_many_features(spark, sf):
    """FC3 beyond 12 features: the PU ensemble over all 64 dimensions of the embeddings, 5 sampled rows, drawn coalitions."""
    from pubag.sources.fixtures import VEC, pu_vec
    d = pu_vec(spark, sf)
    m = PUBagging(n_estimators=10, max_samples="n_pos", seed=SEED, oob_score=False).fit(d, VEC.features, VEC.key)
    phi = X.coalition_contributions(m, S.sample_n(d, 5, VEC.key, SEED, "shap-x"), d, 100, SEED)
    return phi.select("vec_id", "feature", r6("phi").alias("phi"), r6("fx").alias("fx"), r6("ef").alias("ef"))


QUERIES = {
    "fc1_tree_contributions": fc1_tree_contributions,
    "fc1_boosted_contributions": fc1_boosted_contributions,
    "fc2_interaction_values": fc2_interaction_values,
    "fc3_many_features": fc3_many_features,
    "fc1_contributions": fc1_contributions,
    "fc3_pu_contributions": fc3_pu_contributions,
    "fc4_contribution_summary": fc4_contribution_summary,
}

_FIT = Q.gnb_plain_ctes("pu_docs", K, FEATS)
_TERMS = ",\n".join(
    f"-0.5 * ((ln(m.v1_{j}) + (r.{f} - m.mu1_{j}) * (r.{f} - m.mu1_{j}) / m.v1_{j}) - "
    f"(ln(m.v0_{j}) + (r.{f} - m.mu0_{j}) * (r.{f} - m.mu0_{j}) / m.v0_{j})) AS g{j}" for j, f in enumerate(FEATS))
_G = f"g AS (SELECT r.doc_id, {_TERMS} FROM pu_docs r, gp_model m)"
_E = "e AS (SELECT " + ", ".join(f"avg(g{j}) AS e{j}" for j in range(len(FEATS))) + " FROM g)"
_PHI = "phi AS (" + " UNION ALL ".join(
    f"SELECT g.doc_id, '{f}' AS feature, g.g{j} - e.e{j} AS phi FROM g, e" for j, f in enumerate(FEATS)) + ")"

SQL = {
    "fc1_contributions": with_sql([Q.PU_DOCS, _FIT, _G, _E, _PHI],
                                  f"SELECT doc_id, feature, {Q.r6('phi')} AS phi FROM phi"),
    "fc4_contribution_summary": with_sql(
        [Q.PU_DOCS, _FIT, _G, _E, _PHI],
        f"""SELECT feature, {Q.r6('avg(abs(phi))')} AS mean_abs_phi, {Q.r6('avg(phi)')} AS mean_phi,
 CAST(row_number() OVER (ORDER BY avg(abs(phi)) DESC, feature) AS INTEGER) AS rank FROM phi GROUP BY feature"""),
}


def _fc3_sql() -> str:
    import math

    d = len(FEATS)
    dk = Q.vc("doc_id")
    split = f"""{Q.stratified_n("pu_docs", "n3", 0.2)},
s3 AS (SELECT pu_docs.*, row_number() OVER (PARTITION BY y ORDER BY {Q.hk(SEED, 'strat', dk)}, doc_id)
   <= n_test AS is_test FROM pu_docs JOIN n3 USING (y)),
tr3 AS (SELECT * FROM s3 WHERE NOT is_test),
te3 AS (SELECT * FROM s3 WHERE is_test)"""
    fit = Q.gnb_fit_ctes("tr3", K, FEATS, SEED, 10, "SELECT count(*) FROM tr3 WHERE y = 1")
    hyb = ", ".join(f"CASE WHEN (c.S >> {j}) & 1 = 1 THEN x.{f} ELSE z.{f} END AS {f}" for j, f in enumerate(FEATS))
    weights = ", ".join(f"({k}, {math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d)!r})"
                        for k in range(d))
    rest = f"""bg3 AS (SELECT * FROM tr3 ORDER BY {Q.hk(SEED, 'shap-bg', dk)}, doc_id LIMIT 100),
ex3 AS (SELECT * FROM te3 ORDER BY {Q.hk(SEED, 'shap-x', dk)}, doc_id LIMIT 5),
co3 AS (SELECT CAST(i AS INTEGER) AS S FROM range(0, {1 << d}) t(i)),
hy3 AS (SELECT x.doc_id, c.S, z.doc_id AS bg_id, {hyb} FROM ex3 x, co3 c, bg3 z),
pp3 AS (SELECT r.doc_id, r.S, r.bg_id, avg({Q.gnb_p1(FEATS)}) AS p FROM hy3 r, g_model m GROUP BY r.doc_id, r.S, r.bg_id),
v3 AS (SELECT doc_id, S, avg(p) AS v FROM pp3 GROUP BY doc_id, S),
w3 AS (SELECT * FROM (VALUES {weights}) t(k, w)),
ft3 AS (SELECT * FROM (VALUES {', '.join(f"({j}, '{f}')" for j, f in enumerate(FEATS))}) t(j, feature)),
ph3 AS (SELECT a.doc_id, f.feature, sum(w.w * (b.v - a.v)) AS phi
  FROM v3 a JOIN ft3 f ON (a.S >> f.j) & 1 = 0
  JOIN v3 b ON b.doc_id = a.doc_id AND b.S = a.S | (1 << f.j)
  JOIN w3 w ON w.k = bit_count(a.S) GROUP BY a.doc_id, f.feature)"""
    return with_sql([Q.PU_DOCS, split, fit, rest], f"""SELECT p.doc_id, p.feature, {Q.r6('p.phi')} AS phi,
 {Q.r6('fx.v')} AS fx, {Q.r6('e.v')} AS ef FROM ph3 p JOIN v3 fx ON fx.doc_id = p.doc_id AND fx.S = {(1 << d) - 1}
 JOIN v3 e ON e.doc_id = p.doc_id AND e.S = 0""")


SQL["fc3_pu_contributions"] = _fc3_sql()


def _phi_sql(d: int) -> str:
    """CTE phi (doc_id, j, phi) of coalition values vs (doc_id, S, v)."""
    import math

    weights = ", ".join(f"({k}, {math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d)!r})" for k in range(d))
    return f"""phi AS (SELECT a.doc_id, j, sum(w * (b.v - a.v)) AS phi FROM vs a JOIN range(0, {d}) f(j) ON (a.S >> j) & 1 = 0
  JOIN vs b ON b.doc_id = a.doc_id AND b.S = a.S | (1 << j) JOIN (VALUES {weights}) w(k, w) ON w.k = bit_count(a.S) GROUP BY a.doc_id, j)"""


def _tree_phi_sql() -> str:
    from pubag.catalog.learners import _BINNED, _grow

    d = len(FEATS)
    hyb = ", ".join(f"CASE WHEN (S >> {j}) & 1 = 1 THEN x.b{j} ELSE z.b{j} END AS b{j}" for j in range(d))
    walk = []
    for n in range(TREE_DEPTH):
        pick = "CASE n.feat " + " ".join(f"WHEN {j} THEN w.b{j}" for j in range(d)) + " END"
        walk.append(f"""w{n + 1} AS (SELECT w.* EXCLUDE (node), CASE WHEN n.feat < 0 THEN w.node ELSE 2 * w.node + CASE WHEN {pick} > n.thr THEN 1 ELSE 0 END END AS node
  FROM w{n} w JOIN tn n ON n.node = w.node)""")
    ctes = [Q.PU_DOCS, _BINNED, "rows_ AS (SELECT 0 AS m, 1.0::DOUBLE AS w, y::DOUBLE AS wy, * EXCLUDE (y) FROM once)",
            f"al AS (SELECT 0 AS m, feat FROM range(0, {d}) f(feat))", _grow("t", "rows_", "al", 1.0),
            f"bg AS (SELECT o.* FROM once o JOIN pu_docs p USING (doc_id) ORDER BY {Q.hk(SEED, 'shap-bg', Q.vc('doc_id'))}, doc_id LIMIT {BACKGROUND})",
            f"w0 AS (SELECT x.doc_id, S, 1 AS node, {hyb} FROM once x, bg z, range(0, {1 << d}) c(S))", *walk,
            f"vs AS (SELECT w.doc_id, w.S, avg(n.value) AS v FROM w{TREE_DEPTH} w JOIN tn n ON n.node = w.node GROUP BY w.doc_id, w.S)", _phi_sql(d)]
    return with_sql(ctes, f"SELECT doc_id, [{', '.join(repr(f) for f in FEATS)}][j + 1] AS feature, {Q.r6('phi')} AS phi FROM phi")


def _interaction_sql() -> str:
    """Three features: the pair's interaction without and with the third, each with weight 1/4 (1 / (2 (d-1)!))."""
    names = "[" + ", ".join(repr(f) for f in FEW) + "]"
    hyb = ", ".join(f"CASE WHEN (S >> {j}) & 1 = 1 THEN x.{f} ELSE z.{f} END AS {f}" for j, f in enumerate(FEW))
    return with_sql([Q.PU_DOCS, Q.gnb_fit_ctes("pu_docs", K, FEW, SEED, 10, 100),
                     f"bg AS (SELECT * FROM pu_docs ORDER BY {Q.hk(SEED, 'shap-bg', Q.vc('doc_id'))}, doc_id LIMIT {BACKGROUND})",
                     f"hy AS (SELECT x.doc_id, S, {hyb} FROM pu_docs x, bg z, range(0, 8) c(S))",
                     f"vs AS (SELECT r.doc_id, r.S, avg({Q.gnb_p1(FEW)}) AS v FROM hy r, g_model m GROUP BY r.doc_id, r.S)", _phi_sql(3),
                     """pr AS (SELECT a.doc_id, i, j, sum(b.v - c.v - e.v + a.v) / 4.0 AS value
  FROM range(0, 3) p(i), range(0, 3) q(j), vs a JOIN vs b ON b.doc_id = a.doc_id AND b.S = a.S | (1 << i) | (1 << j)
  JOIN vs c ON c.doc_id = a.doc_id AND c.S = a.S | (1 << i) JOIN vs e ON e.doc_id = a.doc_id AND e.S = a.S | (1 << j)
  WHERE i <> j AND (a.S >> i) & 1 = 0 AND (a.S >> j) & 1 = 0 GROUP BY a.doc_id, i, j)""",
                     """al AS (SELECT * FROM pr UNION ALL SELECT p.doc_id, p.j, p.j, p.phi - s.others FROM phi p
  JOIN (SELECT doc_id, i, sum(value) AS others FROM pr GROUP BY doc_id, i) s ON s.doc_id = p.doc_id AND s.i = p.j)"""],
                    f"SELECT doc_id, {names}[i + 1] AS feature_i, {names}[j + 1] AS feature_j, {Q.r6('value')} AS value FROM al")


SQL["fc1_tree_contributions"] = _tree_phi_sql()
SQL["fc2_interaction_values"] = _interaction_sql()
