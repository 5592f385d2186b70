"""Registered queries: a fixed small number of steps of the iterative learners, checked parameter by parameter."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import functions as F

from pubag.catalog import sqlfrag as Q
from pubag.catalog.common import SEED, r6, with_sql
from pubag.operators.bagging import PUBagging
from pubag.operators.learners import registry
from pubag.sources.fixtures import DOCS, pu_docs

FEATS = DOCS.features
D = len(FEATS)
K = ["doc_id"]

# Bags and draws (as in EX8), and the sizes that SQL can follow.
T, DRAWS = 100, 100
SVM = {"dim": 8, "steps": 3}
MLP = {"hidden": 3, "steps": 2}


def _params(kind, **kw):
    def q(spark, sf):
        m = PUBagging(learner=registry(kind, **kw), n_estimators=T, max_samples=DRAWS, seed=SEED, oob_score=False).fit(pu_docs(spark, sf), FEATS, K)
        return m.models.select("bag", F.posexplode("params").alias("i", "v")).select("bag", "i", r6("v").alias("v"))
    return q


# Bags, depth, trees or rounds of the checked ensembles.
TREE_BAGS, DEPTH, FOREST, ROUNDS = 20, 2, 2, 2


def _nodes(kind, **kw):
    def q(spark, sf):
        m = PUBagging(learner=registry(kind, max_depth=DEPTH, **kw), n_estimators=TREE_BAGS, max_samples=DRAWS, seed=SEED, oob_score=False).fit(
            pu_docs(spark, sf), FEATS, K)
        t = m.models.select("bag", F.explode("trees").alias("t")).select("bag", F.col("t.no").alias("tree"), F.posexplode(F.arrays_zip("t.feat", "t.cut", "t.value")).alias("node", "n"))
        return t.where("n.value IS NOT NULL").select("bag", "tree", "node", F.col("n.feat").alias("feat"), F.col("n.cut").alias("cut"), r6("n.value").alias("value"))
    return q


QUERIES = {"bl3_random_forest_trees": _nodes("random_forest", n_trees=FOREST), "bl4_boosted_trees_rounds": _nodes("boosted_trees", n_trees=ROUNDS)}

QUERIES |= {"bl5_kernel_svm_steps": _params("kernel_svm", **SVM), "bl6_mlp_steps": _params("mlp", **MLP)}

_U = lambda text: f"((CAST({Q.H(text)} AS DOUBLE) + 0.5) / 1152921504606846976.0)"

#: Standardised rows of all bags, one row a feature: (bag, rid, y, w, j, z).
_ROWS = [Q.PU_DOCS, Q.gnb_fit_ctes("pu_docs", K, FEATS, SEED, T, DRAWS), f"""
sc AS ({' UNION ALL '.join(f"SELECT {j} AS j, avg({f}) AS m, CASE WHEN stddev_pop({f}) > 0 THEN stddev_pop({f}) ELSE 1.0 END AS s FROM pu_docs" for j, f in enumerate(FEATS))}),
rid AS (SELECT *, row_number() OVER () AS rid FROM g_bagged),
zs AS ({' UNION ALL '.join(f"SELECT bag, rid, y, w, {j} AS j, coalesce(({f} - m) / s, 0.0) AS z FROM rid, sc WHERE j = {j}" for j, f in enumerate(FEATS))}),
wt AS (SELECT bag, sum(w) AS wt FROM g_bagged GROUP BY bag)"""]


def _svm_sql(dim: int, steps: int, reg: float = 0.01) -> str:
    turn = f"sqrt({2.0 / D!r}) * sqrt(-2.0 * ln({_U(Q.ht(Q.q('0'), Q.q('rff'), Q.vc('k'), Q.vc('j'), Q.q('1')))})) * cos(2 * pi() * {_U(Q.ht(Q.q('0'), Q.q('rff'), Q.vc('k'), Q.vc('j'), Q.q('2')))})"
    ctes = [*_ROWS, f"""dirs AS (SELECT k, j, {turn} AS w FROM range(0, {dim}) a(k), range(0, {D}) b(j)),
phase AS (SELECT k, 2 * pi() * {_U(Q.ht(Q.q('0'), Q.q('rff-b'), Q.vc('k')))} AS b FROM range(0, {dim}) a(k)),
fx AS (SELECT z.bag, z.rid, any_value(z.y) AS y, any_value(z.w) AS w, d.k, sqrt({2.0 / dim!r}) * cos(sum(z.z * d.w) + any_value(p.b)) AS x
  FROM zs z JOIN dirs d ON d.j = z.j JOIN phase p ON p.k = d.k GROUP BY z.bag, z.rid, d.k
  UNION ALL SELECT bag, rid, y, w, {dim}, 1.0 FROM rid),
p0 AS (SELECT CAST(b AS INTEGER) AS bag, k, 0.0::DOUBLE AS v, 0.0::DOUBLE AS a FROM range(0, {T}) t(b), range(0, {dim + 1}) u(k))"""]
    for n in range(steps):
        ctes.append(f"""m{n} AS (SELECT f.bag, f.rid, greatest(0.0, 1.0 - any_value(2 * f.y - 1) * sum(f.x * p.a)) AS short
  FROM fx f JOIN p{n} p ON p.bag = f.bag AND p.k = f.k GROUP BY f.bag, f.rid),
g{n} AS (SELECT f.bag, f.k, -sum(f.w * (2 * f.y - 1) * m.short * f.x) AS g FROM fx f JOIN m{n} m ON m.bag = f.bag AND m.rid = f.rid GROUP BY f.bag, f.k),
n{n} AS (SELECT p.bag, p.k, p.v, p.a - (g.g / wt.wt + CASE WHEN p.k < {dim} THEN {reg!r} * p.a ELSE 0.0 END) / {reg + 3.0!r} AS nv
  FROM p{n} p JOIN g{n} g ON g.bag = p.bag AND g.k = p.k JOIN wt ON wt.bag = p.bag),
p{n + 1} AS (SELECT bag, k, nv AS v, nv + {n / (n + 3.0)!r} * (nv - v) AS a FROM n{n})""")
    return with_sql(ctes, f"SELECT bag, CAST(k AS INTEGER) AS i, {Q.r6('v')} AS v FROM p{steps}")


def _mlp_sql(hidden: int, steps: int, rate: float = 0.05, alpha: float = 1e-4) -> str:
    h = hidden
    n1, n2 = D * h, (D + 1) * h
    size = h * (D + 2) + 1
    ctes = [*_ROWS, f"""p0 AS (SELECT CAST(b AS INTEGER) AS bag, i, (2 * {_U(Q.ht(Q.q('0'), Q.q('mlp'), Q.vc('b'), Q.vc('i')))} - 1)
    * CASE WHEN i < {n2} THEN sqrt({2.0 / (D + h)!r}) ELSE sqrt({2.0 / (h + 1)!r}) END AS p, 0.0::DOUBLE AS m, 0.0::DOUBLE AS s
  FROM range(0, {T}) t(b), range(0, {size}) u(i))"""]
    for n in range(steps):
        k = n + 1
        ctes.append(f"""a{n} AS (SELECT z.bag, z.rid, z.y, z.w, u.u, 1.0 / (1.0 + exp(-(sum(z.z * p.p) + any_value(b.p)))) AS o
  FROM zs z, range(0, {h}) u(u) JOIN p{n} p ON p.bag = z.bag AND p.i = z.j * {h} + u.u JOIN p{n} b ON b.bag = z.bag AND b.i = {n1} + u.u
  GROUP BY z.bag, z.rid, z.y, z.w, u.u),
o{n} AS (SELECT a.bag, a.rid, any_value(a.w) * (1.0 / (1.0 + exp(-(sum(a.o * p.p) + any_value(b.p)))) - any_value(a.y)) AS back
  FROM a{n} a JOIN p{n} p ON p.bag = a.bag AND p.i = {n2} + a.u JOIN p{n} b ON b.bag = a.bag AND b.i = {size - 1} GROUP BY a.bag, a.rid),
d{n} AS (SELECT a.bag, a.rid, a.u, o.back * p.p * a.o * (1 - a.o) AS into_, o.back * a.o AS up
  FROM a{n} a JOIN o{n} o ON o.bag = a.bag AND o.rid = a.rid JOIN p{n} p ON p.bag = a.bag AND p.i = {n2} + a.u),
g{n} AS (SELECT z.bag, z.j * {h} + d.u AS i, sum(z.z * d.into_) AS g FROM zs z JOIN d{n} d ON d.bag = z.bag AND d.rid = z.rid GROUP BY z.bag, z.j, d.u
  UNION ALL SELECT bag, {n1} + u, sum(into_) FROM d{n} GROUP BY bag, u
  UNION ALL SELECT bag, {n2} + u, sum(up) FROM d{n} GROUP BY bag, u
  UNION ALL SELECT bag, {size - 1}, sum(back) FROM o{n} GROUP BY bag),
e{n} AS (SELECT p.bag, p.i, p.p, p.m, p.s, (g.g + CASE WHEN p.i < {n1} OR p.i BETWEEN {n2} AND {size - 2} THEN {alpha!r} * p.p ELSE 0.0 END) / wt.wt AS g
  FROM p{n} p JOIN g{n} g ON g.bag = p.bag AND g.i = p.i JOIN wt ON wt.bag = p.bag),
q{n} AS (SELECT bag, i, p, 0.9 * m + 0.1 * g AS m, 0.999 * s + 0.001 * g * g AS s FROM e{n}),
p{k} AS (SELECT bag, i, p - {rate!r} * (m / (1 - pow(0.9, {k}))) / (sqrt(s / (1 - pow(0.999, {k}))) + 1e-8) AS p, m, s FROM q{n})""")
    return with_sql(ctes, f"SELECT bag, CAST(i AS INTEGER) AS i, {Q.r6('p')} AS v FROM p{steps}")


SQL = {"bl5_kernel_svm_steps": _svm_sql(**SVM), "bl6_mlp_steps": _mlp_sql(**MLP)}

_P = 2147483647
_LINE = lambda name, r: (f"(((1 + {Q.H(Q.ht(*name, Q.q('a')))} % {_P - 1}) * {r} + {Q.H(Q.ht(*name, Q.q('c')))} % {_P}) % {_P} + 0.5) / {_P}.0")

#: Rows in bins of quantiles: once (doc_id, y, r, b0…).
_BINNED = f"""
qs AS (SELECT {', '.join(f"list_sort(list({f})) AS l{j}" for j, f in enumerate(FEATS))} FROM pu_docs),
cuts AS (SELECT {', '.join(f"list_distinct(list_transform(range(1, 32), lambda k: l{j}[greatest(1, ceil(k / 32.0 * len(l{j})))::INT])) AS c{j}" for j in range(D))} FROM qs),
once AS (SELECT doc_id, y, {Q.H(Q.ht(Q.q('row'), Q.vc('doc_id')))} % {_P} AS r,
  {', '.join(f"CASE WHEN {f} IS NULL THEN -1 ELSE len(list_filter(c{j}, lambda v: {f} > v)) END AS b{j}" for j, f in enumerate(FEATS))} FROM pu_docs, cuts)"""

#: Binned rows of all bags: (bag, doc_id, times, y, r, b0…).
_PAIRS = [Q.PU_DOCS, Q.gnb_fit_ctes("pu_docs", K, FEATS, SEED, TREE_BAGS, DRAWS), _BINNED, f"""
pairs AS (SELECT m.bag, m.times, o.* FROM (
  SELECT doc_id, CAST(i AS INTEGER) AS bag, 1 AS times FROM g_p, range(0, {TREE_BAGS}) t(i) UNION ALL SELECT doc_id, bag, w FROM g_bags) m JOIN once o USING (doc_id))"""]

_B = ", ".join(f"b{j}" for j in range(D))


def _subset(name: str, take: int, seed: list[str], models: str) -> str:
    """CTE of the features (m, feat) that a model may use: the first by hash."""
    return f"""{name} AS (SELECT m, feat FROM (SELECT m, feat, row_number() OVER (PARTITION BY m ORDER BY {Q.H(Q.ht(*seed, Q.vc('feat')))}, feat) AS rk
  FROM {models}, range(0, {D}) f(feat)) WHERE rk <= {take})"""


def _grow(p: str, rows: str, allowed: str, min_leaf: float) -> str:
    """CTEs up to {p}n (m, node, feat, thr, value): trees on rows (m, w, wy, b0…)."""
    out, nodes = [f"{p}c0 AS (SELECT m, w, wy, 1 AS node, {_B} FROM {rows})"], []
    for n in range(DEPTH + 1):
        out.append(f"{p}t{n} AS (SELECT m, node, sum(w) AS tw, sum(wy) AS twy FROM {p}c{n} GROUP BY m, node)")
        if n == DEPTH:
            nodes.append(f"SELECT m, node, -1 AS feat, -1 AS thr, twy / tw AS value FROM {p}t{n}")
            break
        ex = " UNION ALL ".join(f"SELECT m, node, {j} AS feat, b{j} AS bin, sum(w) AS hw, sum(wy) AS hwy FROM {p}c{n} GROUP BY m, node, b{j}" for j in range(D))
        out.append(f"""{p}h{n} AS (SELECT x.*, sum(hw) OVER o AS lw, sum(hwy) OVER o AS lwy FROM ({ex}) x JOIN {allowed} a ON a.m = x.m AND a.feat = x.feat
  WINDOW o AS (PARTITION BY x.m, x.node, x.feat ORDER BY x.bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{p}b{n} AS (SELECT * FROM (SELECT m, node, feat, bin, row_number() OVER (PARTITION BY m, node ORDER BY round(gain, 9) DESC, feat, bin) AS rk, gain FROM (
  SELECT h.m, h.node, h.feat, h.bin, t.twy * (t.tw - t.twy) / t.tw - h.lwy * (h.lw - h.lwy) / h.lw
    - (t.twy - h.lwy) * ((t.tw - h.lw) - (t.twy - h.lwy)) / (t.tw - h.lw) AS gain
  FROM {p}h{n} h JOIN {p}t{n} t ON t.m = h.m AND t.node = h.node WHERE h.lw >= {min_leaf!r} AND t.tw - h.lw >= {min_leaf!r})) WHERE rk = 1 AND gain > 1e-12),
{p}c{n + 1} AS (SELECT c.m, c.w, c.wy, 2 * c.node + CASE WHEN (CASE s.feat {' '.join(f'WHEN {j} THEN c.b{j}' for j in range(D))} END) > s.bin THEN 1 ELSE 0 END AS node,
  {', '.join(f'c.b{j}' for j in range(D))} FROM {p}c{n} c JOIN {p}b{n} s ON s.m = c.m AND s.node = c.node)""")
        nodes.append(f"SELECT t.m, t.node, coalesce(s.feat, -1), coalesce(s.bin, -1), t.twy / t.tw FROM {p}t{n} t LEFT JOIN {p}b{n} s ON s.m = t.m AND s.node = t.node")
    out.append(f"{p}n(m, node, feat, thr, value) AS ({' UNION ALL '.join(nodes)})")
    return ",\n".join(out)


_OUT = "CAST(node AS INTEGER) AS node, CAST(feat AS INTEGER) AS feat, CAST(thr AS INTEGER) AS cut, " + Q.r6("value") + " AS value"


def _forest_sql() -> str:
    steps = list(itertools.accumulate(math.exp(-1) / math.factorial(k) for k in range(18)))
    u = _LINE([Q.q("0"), Q.q("forest"), Q.vc("bag"), Q.vc("t")], "r")
    return with_sql([*_PAIRS, f"""drawn AS (SELECT *, bag * {FOREST} + t AS m, {u} AS u FROM pairs, range(0, {FOREST}) x(t)),
weighed AS (SELECT *, (times * len(list_filter({steps}, lambda s: u >= s)))::DOUBLE AS w FROM drawn),
rows_ AS (SELECT m, w, w * y AS wy, {_B} FROM weighed WHERE w > 0),
models AS (SELECT CAST(b * {FOREST} + t AS INTEGER) AS m, b, t FROM range(0, {TREE_BAGS}) x(b), range(0, {FOREST}) z(t))""",
                     _subset("al", round(0.7 * D), [Q.q("0"), Q.vc("b"), Q.q("feat"), Q.vc("t")], "models"),
                     _grow("f", "rows_", "al", 1.0)],
                    f"SELECT CAST(m // {FOREST} AS INTEGER) AS bag, CAST(m % {FOREST} AS INTEGER) AS tree, {_OUT} FROM fn")


def _boosted_sql(rate: float = 0.5, share: float = 0.5) -> str:
    ctes = [*_PAIRS, f"models AS (SELECT CAST(b AS INTEGER) AS m, b FROM range(0, {TREE_BAGS}) x(b))",
                    "g0 AS (SELECT *, bag AS m, 0.0::DOUBLE AS margin FROM pairs)"]
    for k in range(ROUNDS):
        u = _LINE([Q.q("0"), Q.q("rows"), Q.q(str(k)), Q.vc("bag")], "r")
        ctes += [_subset(f"al{k}", round(0.8 * D), [Q.q("0"), Q.q(str(k)), Q.vc("b"), Q.q("feat"), Q.q("0")], "models"),
                 f"""p{k} AS (SELECT *, 1.0 / (1.0 + exp(-margin)) AS p FROM g{k}),
rows{k} AS (SELECT m, times * p * (1 - p) AS w, times * (y - p) AS wy, {_B} FROM p{k} WHERE {u} < {share!r})""",
                 _grow(f"r{k}", f"rows{k}", f"al{k}", 1e-3)]
        if k + 1 < ROUNDS:
            walk = "w0 AS (SELECT *, 1 AS node FROM g0)"
            for n in range(DEPTH):
                pick = "CASE n.feat " + " ".join(f"WHEN {j} THEN w.b{j}" for j in range(D)) + " END"
                walk += f""",
w{n + 1} AS (SELECT w.* EXCLUDE (node), CASE WHEN n.feat < 0 THEN w.node ELSE 2 * w.node + CASE WHEN {pick} > n.thr THEN 1 ELSE 0 END END AS node
  FROM w{n} w JOIN r{k}n n ON n.m = w.m AND n.node = w.node)"""
            ctes += [walk, f"""g{k + 1} AS (SELECT w.* EXCLUDE (node, margin), w.margin + {rate!r} * n.value AS margin
  FROM w{DEPTH} w JOIN r{k}n n ON n.m = w.m AND n.node = w.node)"""]
    return with_sql(ctes, " UNION ALL ".join(f"SELECT CAST(m AS INTEGER) AS bag, CAST({k} AS INTEGER) AS tree, {_OUT} FROM r{k}n" for k in range(ROUNDS)))


SQL |= {"bl3_random_forest_trees": _forest_sql(), "bl4_boosted_trees_rounds": _boosted_sql()}
