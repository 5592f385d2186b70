"""Registered queries: exact hash sampling, bags, splits, ranks (SA*, SO2, SO4, WI4, WI5)."""

from __future__ import annotations

import math
import re

from pyspark.sql import functions as F

from pubag.catalog import sqlfrag as Q
from pubag.catalog.common import SEED, n_pos, with_sql
from pubag.operators import sampling as S
from pubag.sources.fixtures import DOCS, LINES, pu_docs, pu_lines

LK = LINES.key
LKT = Q.keytext(LK)
DK = Q.vc("doc_id")


def _u(spark, sf):
    return pu_docs(spark, sf).filter(F.col("y") < 1)


def sa1_sample_n(spark, sf):
    return S.sample_n(pu_lines(spark, sf), 5000, LK, SEED).select(*LK, "y")


def sa2_sample_matched(spark, sf):
    d = pu_docs(spark, sf)
    return S.sample_matched(d.filter(F.col("y") < 1), d.filter(F.col("y") == 1), "doc_id", SEED).select("doc_id", "grp")


def sa3_sample_balanced(spark, sf):
    d = pu_docs(spark, sf)
    return S.sample_balanced(d.filter(F.col("y") < 1), d.filter(F.col("y") == 1), "doc_id", SEED).select("doc_id")


def sa4_undersample_majority(spark, sf):
    return S.undersample_majority(pu_lines(spark, sf), LK, SEED).select(*LK, "y")


def sa5_bootstrap(spark, sf):
    n_u = _u(spark, sf).count()
    return S.bootstrap_draws(spark, 10, 100, n_u, SEED).select("bag", "pos", "w")


def sa6_subsample(spark, sf):
    return S.subsample_members(_u(spark, sf), "doc_id", 10, 100, SEED).select("bag", "doc_id")


LAM = 1.0


def sa7_poisson_bootstrap(spark, sf):
    u = _u(spark, sf).withColumn("_pw", S.poisson_weights("doc_id", SEED, 10, LAM))
    e = u.select("doc_id", F.posexplode("_pw").alias("bag", "w"))
    return e.filter(F.col("w") > 0).select("doc_id", F.col("bag").cast("int").alias("bag"), "w")


def sa7_poisson_scale_mode(spark, sf):
    """SA7 as ``PUBagging(mode="poisson")`` draws: one hash a row, a line a bag; in-bag rows of a fitted ensemble."""
    from pubag.operators.bagging import PUBagging
    m = PUBagging(n_estimators=10, max_samples=1.0, seed=SEED, mode="poisson").fit(pu_docs(spark, sf), DOCS.features, "doc_id")
    return m.members().select("doc_id", "bag", F.col("w").cast("int").alias("w"))


def sa8_pu_bag(spark, sf):
    """SA8: every bag = all positives once (w = 1) + bootstrap draws of U."""
    from pubag.operators.bagging import PUBagging
    d = pu_docs(spark, sf)
    m = PUBagging(n_estimators=10, max_samples=100, seed=SEED, oob_score=False).fit(d, DOCS.features, "doc_id")
    pos = d.filter(F.col("y") == 1).select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("bag"),
                                           F.lit(1).alias("w"))
    return m.members().select("doc_id", "bag", "w").unionByName(pos)


def sa12_holdout_n(spark, sf):
    d = pu_docs(spark, sf)
    train, test = S.holdout_n(d, n_pos(d) // 10, "doc_id", SEED)
    return test.select("doc_id", F.lit("test").alias("role")).unionByName(train.select("doc_id", F.lit("train").alias("role")))


def sa13_leave_one_group_out(spark, sf):
    return S.leave_one_group_out(pu_docs(spark, sf), "doc_id").select("fold", "role", "doc_id")


def sa14_stratified_split(spark, sf):
    return S.stratified_split(pu_docs(spark, sf), "doc_id", SEED, 0.2).select("doc_id", "y", "is_test")


def sa15_stratified_kfold(spark, sf):
    return S.stratified_kfold(pu_docs(spark, sf), "doc_id", SEED, 5).select("doc_id", "y", "fold")


def sa16_chunks(spark, sf):
    return S.chunks(_u(spark, sf), "doc_id", SEED, 100).select("doc_id", "chunk")


def sa17_hide_labels(spark, sf):
    d = pu_docs(spark, sf)
    return S.hide_labels(d, n_pos(d) // 2, "doc_id", SEED).select("doc_id", "y", "y_true")


def sa18_hide_sweep(spark, sf):
    """SA18: 0 to 70 % of the positives in 15 levels."""
    d = pu_docs(spark, sf)
    n = n_pos(d)
    d = S.hide_sweep(d, [n * k // 20 for k in range(15)], "doc_id", SEED)
    return d.filter(F.col("y_true") == 1).select("level", "doc_id", "y")


def sa19_repeats(spark, sf):
    """SA19: ten reseeded matched negative samples at once (repeat is a column)."""
    d = pu_docs(spark, sf)
    neg = S.repeats(d.filter(F.col("y") < 1), 10)
    n = S.repeats(S.group_counts(d.filter(F.col("y") == 1)), 10)
    return S.first_n(neg, n, "doc_id", SEED, "matched", parts=["repeat", "grp"],
                     extra=(F.col("repeat"),)).select("repeat", "doc_id")


def so2_take_n(spark, sf):
    return S.take_n(pu_lines(spark, sf), 10, LK, SEED).select(*LK)


def so4_dense_position(spark, sf):
    return S.dense_position(pu_lines(spark, sf), LK, SEED).select(*LK, "pos")


def wi4_n_per_group(spark, sf):
    r = S.rank_in(pu_docs(spark, sf), "doc_id", SEED, "npg", parts=["grp"])
    return r.filter(F.col("rank") <= 5).select("grp", "doc_id", "rank")


def wi5_fold_of(spark, sf):
    return S.stratified_kfold(pu_lines(spark, sf), LK, SEED, 10, tag="fold").select(*LK, "fold")


QUERIES = {k: v for k, v in globals().items() if re.match(r"^(sa|so|wi)\d+_", k) and callable(v)}

# ---------------------------------------------------------------------------------- SQL

D = [Q.PU_DOCS]
LN = [Q.PU_LINES]
LKC = ", ".join(LK)


def _rn(tag, key_sql, keys, part="", extra=()):
    p = f"PARTITION BY {part} " if part else ""
    return f"row_number() OVER ({p}ORDER BY {Q.hk(SEED, tag, key_sql, *extra)}, {keys})"


_PRIME = 2147483647


def _steps() -> list[float]:
    """P(X <= j) of the Poisson distribution; beyond 25 terms it is 1 in double precision."""
    out, cdf = [], 0.0
    for j in range(25):
        cdf += math.exp(-LAM) * LAM**j / math.factorial(j)
        out.append(cdf)
    return out


def _pois_sql(bag: int) -> str:
    u = f"(CAST({Q.H(Q.ht(Q.q(SEED), Q.q('pois'), Q.q(bag), DK))} AS DOUBLE) / 1152921504606846976.0)"
    # 25 terms: beyond them P(X <= j) is 1 in double precision
    terms, cdf = [], 0.0
    for j in range(25):
        cdf += math.exp(-LAM) * LAM**j / math.factorial(j)
        terms.append(f"CASE WHEN {u} >= {cdf!r} THEN 1 ELSE 0 END")
    return " + ".join(terms)


_GF = Q.gnb_fit_ctes("pu_docs", ["doc_id"], DOCS.features, SEED, 10, 100)

SQL = {
    "sa1_sample_n": with_sql(LN, f"SELECT {LKC}, y FROM pu_lines ORDER BY {Q.hk(SEED, 'sample', LKT)}, {LKC} LIMIT 5000"),
    "sa2_sample_matched": with_sql(D, f"""SELECT doc_id, grp FROM (
  SELECT doc_id, grp, {_rn('matched', DK, 'doc_id', 'grp')} AS rn FROM pu_docs WHERE y < 1) u
JOIN (SELECT grp, count(*) AS n FROM pu_docs WHERE y = 1 GROUP BY grp) p USING (grp) WHERE rn <= n"""),
    "sa3_sample_balanced": with_sql(D, f"""SELECT doc_id FROM pu_docs WHERE y < 1
ORDER BY {Q.hk(SEED, 'balanced', DK)}, doc_id LIMIT (SELECT count(*) FROM pu_docs WHERE y = 1)"""),
    "sa4_undersample_majority": with_sql(LN, f"""SELECT {LKC}, y FROM pu_lines WHERE y = 1 UNION ALL
SELECT {LKC}, y FROM (SELECT * FROM pu_lines WHERE y = 0 ORDER BY {Q.hk(SEED, 'under', LKT)}, {LKC}
  LIMIT (SELECT count(*) FROM pu_lines WHERE y = 1))"""),
    "sa5_bootstrap": with_sql(D + [_GF], "SELECT bag, pos, CAST(w AS INTEGER) AS w FROM g_dpos"),
    "sa6_subsample": with_sql(D, f"""SELECT bag, doc_id FROM (
  SELECT b.bag, u.doc_id, row_number() OVER (PARTITION BY b.bag ORDER BY
    {Q.H(Q.ht(Q.q(SEED), Q.q('sub'), Q.vc('b.bag'), Q.vc('u.doc_id')))}, u.doc_id) AS rn
  FROM (SELECT * FROM pu_docs WHERE y < 1) u, (SELECT CAST(i AS INTEGER) AS bag FROM range(0, 10) t(i)) b)
WHERE rn <= 100"""),
    "sa7_poisson_bootstrap": with_sql(D, " UNION ALL ".join(
        f"SELECT doc_id, {b} AS bag, w FROM (SELECT doc_id, CAST({_pois_sql(b)} AS INTEGER) AS w "
        f"FROM pu_docs WHERE y < 1) WHERE w > 0" for b in range(10))),
    "sa7_poisson_scale_mode": with_sql(D + [f"""rw AS (SELECT doc_id, {Q.H(Q.ht(Q.q('row'), DK))} % {_PRIME} AS r FROM pu_docs WHERE y < 1),
uu AS (SELECT doc_id, CAST(b AS INTEGER) AS bag, (((1 + {Q.H(Q.ht(Q.q(SEED), Q.q('pois'), Q.vc('b'), Q.q('a')))} % {_PRIME - 1}) * r
  + {Q.H(Q.ht(Q.q(SEED), Q.q('pois'), Q.vc('b'), Q.q('c')))} % {_PRIME}) % {_PRIME} + 0.5) / {_PRIME}.0 AS u FROM rw, range(0, 10) t(b)),
ww AS (SELECT doc_id, bag, CAST(len(list_filter({_steps()}, lambda c: u >= c)) AS INTEGER) AS w FROM uu)"""], "SELECT * FROM ww WHERE w > 0"),
    "sa8_pu_bag": with_sql(D + [_GF], """SELECT doc_id, bag, CAST(w AS INTEGER) AS w FROM g_bags UNION ALL
SELECT doc_id, CAST(i AS INTEGER), 1 FROM pu_docs, range(0, 10) t(i) WHERE y = 1"""),
    "sa13_leave_one_group_out": with_sql(D, """SELECT g.grp AS fold, 'test' AS role, d.doc_id
FROM pu_docs d JOIN (SELECT DISTINCT grp FROM pu_docs) g ON d.grp = g.grp
UNION ALL SELECT g.grp, 'train', d.doc_id FROM pu_docs d JOIN (SELECT DISTINCT grp FROM pu_docs) g ON d.grp <> g.grp"""),
    "sa14_stratified_split": with_sql(D + [Q.stratified_n("pu_docs", "strat_n", 0.2)], f"""SELECT doc_id, y, rn <= n_test AS is_test FROM (
  SELECT doc_id, y, {_rn('strat', DK, 'doc_id', 'y')} AS rn FROM pu_docs) JOIN strat_n USING (y)"""),
    "sa15_stratified_kfold": with_sql(D, f"""SELECT doc_id, y, CAST(({_rn('kfold', DK, 'doc_id', 'y')} - 1) % 5 AS INTEGER)
 AS fold FROM pu_docs"""),
    "sa16_chunks": with_sql(D, f"""SELECT doc_id, CAST(({_rn('chunk', DK, 'doc_id')} - 1) // 100 AS INTEGER) AS chunk
FROM pu_docs WHERE y < 1"""),
    "sa17_hide_labels": with_sql(D, f"""SELECT d.doc_id, CAST(CASE WHEN h.doc_id IS NOT NULL THEN 0 ELSE d.y END AS INTEGER) AS y,
 d.y AS y_true FROM pu_docs d LEFT JOIN (SELECT doc_id FROM (SELECT doc_id, {_rn('hide', DK, 'doc_id')} AS rn
 FROM pu_docs WHERE y = 1) WHERE rn <= (SELECT count(*) // 2 FROM pu_docs WHERE y = 1)) h ON d.doc_id = h.doc_id"""),
    "sa18_hide_sweep": with_sql(D, f"""SELECT CAST(l.level AS INTEGER) AS level, p.doc_id,
 CAST(CASE WHEN p.rn <= l.level THEN 0 ELSE 1 END AS INTEGER) AS y
FROM (SELECT doc_id, {_rn('hide', DK, 'doc_id')} AS rn FROM pu_docs WHERE y = 1) p,
 (SELECT (SELECT count(*) FROM pu_docs WHERE y = 1) * k // 20 AS level FROM range(0, 15) t(k)) l"""),
    "sa19_repeats": with_sql(D, f"""SELECT CAST(r.repeat AS INTEGER) AS repeat, doc_id FROM (
  SELECT r.repeat, u.doc_id, u.grp, row_number() OVER (PARTITION BY r.repeat, u.grp ORDER BY
     {Q.H(Q.ht(Q.q(SEED), Q.q('matched'), Q.vc('r.repeat'), Q.vc('u.doc_id')))}, u.doc_id) AS rn
  FROM (SELECT * FROM pu_docs WHERE y < 1) u, (SELECT i AS repeat FROM range(0, 10) t(i)) r) r
JOIN (SELECT grp, count(*) AS n FROM pu_docs WHERE y = 1 GROUP BY grp) p USING (grp) WHERE rn <= n"""),
    "so2_take_n": with_sql(LN, f"SELECT {LKC} FROM pu_lines ORDER BY {Q.hk(SEED, 'sample', LKT)}, {LKC} LIMIT 10"),
    "so4_dense_position": with_sql(LN, f"SELECT {LKC}, {_rn('pos', LKT, LKC)} - 1 AS pos FROM pu_lines"),
    "wi4_n_per_group": with_sql(D, f"""SELECT grp, doc_id, rank FROM (SELECT grp, doc_id,
 {_rn('npg', DK, 'doc_id', 'grp')} AS rank FROM pu_docs) WHERE rank <= 5"""),
    "wi5_fold_of": with_sql(LN, f"""SELECT {LKC}, CAST(({_rn('fold', LKT, LKC, 'y')} - 1) % 10 AS INTEGER) AS fold
FROM pu_lines"""),
}

SQL["sa12_holdout_n"] = with_sql(D + [f"""t AS (SELECT doc_id FROM (SELECT doc_id, {_rn('holdout', DK, 'doc_id', 'y')} AS rn
  FROM pu_docs) WHERE rn <= (SELECT count(*) // 10 FROM pu_docs WHERE y = 1))"""], """SELECT doc_id, 'test' AS role FROM t UNION ALL
SELECT doc_id, 'train' FROM pu_docs WHERE doc_id NOT IN (SELECT doc_id FROM t)""")
