"""SQL text for the independent DuckDB oracle (fixtures, hash, shared CTEs).

These strings are the *check*, written separately from the DataFrame code: the
same semantics spelled in plain SQL over the pre-registered test tables.
"""

from __future__ import annotations


def q(s: str) -> str:
    return "'" + str(s).replace("'", "''") + "'"


def ht(*parts: str) -> str:
    """Pipe-joined hash text; parts are SQL expressions (quote literals with q)."""
    return "concat_ws('|', " + ", ".join(parts) + ")"


def H(text_sql: str) -> str:
    """First 60 bits of md5 as BIGINT."""
    return f"CAST(('0x' || substr(md5({text_sql}), 1, 15)) AS BIGINT)"


def hk(seed, tag: str, key_sql: str, *extra: str) -> str:
    return H(ht(q(seed), q(tag), *extra, key_sql))


def vc(col: str) -> str:
    return f"CAST({col} AS VARCHAR)"


def keytext(cols: list[str], alias: str = "") -> str:
    pre = f"{alias}." if alias else ""
    if len(cols) == 1:
        return vc(pre + cols[0])
    return "concat_ws('|', " + ", ".join(vc(pre + c) for c in cols) + ")"


def r6(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6)"


DOCS_FEATURES = ["f1", "f2", "f3", "f4", "f5", "f6"]
LINES_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINES_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

PU_DOCS = """pu_docs0 AS (
  SELECT d.doc_id, d.lang AS grp, d.source,
         CAST(CASE WHEN l.quality = 1 THEN 1 ELSE 0 END AS INTEGER) AS y,
         CAST(l.quality AS INTEGER) AS y_true,
         CAST(d.n_chars AS DOUBLE) AS f1,
         CAST(length(d.text) - length(replace(d.text, ' ', '')) AS DOUBLE) AS f2,
         CAST(length(d.text) - length(translate(d.text, '0123456789', '')) AS DOUBLE) AS f3,
         CAST(length(d.text) - length(translate(d.text, '.,;:!?', '')) AS DOUBLE) AS f4,
         CAST(length(d.text) - length(replace(d.text, chr(10), '')) AS DOUBLE) AS f5,
         CAST(length(d.text) - length(translate(d.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS DOUBLE) AS f6
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
), pu_docs AS (
  SELECT *, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE f2 / nullif(f1, 0) END AS f7 FROM pu_docs0
)"""

PU_LINES = """pu_lines AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus AS grp,
         CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS INTEGER) AS y,
         CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS INTEGER) AS y_true,
         CAST(l_quantity AS DOUBLE) AS l_quantity, CAST(l_extendedprice AS DOUBLE) AS l_extendedprice,
         CAST(l_discount AS DOUBLE) AS l_discount, CAST(l_tax AS DOUBLE) AS l_tax
  FROM lineitem
)"""

def gnb_plain_ctes(src: str, key: list[str], features: list[str], prefix: str = "gp", label: str = "y",
                   axis: list[str] | None = None) -> str:
    """Plain (one-model) Gaussian NB: {prefix}_model with bag 0 fitted on all rows, weight 1."""
    P = prefix
    axis = axis or []
    ax = "".join(f"{a}, " for a in axis)
    return f"""{P}_rows AS (SELECT {ax}{', '.join(key)}, {label} AS y, {', '.join(features)} FROM {src}),
{P}_bagged AS (SELECT {ax}0 AS bag, y, 1 AS w, {', '.join(features)} FROM {P}_rows),
{gnb_model_ctes(P, features, P + '_rows', P + '_bagged', axis)}"""


def gnb_model_ctes(P: str, features: list[str], rows: str, bagged: str, axis: list[str] | None = None,
                   floor_by_bag: bool = False) -> str:
    """GNB model CTEs from a rows CTE (for the unweighted mean/variance floor) and a bagged CTE
    (axis…, bag, y, w, f…): defines {P}_glob2, {P}_st, {P}_cls, {P}_model."""
    axis = axis or []
    ax = "".join(f"{a}, " for a in axis)
    means = ", ".join(f"avg({f}) AS mean_{j}" for j, f in enumerate(features))
    vars_ = ", ".join(f"var_pop({f}) AS var_{j}" for j, f in enumerate(features))
    maxvar = "greatest(" + ", ".join(f"coalesce(var_{j}, 0.0)" for j in range(len(features))) + ")" \
        if len(features) > 1 else "coalesce(var_0, 0.0)"
    sums = []
    for j, f in enumerate(features):
        xs = f"({f} - mean_{j})"
        sums.append(f"sum(CASE WHEN {f} IS NOT NULL THEN w END) AS n_{j}")
        sums.append(f"sum(w * {xs}) AS s_{j}")
        sums.append(f"sum(w * {xs} * {xs}) AS q_{j}")
    stats = ", ".join(sums)
    mu = ", ".join(f"s_{j} / n_{j} + mean_{j} AS mu_{j}" for j in range(len(features)))
    va = ", ".join(f"greatest(q_{j} / n_{j} - (s_{j} / n_{j}) * (s_{j} / n_{j}), 0.0) + 1e-9 * maxvar AS v_{j}"
                   for j in range(len(features)))
    c0 = ", ".join(f"c0.mu_{j} AS mu0_{j}, c0.v_{j} AS v0_{j}" for j in range(len(features)))
    c1 = ", ".join(f"c1.mu_{j} AS mu1_{j}, c1.v_{j} AS v1_{j}" for j in range(len(features)))
    gjoin = f"{bagged} b JOIN {P}_glob2 g USING ({', '.join(axis)})" if axis else f"{bagged} b, {P}_glob2 g"
    if floor_by_bag:  # the largest variance within the bag's own rows (no axis)
        own = f"(SELECT bag, {maxvar} AS maxvar FROM (SELECT bag, {vars_} FROM {bagged} GROUP BY bag))"
        gjoin = f"{bagged} b JOIN {own} o USING (bag), (SELECT * EXCLUDE (maxvar) FROM {P}_glob2) g"
    on_ax = "".join(f" AND c0.{a} = c1.{a}" for a in axis)
    return f"""{P}_glob AS (SELECT {ax}{means}, {vars_} FROM {rows}{' GROUP BY ' + ', '.join(axis) if axis else ''}),
{P}_glob2 AS (SELECT *, {maxvar} AS maxvar FROM {P}_glob),
{P}_st AS (
  SELECT {''.join(f'b.{a}, ' for a in axis)}b.bag, b.y, sum(w) AS N, {stats}, any_value(maxvar) AS maxvar,
         {', '.join(f'any_value(mean_{j}) AS mean_{j}' for j in range(len(features)))}
  FROM {gjoin} GROUP BY {''.join(f'b.{a}, ' for a in axis)}b.bag, b.y
),
{P}_cls AS (SELECT {ax}bag, y, N, {mu}, {va} FROM {P}_st),
{P}_model AS (
  SELECT {''.join(f'c0.{a}, ' for a in axis)}c0.bag, c0.N AS n0, c1.N AS n1, {c0}, {c1}
  FROM {P}_cls c0 JOIN {P}_cls c1 ON c0.bag = c1.bag{on_ax} AND c0.y = 0 AND c1.y = 1
)"""


def gnb_fit_ctes(src: str, key: list[str], features: list[str], seed, T: int, m: int, prefix: str = "g",
                 label: str = "y", weight: str | None = None) -> str:
    """CTEs for exact PU bagging with the Gaussian NB learner (no axis).

    Defines {prefix}_upos (U with pos), {prefix}_bags (key…, bag, w),
    {prefix}_model (bag, n0, n1, mu0_j, v0_j, mu1_j, v1_j).
    """
    kt = keytext(key)
    kcols = ", ".join(key)
    fcols = ", ".join(features)
    P = prefix
    uw = f"{weight}" if weight else "1"
    return f"""{P}_rows AS (SELECT {kcols}, {label} AS y, {uw} AS uw, {fcols} FROM {src}),
{P}_u AS (SELECT * FROM {P}_rows WHERE y < 1),
{P}_p AS (SELECT * FROM {P}_rows WHERE y = 1),
{P}_upos AS (
  SELECT *, row_number() OVER (ORDER BY {hk(seed, 'pos', kt)}, {kcols}) - 1 AS pos FROM {P}_u
),
{_draws_sql(P, T, m)},
{P}_dpos AS (
  SELECT bag, {H(ht(q(seed), q('boot'), vc('bag'), vc('draw')))} % (SELECT count(*) FROM {P}_u) AS pos,
         count(*) AS w
  FROM {P}_draws GROUP BY 1, 2
),
{P}_bags AS (SELECT u.{', u.'.join(key)}, d.bag, d.w FROM {P}_dpos d JOIN {P}_upos u ON d.pos = u.pos),
{P}_bagged AS (
  SELECT b.bag, 1 AS y, p.uw AS w, {', '.join('p.' + f for f in features)}
  FROM {P}_p p, (SELECT CAST(i AS INTEGER) AS bag FROM range(0, {T}) t(i)) b
  UNION ALL
  SELECT bg.bag, 0 AS y, bg.w * u.uw AS w, {', '.join('u.' + f for f in features)}
  FROM {P}_bags bg JOIN {P}_u u ON {' AND '.join(f'bg.{k} = u.{k}' for k in key)}
),
{gnb_model_ctes(P, features, P + '_rows', P + '_bagged')}"""


def _draws_sql(P: str, T: int, m) -> str:
    """(bag, draw) pairs: m is an int, or SQL text for a data-dependent draw count."""
    if isinstance(m, str):
        return f"""{P}_draws AS (
  SELECT CAST(b.i AS INTEGER) AS bag, d.i AS draw FROM range(0, {T}) b(i), range(0, ({m})) d(i)
)"""
    return f"""{P}_draws AS (
  SELECT CAST(i // {m} AS INTEGER) AS bag, i % {m} AS draw FROM range(0, {T * m}) t(i)
)"""


def gnb_lj(features: list[str], c: int, row: str = "r", model: str = "m") -> str:
    """SQL expression: joint log-likelihood of class c (up to the shared constant)."""
    terms = " + ".join(
        f"coalesce(ln({model}.v{c}_{j}) + ({row}.{f} - {model}.mu{c}_{j}) * ({row}.{f} - {model}.mu{c}_{j}) / {model}.v{c}_{j}, 0.0)"
        for j, f in enumerate(features))
    return f"(ln({model}.n{c}) - 0.5 * ({terms}))"


def gnb_p1(features: list[str], row: str = "r", model: str = "m") -> str:
    """SQL expression: class-1 probability of one bag's model for one row."""
    def lj(c):
        terms = " + ".join(
            f"coalesce(ln({model}.v{c}_{j}) + ({row}.{f} - {model}.mu{c}_{j}) * ({row}.{f} - {model}.mu{c}_{j}) / {model}.v{c}_{j}, 0.0)"
            for j, f in enumerate(features))
        return f"(ln({model}.n{c}) - 0.5 * ({terms}))"
    return f"(1.0 / (1.0 + exp(least(greatest({lj(0)} - {lj(1)}, -700.0), 700.0))))"


def gnb_margin(features: list[str], row: str = "r", model: str = "m") -> str:
    def lj(c):
        terms = " + ".join(
            f"coalesce(ln({model}.v{c}_{j}) + ({row}.{f} - {model}.mu{c}_{j}) * ({row}.{f} - {model}.mu{c}_{j}) / {model}.v{c}_{j}, 0.0)"
            for j, f in enumerate(features))
        return f"(ln({model}.n{c}) - 0.5 * ({terms}))"
    return f"({lj(1)} - {lj(0)})"


def gnb_oob(src: str, key: list[str], features: list[str], seed, T: int, m: int, prefix: str = "g") -> str:
    """CTE {prefix}_oob(key…, y, oob_score, n_votes) for every training row."""
    P = prefix
    on = " AND ".join(f"b.{k} = r.{k}" for k in key)
    kc = ", ".join(f"r.{k}" for k in key)
    return gnb_fit_ctes(src, key, features, seed, T, m, P) + f""",
{P}_votes AS (
  SELECT {kc}, avg({gnb_p1(features)}) AS s, count(*) AS n
  FROM {P}_rows r, {P}_model m
  WHERE r.y < 1 AND NOT EXISTS (SELECT 1 FROM {P}_bags b WHERE {on} AND b.bag = m.bag)
  GROUP BY {kc}
),
{P}_oob AS (
  SELECT {kc}, r.y, v.s AS oob_score, CAST(coalesce(v.n, 0) AS INTEGER) AS n_votes
  FROM {P}_rows r LEFT JOIN {P}_votes v ON {' AND '.join(f'v.{k} = r.{k}' for k in key)}
)"""


def pu_axis_ctes(P: str, train: str, axis: list[str], key: list[str], features: list[str], seed, T: int,
                 m_sql: str) -> str:
    """Exact PU bagging with an axis (e.g. repeat) on a training CTE (axis…, key…, y, f…).

    ``m_sql`` is a SQL expression over {P}_cnt columns n_p, n_u giving the draws per bag.
    Defines {P}_bags (axis…, key…, bag, w) and {P}_model (axis…, bag, …).
    """
    ax = ", ".join(axis)
    kcols = ", ".join(key)
    kt = keytext(key)
    on_ax = " AND ".join(f"a.{c} = b.{c}" for c in axis)
    axis_text = [vc(f"c.{a}") for a in axis]
    return f"""{P}_rows AS (SELECT {ax}, {kcols}, y, {', '.join(features)} FROM {train}),
{P}_u AS (SELECT * FROM {P}_rows WHERE y < 1),
{P}_p AS (SELECT * FROM {P}_rows WHERE y = 1),
{P}_cnt AS (SELECT {ax}, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS n_p, sum(CASE WHEN y < 1 THEN 1 ELSE 0 END) AS n_u
  FROM {P}_rows GROUP BY {ax}),
{P}_m AS (SELECT {ax}, n_u, CAST({m_sql} AS BIGINT) AS m FROM {P}_cnt),
{P}_upos AS (SELECT *, row_number() OVER (PARTITION BY {ax} ORDER BY {hk(seed, 'pos', kt)}, {kcols}) - 1 AS pos
  FROM {P}_u),
{P}_dpos AS (
  SELECT {', '.join('c.' + a for a in axis)}, CAST(b.i AS INTEGER) AS bag,
    {H(ht(q(seed), q('boot'), *axis_text, vc('CAST(b.i AS INTEGER)'), vc('d.i')))} % c.n_u AS pos, count(*) AS w
  FROM {P}_m c, range(0, {T}) b(i), range(0, (SELECT max(m) FROM {P}_m)) d(i) WHERE d.i < c.m
  GROUP BY ALL
),
{P}_bags AS (SELECT {', '.join('u.' + a for a in axis)}, {', '.join('u.' + k for k in key)}, d.bag, d.w
  FROM {P}_dpos d JOIN {P}_upos u ON d.pos = u.pos AND {' AND '.join(f'd.{a} = u.{a}' for a in axis)}),
{P}_bagged AS (
  SELECT {', '.join('p.' + a for a in axis)}, CAST(b.i AS INTEGER) AS bag, 1 AS y, 1 AS w, {', '.join('p.' + f for f in features)}
  FROM {P}_p p, range(0, {T}) b(i)
  UNION ALL
  SELECT {', '.join('u.' + a for a in axis)}, bg.bag, 0 AS y, bg.w, {', '.join('u.' + f for f in features)}
  FROM {P}_bags bg JOIN {P}_u u ON {' AND '.join(f'bg.{k} = u.{k}' for k in key + axis)}
),
{gnb_model_ctes(P, features, P + '_rows', P + '_bagged', axis)}"""


def auc_ctes(name: str, src: str, by: list[str], y: str = "y_true", score: str = "p1") -> str:
    """CTE {name}(by…, auc): trapezoid ROC area from score groups and descending running sums."""
    b = ", ".join(by)
    score = f"round({score}, 12)"  # scores that agree to 12 decimals are ties
    return f"""{name}_c AS (SELECT {b}, {score} AS score, sum(CASE WHEN {y} = 1 THEN 1 ELSE 0 END) AS pos,
  sum(CASE WHEN {y} = 1 THEN 0 ELSE 1 END) AS neg FROM {src} WHERE {score} IS NOT NULL GROUP BY {b}, {score}),
{name}_k AS (SELECT *, sum(pos) OVER w AS tp, sum(pos) OVER (PARTITION BY {b}) AS P, sum(neg) OVER (PARTITION BY {b}) AS N
  FROM {name}_c WINDOW w AS (PARTITION BY {b} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{name} AS (SELECT {b}, sum(neg * (2 * tp - pos)) / nullif(2.0 * any_value(P) * any_value(N), 0) AS auc
  FROM {name}_k GROUP BY {b})"""


def stratified_n(src: str, name: str, frac: float, label: str = "y") -> str:
    """CTE {name}({label}, n_test): round(frac * rows) test rows by class, largest remainder."""
    return f"""{name}_c AS (SELECT {label}, count(*) AS n FROM {src} GROUP BY {label}),
{name}_t AS (SELECT sum(n) AS total, CAST(floor(sum(n) * {frac} + 0.5) AS BIGINT) AS want FROM {name}_c),
{name}_q AS (SELECT {label}, n * want // total AS whole, n * want % total AS rest, want FROM {name}_c, {name}_t),
{name} AS (SELECT {label}, CAST(whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, {label}) <= want - sum(whole) OVER ()
  THEN 1 ELSE 0 END AS BIGINT) AS n_test FROM {name}_q)"""
