"""Feature contributions (FC1-FC4).

FC1 (additive learners): the Gaussian NB log-odds is a sum of per-feature terms
g_j(x_j) plus a constant, so the interventional Shapley value of feature j is
exactly phi_j(x) = g_j(x_j) - E_bg[g_j]. For a bagged ensemble the explained
output is the mean margin over bags, still additive. One aggregate gives the d
background means; contributions are a narrow projection of every row.

FC1 on trees (one tree, forests, boosted trees, and bags of them): interventional Shapley values by leaves. For an
explained row x and a background row z a leaf counts for the features that only x passes on its path (a of them)
and against those that only z passes (b of them), with the weights (a-1)! b! / (a+b)! and a! (b-1)! / (a+b)!; a
leaf whose path has a feature that neither passes is never reached. The cost grows with the leaves, not with 2^d.

FC2: Shapley interaction values from the coalition table, phi_ij = phi_ji = sum over S without i and j of
|S|! (d-|S|-2)! / (2 (d-1)!) (v(S+ij) - v(S+i) - v(S+j) + v(S)), and phi_ii = phi_i - sum of the others, so
that a row of them adds up to phi_i. For an additive output they are zero off the diagonal.

FC3 (any model, e.g. the PU ensemble's probability): v(S) = mean over a bounded background sample of f(x_S, z_~S).
Up to 12 features all 2^d coalitions give exact Shapley values. Beyond, coalitions are drawn by the Shapley
kernel's size weights, each with its complement, and phi is the least-squares fit under the constraint that it
adds up to f(x) - v(none); the coalitions are the same for all rows, so the fit is one matrix. The hybrid rows
of a coalition exist inside a task only, a few explained rows at a time. With an axis every value has a
background of its own rows.

FC4: per-feature summary (mean |phi|, spread) and the ranking.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubag.functions.hashing import as_list
from pubag.operators.learners.bag_sums import row_uniform
from pubag.operators.sampling import feature_bag_hash, first_n
from pubag.operators.scoring import SLICE_BYTES, axis_text, scored

# The largest feature count for exact coalitions, drawn pairs of coalitions beyond, the default
# background size, and hybrid rows that a task holds at once.
MAX_COALITION_FEATURES = 12
PAIRS = 1024
BACKGROUND_ROWS = 100
HYBRIDS = 1 << 16


def additive_terms(model, df: DataFrame) -> DataFrame:
    """Per row the mean over bags of each feature's log-odds term: columns g0..g{d-1}."""
    d = scored(model, model._with_axis(df), "terms")
    n = F.col("_acc.n").cast("double")
    return d.withColumns({f"g{j}": F.col("_acc.t")[j] / n for j in range(len(model.features))}).drop("_acc")


def contributions(model, df: DataFrame, background: DataFrame | None = None) -> DataFrame:
    """FC1: long (key…, feature, phi) for an additive (GNB) model or ensemble."""
    if not hasattr(model.learner, "np_terms"):
        raise ValueError("closed-form contributions need an additive learner; use coalition_contributions")
    background = df if background is None else background
    feats = model.features
    bg = additive_terms(model, background.select(*model.user_axis, *feats))
    # d means per axis value, joined to the rows of that axis value
    means = bg.groupBy(*[F.col(a).alias(f"_m_{a}") for a in model.user_axis]).agg(
        *[F.avg(f"g{j}").alias(f"e{j}") for j in range(len(feats))])
    g = additive_terms(model, df)
    if model.user_axis:
        on = F.lit(True)
        for a in model.user_axis:
            on = on & F.col(a).eqNullSafe(F.col(f"_m_{a}"))
        g = g.join(means, on)
        e = [F.col(f"e{j}") for j in range(len(feats))]
    else:
        one = means.first()  # d numbers
        e = [F.lit(one[f"e{j}"]) for j in range(len(feats))]
    arr = F.array(*[F.struct(F.lit(f).alias("feature"), (F.col(f"g{j}") - e[j]).alias("phi")) for j, f in enumerate(feats)])
    return g.select(*model.user_axis, *model.key, F.explode(arr).alias("_c")).select(
        *model.user_axis, *model.key, "_c.feature", "_c.phi")


def interactions(phi: DataFrame, key, features: list[str]) -> DataFrame:
    """FC2 for additive outputs: (key…, feature_i, feature_j, value) with phi on the diagonal, 0 elsewhere."""
    key = as_list(key)
    fa = F.array(*[F.lit(f) for f in features])
    return phi.withColumn("feature_j", F.explode(fa)).select(
        *key, F.col("feature").alias("feature_i"), "feature_j",
        F.when(F.col("feature") == F.col("feature_j"), F.col("phi")).otherwise(F.lit(0.0)).alias("value"))


# --- values of coalitions ---------------------------------------------------------------------


def _backgrounds(model, background: DataFrame, n: int, seed) -> dict[str, np.ndarray]:
    """Per axis value the first ``n`` of its background rows by hash (all, if fewer): at most ``n`` rows each."""
    ax = list(model.user_axis)
    picked = first_n(background, n, model.key, seed, "shap-bg", parts=ax, at_most=True)
    rows = picked.select(axis_text(ax).alias("_axt") if ax else F.lit("0").alias("_axt"), *model.features).collect()
    out: dict[str, list] = {}
    for r in rows:
        out.setdefault(r["_axt"], []).append([np.nan if r[f] is None else float(r[f]) for f in model.features])
    return {a: np.array(sorted(v)) for a, v in out.items()}


def _model_slices(model):
    """(axis text -> models) of the slices of bags, each of at most ``SLICE_BYTES``."""
    per_bag = max(1, len(model.counts)) * model.learner.model_bytes(len(model.features))
    step, last = max(1, SLICE_BYTES // per_bag), model.first_bag + model.n_estimators
    name = axis_text(model.user_axis) if model.user_axis else F.lit("0")
    for lo in range(model.first_bag, last, step):
        rows = model.models.filter((F.col("bag") >= lo) & (F.col("bag") < lo + step)).withColumn("_axt", name).collect()
        packed: dict[str, list] = {}
        for r in sorted(rows, key=lambda r: r["bag"]):
            packed.setdefault(r["_axt"], []).append(model.learner.unpack(r))
        yield packed


def _per_row(model, explain: DataFrame, backgrounds: dict, of, size: int) -> DataFrame:
    """``explain``'s ids and ``_v``: the mean over all bags of ``of(learner, models, rows, background)`` (rows x ``size``)."""
    spark, feats, ids = explain.sparkSession, list(model.features), [*model.user_axis, *model.key]
    learner, parts = model.learner, []
    name = axis_text(model.user_axis) if model.user_axis else F.lit("0")
    out = explain

    def slice_udf(sent):
        def values(*columns):
            x = np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns[:-1]])
            names = np.asarray(columns[-1].to_pylist(), dtype=object)
            found, zs = sent.value
            v = np.zeros((len(x), size))
            for axis in set(names.tolist()):
                mine = np.flatnonzero(names == axis)
                if axis in found and axis in zs:
                    v[mine] = of(learner, found[axis], x[mine], zs[axis])
            return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * size), pa.array(v.ravel()))

        # the annotation of a variable number of columns
        values.__annotations__ = {"columns": pa.Array, "return": pa.Array}
        return F.arrow_udf(values, "array<double>")

    for k, packed in enumerate(_model_slices(model)):
        parts.append(f"_v{k}")
        udf = slice_udf(spark.sparkContext.broadcast((packed, backgrounds)))
        out = out.withColumn(parts[-1], udf(*[F.col(c).cast("double") for c in feats], name))
    total = F.col(parts[0])
    for p in parts[1:]:
        total = F.zip_with(total, F.col(p), lambda a, b: a + b)
    n = float(model.n_estimators)
    return out.select(*ids, F.transform(total, lambda v: v / n).alias("_v"))


def _coalition_sums(masks: np.ndarray):
    """Per row and coalition the sum over the models of the mean over the background."""

    def of(learner, models, x, z):
        out = np.zeros((len(x), len(masks)))
        step = max(1, HYBRIDS // len(z))
        for at in range(0, len(x), step):
            part = x[at:at + step]
            for c, mask in enumerate(masks):
                rows = np.where(mask, part[:, None, :], z[None]).reshape(-1, x.shape[1])
                seen = learner.np_map(models[0], rows) if hasattr(learner, "np_map") else rows
                total = sum(learner.np_proba(m, seen) for m in models)
                out[at:at + step, c] = total.reshape(len(part), len(z)).mean(axis=1)
        return out

    return of


def _all_masks(d: int) -> np.ndarray:
    """(2^d, d): coalition S has feature j if bit j of S is set."""
    return (np.arange(1 << d)[:, None] >> np.arange(d)) & 1 == 1


def shapley_matrix(d: int) -> np.ndarray:
    """(d, 2^d): phi = matrix @ v."""
    masks = _all_masks(d)
    size, out = masks.sum(axis=1), np.zeros((d, 1 << d))
    w = [math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) for k in range(d)]
    for j in range(d):
        without = np.flatnonzero(~masks[:, j])
        np.add.at(out[j], without | 1 << j, [w[k] for k in size[without]])
        np.add.at(out[j], without, [-w[k] for k in size[without]])
    return out


def interaction_matrix(d: int) -> np.ndarray:
    """(d * d, 2^d): the interaction values, row by row, = matrix @ v."""
    masks = _all_masks(d)
    size, out = masks.sum(axis=1), np.zeros((d, d, 1 << d))
    for i in range(d):
        for j in range(i + 1, d):
            w = [math.factorial(k) * math.factorial(d - k - 2) / (2 * math.factorial(d - 1)) for k in range(d - 1)]
            s = np.flatnonzero(~masks[:, i] & ~masks[:, j])
            own = np.array([w[k] for k in size[s]])
            for at, sign in ((s | 1 << i | 1 << j, 1), (s | 1 << i, -1), (s | 1 << j, -1), (s, 1)):
                np.add.at(out[i, j], at, sign * own)
            out[j, i] = out[i, j]
    phi = shapley_matrix(d)
    for i in range(d):
        out[i, i] = phi[i] - out[i].sum(axis=0)
    return out.reshape(d * d, 1 << d)


def sampled_coalitions(d: int, pairs: int, seed) -> tuple[np.ndarray, np.ndarray]:
    """(masks, matrix): drawn coalitions with their complements, then none and all; phi = matrix @ v."""
    sizes = np.arange(1, d)
    share = np.cumsum(1 / (sizes * (d - sizes)))
    masks = []
    for p in range(pairs):
        k = int(sizes[np.searchsorted(share / share[-1], row_uniform(np.array(feature_bag_hash(seed, "size", p) % (1 << 31)), 1, 0))])
        order = sorted(range(d), key=lambda j: feature_bag_hash(seed, "coalition", p, j))
        mask = np.zeros(d, dtype=bool)
        mask[order[:k]] = True
        masks += [mask, ~mask]
    z = np.array(masks, dtype=float)
    # least squares of v(S) - v(none) on z under sum(phi) = v(all) - v(none)
    a = z.T @ z
    inverse = np.linalg.pinv(a)
    m = len(masks)
    target = np.hstack([np.eye(m), -np.ones((m, 1)), np.zeros((m, 1))])
    gap = np.zeros((1, m + 2))
    gap[0, m], gap[0, m + 1] = -1, 1
    free, ones = inverse @ z.T @ target, np.ones((d, 1))
    fixed = inverse @ ones / (ones.T @ inverse @ ones)
    return np.vstack([z > 0, np.zeros((1, d), bool), np.ones((1, d), bool)]), free + fixed @ (gap - ones.T @ free)


def _combined(v: DataFrame, ids: list[str], matrix: np.ndarray, extra: list[int]) -> DataFrame:
    """``ids``, ``_phi`` = matrix @ _v and the values of the coalitions ``extra``."""

    def combine(values: pa.Array) -> pa.Array:
        out = values.flatten().to_numpy().reshape(len(values), matrix.shape[1]) @ matrix.T
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * len(matrix)), pa.array(out.ravel()))

    return v.select(*ids, F.arrow_udf(combine, "array<double>")("_v").alias("_phi"), *[F.col("_v")[k].alias(f"_x{i}") for i, k in enumerate(extra)])


def coalition_contributions(model, explain: DataFrame, background: DataFrame, n_background: int = BACKGROUND_ROWS,
                            seed=0, pairs: int = PAIRS) -> DataFrame:
    """FC3: interventional Shapley values of the ensemble probability (predict_proba): (ids…, feature, phi, fx, ef).

    Exact up to ``MAX_COALITION_FEATURES`` features, from ``pairs`` drawn pairs of coalitions beyond. The
    background is a hash sample of ``n_background`` rows (SA1; per axis value); the explained rows stay distributed.
    """
    ids, feats, d = [*model.user_axis, *model.key], model.features, len(model.features)
    if d <= MAX_COALITION_FEATURES:
        masks, matrix, ends = _all_masks(d), shapley_matrix(d), [(1 << d) - 1, 0]
    else:
        masks, matrix = sampled_coalitions(d, pairs, seed)
        ends = [len(masks) - 1, len(masks) - 2]
    v = _per_row(model, explain.select(*ids, *feats), _backgrounds(model, background, n_background, seed), _coalition_sums(masks), len(masks))
    out = _combined(v, ids, matrix, ends).select(*ids, F.posexplode("_phi").alias("_j", "phi"), F.col("_x0").alias("fx"), F.col("_x1").alias("ef"))
    return out.select(*ids, F.element_at(F.array(*[F.lit(f) for f in feats]), F.col("_j") + 1).alias("feature"), "phi", "fx", "ef")


def interaction_values(model, explain: DataFrame, background: DataFrame, n_background: int = BACKGROUND_ROWS, seed=0) -> DataFrame:
    """FC2: (ids…, feature_i, feature_j, value) of the ensemble probability, from all 2^d coalitions."""
    ids, feats, d = [*model.user_axis, *model.key], model.features, len(model.features)
    if d > MAX_COALITION_FEATURES:
        raise ValueError(f"the interactions of {d} features need 2^{d} coalitions; choose at most {MAX_COALITION_FEATURES}")
    v = _per_row(model, explain.select(*ids, *feats), _backgrounds(model, background, n_background, seed), _coalition_sums(_all_masks(d)), 1 << d)
    names = F.array(*[F.lit(f) for f in feats])
    out = _combined(v, ids, interaction_matrix(d), []).select(*ids, F.posexplode("_phi").alias("_k", "value"))
    return out.select(*ids, F.element_at(names, F.floor(F.col("_k") / d).cast("int") + 1).alias("feature_i"),
                      F.element_at(names, F.col("_k") % d + 1).alias("feature_j"), "value")


# --- trees ------------------------------------------------------------------------------------


def leaf_paths(tree: dict, d: int) -> list[tuple[float, dict[int, tuple[int, int]]]]:
    """(value, {feature: (above, at most)}) of every leaf: the bins that its path lets through."""
    out, todo = [], [(1, {})]
    while todo:
        node, path = todo.pop()
        f = int(tree["feat"][node])
        if f < 0:
            out.append((float(tree["value"][node]), path))
            continue
        above, most = path.get(f, (-2, 1 << 30))
        cut = int(tree["cut"][node])
        todo += [(2 * node, path | {f: (above, min(most, cut))}), (2 * node + 1, path | {f: (max(above, cut), most)})]
    return out


def tree_phi(paths: list, x: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Interventional Shapley values (rows x d) of one tree on binned rows ``x`` against the background ``z``."""
    phi = np.zeros(x.shape)
    for value, path in paths:
        if not path or not value:
            continue
        feats = list(path)
        lo, hi = np.array([path[f] for f in feats]).T
        own, other = ((v[:, feats] > lo) & (v[:, feats] <= hi) for v in (x, z))
        only, against = own[:, None] & ~other[None], ~own[:, None] & other[None]
        live = (own[:, None] | other[None]).all(axis=2)
        a, b = only.sum(axis=2), against.sum(axis=2)
        k = len(feats) + 1
        fact = [math.factorial(n) for n in range(2 * k)]
        gain = np.array([[fact[p - 1] * fact[q] / fact[p + q] if p else 0.0 for q in range(k)] for p in range(k)])
        loss = np.array([[fact[p] * fact[q - 1] / fact[p + q] if q else 0.0 for q in range(k)] for p in range(k)])
        plus, minus = np.where(live, gain[a, b], 0.0) * value, np.where(live, loss[a, b], 0.0) * value
        for n, f in enumerate(feats):
            phi[:, f] += (np.where(only[:, :, n], plus, 0.0) - np.where(against[:, :, n], minus, 0.0)).mean(axis=1)
    return phi


def tree_contributions(model, explain: DataFrame, background: DataFrame, n_background: int = BACKGROUND_ROWS, seed=0) -> DataFrame:
    """FC1 for trees: long (ids…, feature, phi) of the mean over bags of the trees' output (the probability; for
    boosted trees the margin), exact for any number of features."""
    ids, feats, d = [*model.user_axis, *model.key], model.features, len(model.features)
    if not hasattr(model.learner, "np_trees"):
        raise ValueError("leaf paths need a learner made of trees; use coalition_contributions")

    def of(learner, models, x, z):
        out, zb = np.zeros(x.shape), learner.np_map(models[0], z).astype(np.int64)
        step = max(1, HYBRIDS // len(z))
        for m in models:
            trees = [(scale, leaf_paths(t, d)) for scale, t in learner.np_trees(m)]
            for at in range(0, len(x), step):
                xb = learner.np_map(m, x[at:at + step]).astype(np.int64)
                out[at:at + step] += sum(scale * tree_phi(paths, xb, zb) for scale, paths in trees)
        return out

    v = _per_row(model, explain.select(*ids, *feats), _backgrounds(model, background, n_background, seed), of, d)
    names = F.array(*[F.lit(f) for f in feats])
    return v.select(*ids, F.posexplode("_v").alias("_j", "phi")).select(*ids, F.element_at(names, F.col("_j") + 1).alias("feature"), "phi")


def contribution_summary(phi: DataFrame) -> DataFrame:
    """FC4 / SO5: per feature mean |phi|, mean phi, quartiles of phi and the rank by mean |phi|."""
    from pyspark.sql import Window

    s = phi.groupBy("feature").agg(
        F.avg(F.abs("phi")).alias("mean_abs_phi"), F.avg("phi").alias("mean_phi"),
        F.percentile_approx("phi", [0.25, 0.5, 0.75], 10000).alias("quartiles"))
    return s.withColumn("rank", F.row_number().over(Window.orderBy(F.col("mean_abs_phi").desc(), "feature")))
