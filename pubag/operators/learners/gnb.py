"""BL1: Gaussian naive Bayes trained for every bag in one aggregate.

Fit (``fit_rows``): one pass over the rows gives per (axis, bag, class) the weighted count and per feature
the weighted sums of x and x^2 as whole numbers (``bag_sums.Exact``, squares without rounding), so that nothing
cancels and the model is the same to the last bit however the rows are partitioned.
``fit`` does it for more models than a task can hold (one per chunk of the background): per (axis, bag, class)
sums of x and x^2 in one aggregate (x shifted by the axis-wide mean), rows of every bag (``shared``: the
positives) aggregated once per axis value and added to each bag's sums.
Variances get the floor ``var_smoothing * max feature variance`` over the features
that the bag uses, taken unweighted over all training rows of the axis value, or
over the bag's own rows (``floor_by_bag``, weights 1).
Prior = class weight share. A null feature is left out of the likelihood.

Score: p1 = 1 / (1 + exp(l0 - l1)), l_c = ln N_c - 1/2 sum_j [ln v_cj + (x_j - mu_cj)^2 / v_cj]
over the features of the bag (multiplicity counts, for drawn-with-replacement
feature bags), evaluated with NumPy over Arrow batches (``operators/scoring.py``).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubag.operators.learners import bag_sums as B
from pubag.operators.learners.bag_sums import Exact

# The exp() argument clamp and the default variance floor factor.
EXP_CLAMP = 700.0
ABSENT = -1.0e300
VAR_SMOOTHING = 1e-9


def _limbs(rows: B.Rows, w: np.ndarray, w_top: int, tops: list[int]) -> np.ndarray:
    """Per row the limbs of w and, per feature, of w (where the feature is known), w x and w x^2."""
    x, known = rows.x, ~np.isnan(rows.x)
    top = np.array(tops, dtype=np.int64) + w_top
    plain = bool((w == 1).all())
    first = x if plain else x * w[:, None]
    second, lack = B.squares(x) if plain else (x * first, np.zeros_like(x))
    top2 = top + np.array(tops, dtype=np.int64)
    cols = [Exact.cut(w, np.int64(w_top))[:, None]]
    for j in range(x.shape[1]):
        q = Exact.cut(second[:, j], top2[j]) + Exact.cut(lack[:, j], top2[j])
        cols += [Exact.cut(np.where(known[:, j], w, 0.0), np.int64(w_top))[:, None], Exact.cut(first[:, j], top[j])[:, None], q[:, None]]
    return np.concatenate(cols, axis=1).reshape(len(w), -1)


def _add_moments(acc: np.ndarray, rows: B.Rows, tops: tuple) -> None:
    """Adds a batch to the sums of each bag and class; the last bag of ``acc`` is all rows, each once and unweighted."""
    w_top, x_tops = tops
    half, bags = acc.shape[1] // 2, len(acc) - 1
    ones = _limbs(rows, np.ones(len(rows.y)), 1, x_tops)
    limbs = ones if w_top == 1 and (rows.w0 == 1).all() else _limbs(rows, rows.w0, w_top, x_tops)
    few = 20 * ((rows.bag < bags).sum() + len(rows.every) * bags) < len(rows.y) * len(acc)
    if few:
        row, bag, times = rows.pairs(len(acc))
        real = bag < bags
    else:
        times = rows.dense(len(acc))
        times[:, -1] = 0
    for cls in (0, 1):
        mine, own = rows.y == cls, slice(cls * half, (cls + 1) * half)
        # limbs have 22 bits and a batch at most 2^19 pairs, so the products are exact in doubles
        if few:
            pair = np.flatnonzero(real & mine[row])
            np.add.at(acc[:, own], bag[pair], (times[pair, None] * limbs[row[pair]]).astype(np.int64))
        else:
            acc[:, own] += (times[mine].T @ limbs[mine]).astype(np.int64)
        acc[-1, own] += ones[mine].sum(axis=0).astype(np.int64)


def _moments(sums, x_top: int) -> tuple[float | None, float | None]:
    """(mean, variance) from the whole numbers (count, sum, sum of squares); nothing without a row."""
    n, s, q = (int(v) for v in sums)
    if n <= 0:
        return None, None
    # all in units of 2^(w_top - LIMBS * BITS), times 2^x_top for s and 2^(2 x_top) for q
    return math.ldexp(s / n, x_top), math.ldexp(max(0, q * n - s * s) / (n * n), 2 * x_top)


class GaussianNB:
    name = "gnb"
    has_proba = True
    takes_weight = True

    def __init__(self, var_smoothing: float = VAR_SMOOTHING):
        self.var_smoothing = var_smoothing

    additive = True

    @staticmethod
    def _sums(features: list[str], label: str):
        """Conditional sums of both classes: no self-join."""
        aggs = []
        for cls in (0, 1):
            w = F.when(F.col(label) == cls, F.col("w").cast("double"))
            aggs.append(F.sum(w).alias(f"N{cls}"))
            for j, c in enumerate(features):
                xs = F.col(c) - F.col(f"_mean{j}")
                aggs += [
                    F.sum(F.when(F.col(c).isNotNull(), w)).alias(f"n{cls}_{j}"),
                    F.sum(w * xs).alias(f"s{cls}_{j}"),
                    F.sum(w * xs * xs).alias(f"q{cls}_{j}"),
                ]
        return aggs

    def fit(self, bagged: DataFrame, rows: DataFrame, features: list[str], axis: list[str],
            label: str = "y", fbags: list | None = None, first_bag: int = 0, shared: DataFrame | None = None,
            bags=None, floor_by_bag: bool = False) -> DataFrame:
        """bagged(axis…, bag, y, w, f…) -> one row per (axis, bag) with model columns.

        ``shared`` (axis…, y, w, f…) are rows of every bag in the range ``bags``.
        """
        d = len(features)
        g = rows.groupBy(*axis).agg(
            *[F.avg(c).alias(f"_mean{j}") for j, c in enumerate(features)],
            *[F.coalesce(F.var_pop(c), F.lit(0.0)).alias(f"_var{j}") for j, c in enumerate(features)],
        )
        names = [n for cls in (0, 1) for n in (f"N{cls}", *[f"{k}{cls}_{j}" for j in range(d) for k in "nsq"])]
        sums = self._sums(features, label)
        st = bagged.join(g, axis).groupBy(*axis, "bag").agg(*sums)
        if shared is not None:
            always = shared.join(g, axis).groupBy(*axis).agg(*sums).select(*axis, *[F.col(n).alias(f"_p{n}") for n in names])
            frame = g.select(*axis).withColumn("bag", F.explode(F.sequence(F.lit(bags.start), F.lit(bags.stop - 1))))
            # a sum is null only where neither side has a row
            both = frame.join(st, [*axis, "bag"], "left").join(always, axis, "left")
            total = lambda n: F.when(F.col(n).isNotNull() | F.col(f"_p{n}").isNotNull(),
                                     F.coalesce(n, F.lit(0.0)) + F.coalesce(f"_p{n}", F.lit(0.0))).alias(n)
            st = both.select(*axis, "bag", *[total(n) for n in names])
        st = st.join(g, axis)
        if floor_by_bag:
            def part(k, j):
                return F.coalesce(f"{k}0_{j}", F.lit(0.0)) + F.coalesce(f"{k}1_{j}", F.lit(0.0))

            spread = [F.coalesce(F.try_divide(part("q", j), part("n", j)) - F.pow(F.try_divide(part("s", j), part("n", j)), 2), F.lit(0.0))
                      for j in range(d)]
        else:
            spread = [F.col(f"_var{j}") for j in range(d)]
        if fbags is not None and any(len(set(fb)) < d for fb in fbags):
            used = F.element_at(F.array(*[F.array(*[F.lit(j in fb) for j in range(d)]) for fb in fbags]), F.col("bag") - F.lit(first_bag) + 1)
            spread = [F.when(used[j], v).otherwise(F.lit(0.0)) for j, v in enumerate(spread)]
        eps = F.lit(self.var_smoothing) * (F.greatest(*spread) if d > 1 else spread[0])
        out = []
        for cls in (0, 1):
            mu = [F.try_divide(F.col(f"s{cls}_{j}"), F.col(f"n{cls}_{j}")) for j in range(d)]
            var = [F.greatest(F.try_divide(F.col(f"q{cls}_{j}"), F.col(f"n{cls}_{j}")) - mu[j] * mu[j], F.lit(0.0)) + eps
                   for j in range(d)]
            out += [F.col(f"N{cls}").alias(f"n{cls}"),
                    F.array(*[mu[j] + F.col(f"_mean{j}") for j in range(d)]).alias(f"mu{cls}"),
                    F.array(*var).alias(f"v{cls}")]
        return st.select(*axis, "bag", *out)

    # -- fit over rows that are stored once -----------------------------------------

    MODEL = "n0 double, mu0 array<double>, v0 array<double>, n1 double, mu1 array<double>, v1 array<double>"

    def fit_rows(self, rows: DataFrame, axes: list[str], d: int, first: int, bags: int, fbags: list | None = None, complement: bool = False):
        """Yields (axis index, bag, model columns…) of every axis value and bag; ``rows`` as ``bag_sums.training_rows`` gives them.

        ``complement``: every row (of weight 1) is in one bag, and a bag's model is that of all rows outside it:
        the sums of all rows less those of the bag, exactly, and the variance floor with them."""
        most = B.loose(rows, d).groupBy("_axt").agg(F.max("_w0").alias("w"), *[F.max(F.when(F.abs(F.col("_x")[j]) < float("inf"), F.abs(F.col("_x")[j]))).alias(f"x{j}") for j in range(d)])
        top = {r["_axt"]: (B.exponent(r["w"]), [B.exponent(r[f"x{j}"]) for j in range(d)]) for r in most.collect()}  # d numbers per axis value
        tops = [top.get(a, (1, [0] * d)) for a in axes]
        size = 2 * Exact.LIMBS * (1 + 3 * d)
        for a0, a1, b0, b1 in B.slices(len(axes), first, bags, 8 * size):
            got = B.summed(rows, axes[a0:a1], b0, b1 + 1, d, size, _add_moments, tops[a0:a1], np.int64)
            for a in range(a0, a1):
                w, xs = tops[a]
                sums = Exact.whole(got[a - a0].reshape(b1 - b0 + 1, 2, 1 + 3 * d, Exact.LIMBS))
                every = sums[-1].sum(axis=0)  # the last one: all rows once, unweighted
                floor = [_moments(every[1 + 3 * j:4 + 3 * j], xs[j])[1] or 0.0 for j in range(d)]
                for b in range(b0, b1):
                    used = set(fbags[b - first]) if fbags is not None else set(range(d))
                    if complement:
                        sums[b - b0] = sums[-1] - sums[b - b0]
                        outside = sums[b - b0].sum(axis=0)
                        floor = [_moments(outside[1 + 3 * j:4 + 3 * j], xs[j])[1] or 0.0 for j in range(d)]
                    eps = self.var_smoothing * max(v if j in used else 0.0 for j, v in enumerate(floor))
                    row = []
                    for cls in (0, 1):
                        own = sums[b - b0, cls]
                        known = [_moments(own[1 + 3 * j:4 + 3 * j], xs[j]) for j in range(d)]
                        row += [math.ldexp(own[0], w - Exact.LIMBS * Exact.BITS), [m for m, _ in known], [None if v is None else v + eps for _, v in known]]
                    yield (a, b, *row)

    @staticmethod
    def model_columns() -> list[str]:
        return ["n0", "mu0", "v0", "n1", "mu1", "v1"]

    @staticmethod
    def model_bytes(d: int) -> int:
        return 8 * (5 * d + 8)

    # -- scoring of one bag's model over the rows of an array --------------------

    def unpack(self, row) -> dict:
        """A row of the model table as arrays; a missing value is NaN."""
        arr = lambda v: np.array([np.nan if x is None else x for x in v], dtype=float)
        return {"mult": arr(row["fmult"])} | {f"n{c}": float(row[f"n{c}"] or 0.0) for c in (0, 1)} | {
            f"{k}{c}": arr(row[f"{k}{c}"]) for k in ("mu", "v") for c in (0, 1)}

    @staticmethod
    def np_stack(models: list[list[dict | None]]) -> dict:
        """Models by axis value and bag (none: not there) as arrays over both; ``np_pick`` gives rows their models."""
        some = next(m for own in models for m in own if m is not None)
        none = {k: np.full(np.shape(v), np.nan) for k, v in some.items()}
        out = {k: np.array([[(m or none)[k] for m in own] for own in models]) for k in some}
        for c in (0, 1):
            with np.errstate(divide="ignore", invalid="ignore"):
                out[f"v{c}"] = np.where(out[f"v{c}"] > 0, out[f"v{c}"], np.nan)
                out[f"lv{c}"] = np.log(out[f"v{c}"])
                out[f"ln{c}"] = np.log(np.where(out[f"n{c}"] > 0, out[f"n{c}"], np.nan))
        return out

    @staticmethod
    def np_pick(stack: dict, at, bag: int) -> dict:
        """The models of ``bag`` of the axis values ``at``: one for all rows, or one of each row's own."""
        return {k: v[at, bag] for k, v in stack.items()}

    @staticmethod
    def _distance(m: dict, x: np.ndarray, cls: int) -> np.ndarray:
        """ln v + (x - mu)^2 / v per feature; 0 where the feature or its variance is missing."""
        v = np.where(m[f"v{cls}"] > 0, m[f"v{cls}"], np.nan) if f"lv{cls}" not in m else m[f"v{cls}"]
        t = (np.log(v) if f"lv{cls}" not in m else m[f"lv{cls}"]) + (x - m[f"mu{cls}"]) ** 2 / v
        return np.where(np.isnan(t), 0.0, t) * m["mult"]

    def _joint(self, m: dict, x: np.ndarray, cls: int) -> np.ndarray:
        # an absent class gets a very low score
        if np.ndim(m[f"n{cls}"]):
            return np.where(m[f"n{cls}"] > 0, m[f"ln{cls}"] - 0.5 * self._distance(m, x, cls).sum(axis=1), ABSENT)
        if not m[f"n{cls}"] > 0:
            return np.full(len(x), ABSENT)
        return np.log(m[f"n{cls}"]) - 0.5 * self._distance(m, x, cls).sum(axis=1)

    def np_decision(self, m: dict, x: np.ndarray) -> np.ndarray:
        """Raw margin l1 - l0 (log-odds)."""
        return self._joint(m, x, 1) - self._joint(m, x, 0)

    def np_proba(self, m: dict, x: np.ndarray) -> np.ndarray:
        """p(class 1) of one bag's model (never missing)."""
        return 1.0 / (1.0 + np.exp(np.clip(-self.np_decision(m, x), -EXP_CLAMP, EXP_CLAMP)))

    def np_log_proba(self, m: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ln p0, ln p1) by log-sum-exp of the joint log-likelihoods."""
        l0, l1 = self._joint(m, x, 0), self._joint(m, x, 1)
        both = np.logaddexp(l0, l1)
        return l0 - both, l1 - both

    def np_terms(self, m: dict, x: np.ndarray) -> np.ndarray:
        """Each feature's part of the margin (its constant left out)."""
        one, zero = (np.log(v) + (x - m[f"mu{c}"]) ** 2 / v for c in (1, 0) for v in [np.where(m[f"v{c}"] > 0, m[f"v{c}"], np.nan)])
        t = -0.5 * (one - zero) * m["mult"]
        return np.where(np.isnan(t), 0.0, t)
