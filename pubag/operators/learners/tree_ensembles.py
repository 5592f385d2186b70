"""BL3 and BL4: forests and boosted trees of every bag in one job, on the histogram trees of BL2.

Features are cut at quantiles. Rows are stored once; what a bag's tree sees of a row is worked out in each pass
from the row's number (a hash of its key) and the names of bag and tree, so two rows with equal features have
draws of their own and nothing per (row, bag, tree) is kept.

Forest: a bag has ``n_trees`` trees, each with its own Poisson(1) weights of the bag's rows and its own
hash-chosen features; all trees of all bags grow level by level in the same passes. A bag's probability is the
mean of its trees' leaf values.

Boosting: the split gain of BL2 for weights h and targets g / h is G_l^2 / H_l + G_r^2 / H_r
- G^2 / H, and its leaf value is G / H, the Newton step. Each round grows one tree per bag on
the gradient and hessian of the logistic loss, all bags at once; a pass adds up a row's margin from the earlier
trees of its bag. With ``drop`` > 0 (dart) each round leaves out the earlier trees whose hash falls below it, and
scales the new and the dropped trees by 1 / (k + 1) and k / (k + 1).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from pubag.operators.learners import bag_sums as B
from pubag.operators.learners.tree import Bins, by_feature, counts, ends, grow, paths, tree_arrays, tree_bytes, tree_columns, tree_values, with_paths
from pubag.operators.sampling import feature_bag, feature_bag_hash, poisson_cdf


class _OfTrees:
    has_proba = True
    takes_weight = True
    draws_rows = True
    slow_votes = True

    MODEL = ("trees array<struct<no:int,scale:double,feat:array<int>,cut:array<int>,value:array<double>>>, "
             "lo array<double>, wd array<double>, cuts array<array<double>>")

    def model_bytes(self, d: int) -> int:
        return self.n_trees * (40 * 2 ** (self.max_depth + 1) + 16) + (16 + 8 * self.n_bins) * d + 64

    @staticmethod
    def model_columns() -> list[str]:
        return ["trees", "lo", "wd", "cuts"]

    def unpack(self, row) -> dict:
        return {"trees": [(t["scale"], with_paths(tree_arrays(t), self.max_depth)) for t in sorted(row["trees"], key=lambda t: t["no"])],
                "bins": Bins.from_columns(self.n_bins, row, True)}

    def np_map(self, m: dict, x: np.ndarray) -> np.ndarray:
        return m["bins"].of(x)

    def _each(self, m: dict, x: np.ndarray) -> list[np.ndarray]:
        bins = by_feature(x, self.n_bins)
        return [s * tree_values(t, bins, self.max_depth) for s, t in m["trees"]]


class Forest(_OfTrees):
    """BL3. ``features`` is the share of the features that a tree sees."""

    name = "random_forest"

    def __init__(self, n_trees: int = 10, max_depth: int = 4, n_bins: int = 32, min_weight_leaf: float = 1.0, features: float = 0.7, seed: int = 0):
        self.n_trees, self.max_depth, self.n_bins, self.seed = n_trees, max_depth, n_bins, seed
        self.min_weight_leaf, self.features = float(min_weight_leaf), float(features)

    def fit_rows(self, rows: DataFrame, axes: list[str], d: int, first: int, bags: int, fbags: list | None = None):
        n, bins = self.n_trees, Bins.over(rows, d, self.n_bins, True)
        steps = np.array(poisson_cdf(1.0))
        for a0, a1, b0, b1 in B.slices(len(axes), first, bags, n * tree_bytes(self.max_depth, self.n_bins, d)):
            lines = np.array([[B.line(self.seed, "forest", b, t) for t in range(n)] for b in range(b0, b1)])
            allowed = np.zeros(((b1 - b0) * n, d), dtype=bool)
            for b in range(b0, b1):
                own = sorted(set(fbags[b - first])) if fbags is not None else list(range(d))
                k = max(1, round(self.features * len(own)))
                for t, pick in enumerate(feature_bag(len(own), k, n, f"{self.seed}|{b}")):
                    allowed[(b - b0) * n + t, [own[j] for j in pick]] = True

            def pairs(part, x, _, lines=lines):
                whole = counts(part)
                for b, row, w0 in part.of_bags(len(lines)):
                    mine, y, r = x[:, row], part.y[row], part.r[row]
                    ones = y.astype(np.uint8) if whole else None
                    for t in range(n):
                        u = B.row_uniform(r, *lines[b, t])
                        times = np.zeros(len(row), dtype=np.uint8)
                        for step in steps[steps <= u.max()]:
                            times += (u >= step).view(np.uint8)
                        w = w0 * times
                        yield b * n + t, mine, w, None if whole else w * y, ones

            models = (b1 - b0) * n
            feat, cut, value = grow(rows, axes[a0:a1], d, b0, b1, n, self.max_depth, bins, pairs, [None] * (a1 - a0), allowed,
                                    np.full(models, self.min_weight_leaf), np.full(models, self.max_depth))
            for a in range(a0, a1):
                for b in range(b0, b1):
                    trees = [(t, 1.0, *tree_columns(*(v[a - a0, (b - b0) * n + t] for v in (feat, cut, value)))) for t in range(n)]
                    yield (a, b, trees, *bins.columns())

    def np_trees(self, m: dict) -> list[tuple[float, dict]]:
        return [(s / len(m["trees"]), t) for s, t in m["trees"]]

    def np_proba(self, m: dict, x: np.ndarray) -> np.ndarray:
        return np.mean(self._each(m, x), axis=0)


class BoostedTrees(_OfTrees):
    """BL4. ``features`` and ``rows`` are the shares of features and rows that a round uses."""

    name = "boosted_trees"

    def __init__(self, n_trees: int = 20, learning_rate: float = 0.5, max_depth: int = 3, n_bins: int = 32, min_weight_leaf: float = 1e-3,
                 features: float = 0.8, rows: float = 0.5, drop: float = 0.0, seed: int = 0):
        self.n_trees, self.learning_rate, self.max_depth, self.n_bins, self.seed = n_trees, float(learning_rate), max_depth, n_bins, seed
        self.min_weight_leaf, self.features, self.rows, self.drop = float(min_weight_leaf), float(features), float(rows), float(drop)

    def _bag_params(self, d: int, first: int, bags: int, fbags: list | None) -> list[dict]:
        return [{"learning_rate": self.learning_rate, "max_depth": self.max_depth, "min_leaf": self.min_weight_leaf, "features": self.features,
                 "rows": self.rows, "own": sorted(set(fb))} for fb in fbags or [range(d)] * bags]

    def fit_rows(self, rows: DataFrame, axes: list[str], d: int, first: int, bags: int, fbags: list | None = None, bag_params: list[dict] | None = None):
        """``bag_params`` gives every bag its own ``learning_rate``, ``max_depth``, ``min_leaf`` (hessian weight),
        ``features`` and ``rows`` (a hyper-parameter grid as bags of the same rows)."""
        bins = Bins.over(rows, d, self.n_bins, True)
        params = bag_params or self._bag_params(d, first, bags, fbags)
        for a0, a1, b0, b1 in B.slices(len(axes), first, bags, tree_bytes(self.max_depth, self.n_bins, d) + 24 * self.n_trees * 2 ** (self.max_depth + 1)):
            mine = params[b0 - first:b1 - first]
            yield from self._boosted(rows, axes[a0:a1], a0, d, b0, b1, bins, mine)

    def _boosted(self, rows, axes, a0, d, b0, b1, bins, params):
        depth, models = self.max_depth, b1 - b0
        rate = np.array([p["learning_rate"] for p in params])
        share, caps = np.array([p["rows"] for p in params]), np.array([p["max_depth"] for p in params])
        leaf = np.array([float(p["min_leaf"]) for p in params])
        grown, made, scales = [], [], []
        for k in range(self.n_trees):
            gone = [i for i in range(k) if feature_bag_hash(self.seed, "drop", k, i) / 2**60 < self.drop]
            lines = np.array([B.line(self.seed, "rows", k, b) for b in range(b0, b1)])
            allowed = np.zeros((models, d), dtype=bool)
            for b, p in enumerate(params):
                own = p.get("own", range(d))
                take = max(1, round(p["features"] * len(own)))
                allowed[b, [own[j] for j in feature_bag(len(own), take, 1, f"{self.seed}|{k}|{b0 + b}")[0]]] = True

            def pairs(part, x, trees, lines=lines, kept=[i for i in range(k) if i not in gone]):
                for b, row, w0 in part.of_bags(models):
                    if share[b] < 1:
                        some = np.flatnonzero(B.row_uniform(part.r[row], *lines[b]) < share[b])
                        row, w0 = row[some], w0[some]
                    mine, margin = x[:, row], np.zeros(len(row))
                    for i in kept:
                        f, t, leaf_value = trees[i]
                        margin += leaf_value[b][paths(f[b], t[b], mine, depth)]
                    p = np.clip(1.0 / (1.0 + np.exp(-np.clip(margin, -700, 700))), 1e-6, 1 - 1e-6)
                    yield b, mine, w0 * p * (1 - p), w0 * (part.y[row] - p), None

            state = [[(f[a], t[a], s[:, None] * v[a]) for (f, t, v), s in zip(made, scales)] for a in range(len(axes))]
            feat, cut, value = grow(rows, axes, d, b0, b1, 1, depth, bins, pairs, state, allowed, leaf, caps)
            grown.append((feat, cut, value))
            made.append((feat, cut, np.take_along_axis(np.nan_to_num(value), ends(feat, depth), axis=-1)))  # by path
            if gone:
                part = len(gone) / (len(gone) + 1)
                scales = [s * part if i in gone else s for i, s in enumerate(scales)]
            scales.append(rate / (len(gone) + 1))
        for a in range(len(axes)):
            for b in range(models):
                trees = [(k, float(scales[k][b]), *tree_columns(*(v[a, b] for v in tree))) for k, tree in enumerate(grown)]
                yield (a0 + a, b0 + b, trees, *bins.columns())

    def np_trees(self, m: dict) -> list[tuple[float, dict]]:
        """The trees that add up to the margin."""
        return m["trees"]

    def np_decision(self, m: dict, x: np.ndarray) -> np.ndarray:
        return np.sum(self._each(m, x), axis=0)

    def np_proba(self, m: dict, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.np_decision(m, x), -700, 700)))
