"""BL2: decision trees for every bag at once, grown level by level on histograms over rows that are stored once.

Features are cut into ``n_bins`` bins over the training rows: of equal width between min and max, or
(``quantiles``) at approximate quantiles, which a few far values do not stretch. A missing value gets bin -1
and therefore always goes left.

A level is one pass over the rows (``bag_sums``): a task sends a model's rows down the tree as it is so far, by
whole comparisons of a feature's bins, and adds their weights and weighted targets to the histogram (node, feature,
bin) of their nodes. Only left children
are added up; a right child's histogram is its parent's less the left one. The merged histograms of a slice of
models give every node's best split, the least weighted Gini of the two children (ties: smallest feature, then
smallest bin); the totals of the last level's nodes follow from the splits above. No table of (row, bag) or
(row, node) is ever written, and the rows stay where they are.

Scoring takes the same paths (a bit a level) for all rows of an Arrow batch at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubag.operators.learners import bag_sums as B

# Defaults of the histogram tree.
N_BINS = 32
MAX_DEPTH = 4
MIN_GAIN = 1e-12
# Fixed value: (row, bag) pairs that a task holds at once; a call for a bag then has many rows.
TREE_PAIRS = 1 << 22
# Fixed value: bytes of the histograms whose splits the driver looks for at once; the search takes several times as much.
SPLIT_BYTES = 4 << 20


@dataclass
class Bins:
    """The cuts of all features: ``lo`` and ``wd`` of equal bins, or the sorted ``cuts`` of each feature."""

    n: int
    lo: np.ndarray
    wd: np.ndarray
    cuts: list | None

    @classmethod
    def over(cls, rows: DataFrame, d: int, n: int, quantiles: bool) -> Bins:
        rows = B.loose(rows, d)
        x = [F.when(F.abs(F.col("_x")[j]) < float("inf"), F.col("_x")[j]) for j in range(d)]
        got = rows.agg(*[F.min(c).alias(f"lo{j}") for j, c in enumerate(x)], *[F.max(c).alias(f"hi{j}") for j, c in enumerate(x)]).first()
        lo = np.array([got[f"lo{j}"] or 0.0 for j in range(d)])
        hi = np.array([got[f"hi{j}"] or 0.0 for j in range(d)])
        cuts = None
        if quantiles:  # at most n - 1 numbers a feature
            shares = [k / n for k in range(1, n)]
            got = rows.agg(*[F.percentile_approx(c, shares, 10000).alias(f"q{j}") for j, c in enumerate(x)]).first()
            cuts = [sorted(set(got[f"q{j}"] or [])) for j in range(d)]
        return cls(n, lo, np.where(hi > lo, (hi - lo) / n, 1.0), cuts)

    def of(self, x: np.ndarray) -> np.ndarray:
        """Bins of rows; -1 where a value is missing."""
        if self.cuts is not None:
            out = np.column_stack([np.searchsorted(np.asarray(c, dtype=float), x[:, j]) for j, c in enumerate(self.cuts)])
        else:
            out = np.clip(np.floor((np.where(np.isnan(x), 0.0, x) - self.lo) / self.wd), 0, self.n - 1)
        return np.where(np.isnan(x), -1, out).astype(np.int64)

    def columns(self) -> tuple:
        return self.lo.tolist(), self.wd.tolist(), [[float(v) for v in c] for c in self.cuts or []]

    @classmethod
    def from_columns(cls, n: int, row, quantiles: bool) -> Bins:
        return cls(n, np.array(row["lo"]), np.array(row["wd"]), [list(c) for c in row["cuts"]] if quantiles else None)


def paths(feat: np.ndarray, cut: np.ndarray, x: np.ndarray, depth: int) -> np.ndarray:
    """Of one tree, the path of every column of ``x`` (bins by feature): a bit a level, 1 for right, 0 below a leaf."""
    some = np.zeros(x.shape[1], dtype=np.uint8)

    def below(node: int, level: int):
        """Path bits below the node, as a number; None where there are only zeros."""
        if level == depth or feat[node] < 0:
            return None
        right = x[feat[node]] > cut[node]
        bit = right.view(np.uint8) << np.uint8(depth - 1 - level)
        a, b = below(2 * node, level + 1), below(2 * node + 1, level + 1)
        if a is not None:
            bit |= a * ~right
        if b is not None:
            bit |= b * right
        return bit

    got = below(1, 0)
    return some if got is None else got


def ends(feat: np.ndarray, depth: int) -> np.ndarray:
    """Of trees (..., nodes), the node in which each of the 2^depth paths ends."""
    node = np.ones((*feat.shape[:-1], 2 ** depth), dtype=np.int64)
    for level in range(depth):
        bit = np.arange(2 ** depth) >> (depth - 1 - level) & 1
        node = np.where(np.take_along_axis(feat, node, axis=-1) < 0, node, 2 * node + bit)
    return node


def by_feature(bins: np.ndarray, n: int) -> np.ndarray:
    """Bins of rows as one short array a feature."""
    return np.ascontiguousarray(bins.T.astype(np.int8 if n < 127 else np.int32))


def best_splits(hist: np.ndarray, allowed: np.ndarray, min_leaf: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of histograms (..., d, bins, 2): feature, bin index and (left, right) sums of the best split of each node;
    feature -1 where none gains."""
    left = hist.cumsum(axis=-2)
    total = left[..., :1, -1:, :]  # every feature's bins add up to the node
    lw, lwy, w, wy = left[..., 0], left[..., 1], total[..., 0], total[..., 1]
    rw, rwy = w - lw, wy - lwy
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = wy * (w - wy) / w - lwy * (lw - lwy) / lw - rwy * (rw - rwy) / rw
    gain = np.where((lw >= min_leaf) & (rw >= min_leaf) & allowed, gain, -np.inf)
    gain = np.where(np.isnan(gain), -np.inf, gain)
    flat = gain.reshape(*gain.shape[:-2], -1)
    at = np.round(flat, 9).argmax(axis=-1)  # gains that differ by the rounding of sums only are ties
    found = np.take_along_axis(flat, at[..., None], axis=-1)[..., 0] > MIN_GAIN
    bins = hist.shape[-2]
    pick = left.reshape(*flat.shape, 2)
    own = np.take_along_axis(pick, at[..., None, None], axis=-2)[..., 0, :]
    return np.where(found, at // bins, -1), at % bins, own, total[..., 0, 0, :] - own


def grow(rows: DataFrame, axes: list[str], d: int, b0: int, b1: int, per_bag: int, depth: int, bins: Bins, pairs: Callable, state: list,
         allowed: np.ndarray, min_leaf: np.ndarray, caps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feat, cut, value), each (axis values, models, nodes), of ``per_bag`` trees a bag. ``pairs(rows, bins of the
    rows by feature, state of the axis value)`` yields per model (model, its rows' bins by feature, their weights,
    their weights x targets, none), or (…, none, 1 for each target of 1 and 0 for 0) where weights are whole numbers;
    rows of weight 0 are left out here. ``allowed`` (models, d), ``min_leaf`` and ``caps`` (models) bound the splits. Nodes are
    numbered as in a heap, from 1."""
    if depth > 8:
        raise ValueError("a path has at most 8 bits")
    rows = B.in_bags(rows)
    models, size, nb = (b1 - b0) * per_bag, 2 ** (depth + 1), bins.n + 1
    feat = np.full((len(axes), models, size), -1, dtype=np.int32)
    cut = feat.copy()
    total = np.zeros((len(axes), models, size, 2))
    parent = None
    used = allowed.copy()  # a node's totals are those of any feature, so the first one is kept
    used[:, 0] = True
    for level in range(depth):
        width = max(1, 2 ** level // 2)

        def add(acc, part, own, level=level, width=width, used=used):
            f, c, extra = own
            hist = acc.reshape(models, width, d, nb, 2)
            for model, x, w, wy, ones in pairs(part, by_feature(bins.of(part.x), bins.n), extra):
                place = None
                if level:
                    split = f[model, width:2 * width] >= 0
                    if not split.any():
                        continue
                    at = paths(f[model], c[model], x, level)
                    some = np.flatnonzero((at & 1 == 0) & (w != 0))
                    place = (at[some] >> 1).astype(np.int64) * (2 * nb if wy is None else nb)
                else:
                    some = np.flatnonzero(w)
                if len(some) == len(w):
                    some = slice(None)
                w = w[some]
                if wy is None:  # whole weights and targets 0 or 1: one count a feature tells both sums
                    place = (place if level else 0) + ones[some].astype(np.int64) + 2
                else:
                    place, wy = (place if level else np.int64(0)) + 1, wy[some]
                for j in np.flatnonzero(used[model]):
                    bin_ = x[j][some]
                    if wy is None:
                        both = np.bincount(place + 2 * bin_.astype(np.int64), w, 2 * width * nb).reshape(width, nb, 2)
                        new = np.stack([both[..., 0] + both[..., 1], both[..., 1]], axis=-1)
                    else:
                        key = place + bin_
                        new = np.stack([np.bincount(key, v, width * nb).reshape(width, nb) for v in (w, wy)], axis=-1)
                    if level:
                        new[~split] = 0.0
                    hist[model, :, j] += new

        got = B.summed(rows, axes, b0, b1, d, per_bag * width * d * nb * 2, add, [(feat[a], cut[a], state[a]) for a in range(len(axes))], pairs=TREE_PAIRS)
        left = got.reshape(len(axes), models, width, d, nb, 2)
        now, nodes, last = 2 ** level, slice(2 ** level, 2 ** (level + 1)), level == depth - 1
        hist = None if last else np.empty((len(axes), models, now, d, nb, 2)) if level else left
        step = max(1, SPLIT_BYTES // (len(axes) * now * d * nb * 16))
        for lo in range(0, models, step):
            some = slice(lo, lo + step)
            if level:
                split = feat[:, some, width:2 * width] >= 0
                own = np.empty((len(axes), split.shape[1], now, d, nb, 2))
                own[:, :, 0::2] = left[:, some]
                own[:, :, 1::2] = np.where(split[..., None, None, None], parent[:, some] - left[:, some], 0.0)
                if not last:
                    hist[:, some] = own
            else:
                own = left[:, some]
                total[:, some, 1] = own[:, :, 0, 0].sum(axis=-2)
            open_ = allowed[None, some, None, :, None] & (caps[some] > level)[None, :, None, None, None]
            f, t, low, high = best_splits(own, open_, min_leaf[None, some, None, None, None])
            feat[:, some, nodes], cut[:, some, nodes] = f, np.where(f >= 0, t - 1, -1)
            below, grows = total[:, some, 2 ** (level + 1):2 ** (level + 2)], (f >= 0)[..., None]
            below[:, :, 0::2], below[:, :, 1::2] = np.where(grows, low, 0.0), np.where(grows, high, 0.0)
        parent = hist
        del left, got
        if not (feat[:, :, nodes] >= 0).any():
            break
    with np.errstate(divide="ignore", invalid="ignore"):
        value = total[..., 1] / total[..., 0]
    return feat, cut, np.where(total[..., 0] > 0, value, np.nan)


def counts(part: B.Rows) -> bool:
    """Whether the rows' weights are whole numbers and their targets 0 or 1, so that sums of either are exact."""
    return bool((part.w0 == 1).all() and ((part.y == 0) | (part.y == 1)).all())


def tree_bytes(depth: int, n_bins: int, d: int) -> int:
    """What growing one tree holds: the histograms of two levels and what a reducer makes of them."""
    return 3 * 16 * (n_bins + 1) * d * 2 ** max(0, depth - 1)


class DecisionTree:
    name = "tree"
    has_proba = True
    takes_weight = True

    def __init__(self, max_depth: int = MAX_DEPTH, n_bins: int = N_BINS, min_weight_leaf: float = 1.0, quantiles: bool = False):
        self.max_depth = max_depth
        self.n_bins = n_bins
        self.min_weight_leaf = float(min_weight_leaf)
        self.quantiles = quantiles

    MODEL = "feat array<int>, cut array<int>, value array<double>, lo array<double>, wd array<double>, cuts array<array<double>>"

    def fit_rows(self, rows: DataFrame, axes: list[str], d: int, first: int, bags: int, fbags: list | None = None, bag_params: list[dict] | None = None):
        """``bag_params`` gives every bag its own ``max_depth``, ``min_leaf`` and ``allowed`` features (a
        hyper-parameter grid as bags of the same rows)."""
        bins = Bins.over(rows, d, self.n_bins, self.quantiles)
        params = bag_params or [{"max_depth": self.max_depth, "min_leaf": self.min_weight_leaf, "allowed": fb} for fb in fbags or [range(d)] * bags]

        def pairs(part, x, _, models=None):
            whole = counts(part)
            for b, row, w in part.of_bags(models):
                y = part.y[row]
                yield b, x[:, row], w, None if whole else w * y, y.astype(np.uint8) if whole else None

        for a0, a1, b0, b1 in B.slices(len(axes), first, bags, tree_bytes(self.max_depth, self.n_bins, d)):
            mine = params[b0 - first:b1 - first]
            allowed = np.array([[j in set(p["allowed"]) for j in range(d)] for p in mine])
            feat, cut, value = grow(rows, axes[a0:a1], d, b0, b1, 1, self.max_depth, bins, partial(pairs, models=b1 - b0), [None] * (a1 - a0), allowed,
                                    np.array([float(p["min_leaf"]) for p in mine]), np.array([p["max_depth"] for p in mine]))
            for a in range(a0, a1):
                for b in range(b0, b1):
                    yield (a, b, *tree_columns(feat[a - a0, b - b0], cut[a - a0, b - b0], value[a - a0, b - b0]), *bins.columns())

    # -- scoring of one bag's tree over the rows of an array -------------------------

    def unpack(self, row) -> dict:
        return tree_arrays(row) | {"bins": Bins.from_columns(self.n_bins, row, self.quantiles)}

    def np_map(self, m: dict, x: np.ndarray) -> np.ndarray:
        return m["bins"].of(x)

    def np_proba(self, m: dict, x: np.ndarray) -> np.ndarray:
        """Value of the leaf that each row (of bins) reaches in ``max_depth`` steps."""
        return leaf_values(m, x.astype(np.int64), self.max_depth)

    def np_trees(self, m: dict) -> list[tuple[float, dict]]:
        """(scale, tree) of the trees that add up to the model's output."""
        return [(1.0, m)]

    @staticmethod
    def model_columns() -> list[str]:
        return ["feat", "cut", "value", "lo", "wd", "cuts"]

    def model_bytes(self, d: int) -> int:
        return 40 * (2 ** (self.max_depth + 1)) + (16 + 8 * self.n_bins) * d + 64


def tree_columns(feat: np.ndarray, cut: np.ndarray, value: np.ndarray) -> tuple[list, list, list]:
    return feat.tolist(), cut.tolist(), [None if v != v else v for v in value.tolist()]


def tree_arrays(row) -> dict:
    return {"feat": np.array(row["feat"]), "cut": np.array(row["cut"]), "value": np.array([v or 0.0 for v in row["value"]])}


def leaf_values(m: dict, bins: np.ndarray, depth: int) -> np.ndarray:
    return tree_values(m, by_feature(bins, bins.max(initial=0)), depth)


def with_paths(m: dict, depth: int) -> dict:
    """A tree with the value in which each path ends, which every batch of rows asks for."""
    return m | {"by_path": m["value"][ends(m["feat"], depth)]}


def tree_values(m: dict, x: np.ndarray, depth: int) -> np.ndarray:
    """Value of the leaf that each column of ``x`` (bins by feature) reaches."""
    by_path = m["by_path"] if "by_path" in m else m["value"][ends(m["feat"], depth)]
    return by_path[paths(m["feat"], m["cut"], x, depth)]
