"""BL5 and BL6: kernel SVM and multilayer perceptron of all bags (and axis values) at once, by batched gradients.

Each step is one pass over the rows (``bag_sums``): a task computes the gradient of every model of the slice on
its rows, the gradients are merged by a tree of reducers, and the step is made for all models together. A row
weighs its multiplicity in the bag times its own weight. Features are standardised by the mean and deviation of
all rows of the axis value (``scale=False`` leaves them as they are); a missing one is 0 then.

Kernel SVM: the RBF kernel (gamma = 1 / features) as ``dim`` random Fourier features sqrt(2 / dim) cos(x w + b)
with hash-drawn w and b, and a linear machine of the squared hinge, lambda / 2 |v|^2 + mean of
max(0, 1 - s f)^2 / 2 (the intercept is not penalised), by accelerated gradient steps of length 1 / (lambda + 3),
which bounds the curvature. Votes are the sign of the decision, there are no probabilities.

Perceptron: one hidden layer of logistic units, logistic output, log loss + alpha / 2 |w|^2 / weight, whole-bag
Adam steps. Initial weights are uniform by hash of the bag's number, so that a warm start continues them.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubag.operators.learners import bag_sums as B
from pubag.operators.sampling import feature_bag_hash

# Fixed value: rows whose hidden layer is worked on at once: few enough for a core's share of the cache, many enough that
# the calls cost little beside their work.
BLOCK = 1024
# Tanh is held for whole multiples of 3 * 2^-GRID, as many as 16 bits number; the power of two and a half beside
# which a double ends in 2^-GRID; what the multiples reach; and tanh at them, by their last 16 bits.
GRID = 10
BESIDE = np.float64(1.5 * 2.0 ** (52 - GRID))
REACH = 31.0
AT_GRID = np.tanh(3.0 * 2.0 ** -GRID * np.concatenate([np.arange(1 << 15), np.arange(-(1 << 15), 0)]))
LAST_16, THIRD = np.int64((1 << 16) - 1), np.float64(1.0 / 3.0)


def u01(*parts) -> float:
    """A number in (0, 1) by hash of its name."""
    return (feature_bag_hash(*parts) + 0.5) / float(2 ** 60)


def sigmoid(t: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(t, -700, 700)))


def _tanh_3(t: np.ndarray, far: bool, near: np.ndarray, out: np.ndarray, square: np.ndarray) -> np.ndarray:
    """tanh(3 t) to the last digits (abs. 3e-16), in ``out``; ``near`` and ``square`` are room, ``t`` is overwritten. ``far``:
    ``t`` may be beyond ``REACH``. NumPy's exp takes a number at a time, this some plain passes over arrays: tanh of the
    nearest grid point g comes from the table, and with r = t - g, tanh(3 r) = r / (1/3 + r^2) up to 2e-16 (3 r is at
    most 1.5e-3), put together by the addition theorem."""
    if far:
        np.clip(t, -REACH, REACH, out=t)
    np.add(t, BESIDE, out=near)
    place = square.view(np.int64)
    np.bitwise_and(near.view(np.int64), LAST_16, out=place)
    AT_GRID.take(place, out=out, mode="clip")
    np.subtract(near, BESIDE, out=near)
    np.subtract(t, near, out=t)
    np.multiply(t, t, out=square)
    np.add(square, THIRD, out=square)
    np.multiply(out, t, out=near)
    np.add(near, square, out=near)
    np.multiply(out, square, out=out)
    np.add(out, t, out=out)
    return np.divide(out, near, out=out)


def _room(rows: int, hidden: int) -> np.ndarray:
    """What ``_Layer`` works in."""
    return np.empty((4, max(1, min(BLOCK, rows)), hidden))


class _Layer:
    """A hidden layer of logistic units h = (1 + u) / 2, u = tanh(half of what goes in): ``u`` of blocks of rows. Rows and
    weights have a multiple of 8 columns, the last but zeros 1 and the bias, which suits the matrix products."""

    def __init__(self, w1: np.ndarray, b1: np.ndarray, w2: np.ndarray, b2: float, room: np.ndarray):
        d, hidden = w1.shape
        self.w = np.zeros((self.columns(d), hidden))
        self.w[:d], self.w[d] = w1 / 6.0, b1 / 6.0
        self.largest = np.abs(self.w)
        self.half, self.bias, self.room = w2 / 2.0, w2.sum() / 2.0 + b2, room

    @staticmethod
    def columns(d: int) -> int:
        return -(-(d + 1) // 8) * 8

    @staticmethod
    def rows(z: np.ndarray) -> np.ndarray:
        out = np.zeros((len(z), _Layer.columns(z.shape[1])))
        out[:, :z.shape[1]], out[:, z.shape[1]] = z, 1.0
        return out

    def blocks(self, rows: np.ndarray):
        """(from, to, u, what the output unit takes, room) of blocks that are as even as they can be."""
        n = len(rows)
        step = -(-n // max(1, -(-n // self.room.shape[1])))
        for lo in range(0, n, max(1, step)):
            part = rows[lo:lo + step]
            t, near, u, square = self.room[:, :len(part)]
            np.matmul(part, self.w, out=t)
            within = (np.abs(part).max(axis=0) @ self.largest).max() <= REACH  # nothing in the block can go beyond
            _tanh_3(t, not within, near, u, square)
            yield lo, lo + len(part), u, u @ self.half + self.bias, t


@lru_cache(maxsize=16)
def _directions(seed, dim: int, d: int, gamma: float) -> tuple[np.ndarray, np.ndarray]:
    sd = math.sqrt(2.0 * gamma)
    w = [[sd * math.sqrt(-2.0 * math.log(u01(seed, "rff", k, j, 1))) * math.cos(2 * math.pi * u01(seed, "rff", k, j, 2))
          for k in range(dim)] for j in range(d)]
    return np.array(w), np.array([2 * math.pi * u01(seed, "rff-b", k) for k in range(dim)])


class _Steps:
    """What both learners share: standardised rows, the slices and the loop of steps."""

    takes_weight = True
    additive = False
    slow_votes = True

    def _scales(self, rows: DataFrame, axes: list[str], d: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Mean and deviation of each feature per axis value (a constant feature is divided by 1)."""
        if not self.scale:
            return [(np.zeros(d), np.ones(d)) for _ in axes]
        x = [F.when(F.abs(F.col("_x")[j]) < float("inf"), F.col("_x")[j]) for j in range(d)]
        got = B.loose(rows, d).groupBy("_axt").agg(*[F.avg(c).alias(f"m{j}") for j, c in enumerate(x)], *[F.stddev_pop(c).alias(f"s{j}") for j, c in enumerate(x)])
        found = {r["_axt"]: r for r in got.collect()}  # 2 d numbers per axis value
        value = lambda a, n, none: np.array([found[a][f"{n}{j}"] or none for j in range(d)], dtype=float)
        return [(value(a, "m", 0.0), value(a, "s", 1.0)) for a in axes]

    @staticmethod
    def _scaled(x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
        z = (x - mean) / sd
        return np.where(np.isnan(z), 0.0, z)

    def _masks(self, fbags: list | None, d: int, bags: int) -> np.ndarray:
        """(bags, d): 1 for the features of the bag."""
        if fbags is None:
            return np.ones((bags, d))
        return np.array([[float(j in fb) for j in range(d)] for fb in fbags])

    def fit_rows(self, rows: DataFrame, axes: list[str], d: int, first: int, bags: int, fbags: list | None = None):
        scales, masks = self._scales(rows, axes, d), self._masks(fbags, d, bags)
        rows = B.in_bags(rows)
        for a0, a1, b0, b1 in B.slices(len(axes), first, bags, 8 * 4 * self._size(d)):
            models = self._trained(rows, axes[a0:a1], scales[a0:a1], d, b0, b1, masks[b0 - first:b1 - first])
            for a in range(a0, a1):
                mean, sd = (v.tolist() for v in scales[a])
                yield from ((a, b, models[a - a0, b - b0].tolist(), mean, sd) for b in range(b0, b1))

    MODEL = "params array<double>, mean array<double>, sd array<double>"

    @staticmethod
    def model_columns() -> list[str]:
        return ["params", "mean", "sd"]

    def model_bytes(self, d: int) -> int:
        return 8 * (self._size(d) + 2 * d) + 64

    def np_map(self, m: dict, x: np.ndarray) -> np.ndarray:
        """The rows as the models of one axis value see them."""
        return self._scaled(x, m["mean"], m["sd"])


class KernelSVM(_Steps):
    """BL5."""

    name = "kernel_svm"
    has_proba = False

    def __init__(self, dim: int = 100, steps: int = 40, reg: float = 0.01, gamma: float | None = None, scale: bool = True, seed: int = 0):
        self.dim, self.steps, self.reg, self.gamma, self.scale, self.seed = dim, steps, float(reg), gamma, scale, seed

    def _size(self, d: int) -> int:
        return self.dim + 1

    def directions(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """(d x dim) w ~ N(0, 2 gamma) by Box-Muller on hash uniforms, and b ~ U(0, 2 pi)."""
        return _directions(self.seed, self.dim, d, self.gamma if self.gamma is not None else 1.0 / d)

    def _fourier(self, z: np.ndarray) -> np.ndarray:
        """Fourier features of standardised rows, and a column of ones."""
        w, b = self.directions(z.shape[1])
        return np.column_stack([math.sqrt(2.0 / self.dim) * np.cos(z @ w + b), np.ones(len(z))])

    def _trained(self, rows, axes, scales, d, b0, b1, masks) -> np.ndarray:
        if (masks < 1).any():
            raise ValueError("the Fourier features are those of all features: max_features must keep all")
        one, shape = self, (len(axes), b1 - b0, self.dim + 1)
        ridge = np.append(np.full(self.dim, self.reg), 0.0)

        def add(acc, part, state):
            (mean, sd), v = state
            z = one._fourier(one._scaled(part.x, mean, sd))
            s = np.where(part.y == 1, 1.0, -1.0)[:, None]
            w = part.dense(len(acc)) * part.w0[:, None]
            short = np.maximum(0.0, 1.0 - s * (z @ v.T))
            acc[:, :-1] += -(w * s * short).T @ z
            acc[:, -1] += w.sum(axis=0)

        v, ahead = np.zeros(shape), np.zeros(shape)
        for k in range(self.steps):
            got = B.summed(rows, axes, b0, b1, d, self.dim + 2, add, list(zip(scales, ahead)))
            grad = got[..., :-1] / np.maximum(got[..., -1:], 1e-300) + ridge * ahead
            new = ahead - grad / (self.reg + 3.0)
            ahead = new + k / (k + 3.0) * (new - v)
            v = new
        return v

    # -- scoring -----------------------------------------------------------------

    def unpack(self, row) -> dict:
        return {"v": np.array(row["params"]), "mean": np.array(row["mean"]), "sd": np.array(row["sd"])}

    def np_map(self, m: dict, x: np.ndarray) -> np.ndarray:
        return self._fourier(super().np_map(m, x))

    def np_decision(self, m: dict, x: np.ndarray) -> np.ndarray:
        return x @ m["v"]

    def np_proba(self, m: dict, x: np.ndarray) -> np.ndarray:
        """The vote: 1 where the decision is positive."""
        return (x @ m["v"] > 0).astype(float)


class Perceptron(_Steps):
    """BL6."""

    name = "mlp"
    has_proba = True

    def __init__(self, hidden: int = 100, steps: int = 60, rate: float = 0.05, alpha: float = 1e-4, scale: bool = True, seed: int = 0):
        self.hidden, self.steps, self.rate, self.alpha, self.scale, self.seed = hidden, steps, float(rate), float(alpha), scale, seed

    def _size(self, d: int) -> int:
        return self.hidden * (d + 2) + 1

    def first_weights(self, bag: int, d: int) -> np.ndarray:
        """Uniform in +-sqrt(2 / (inputs + outputs)) of the layer: W1 (d x hidden), b1, w2, b2."""
        a, b = math.sqrt(2.0 / (d + self.hidden)), math.sqrt(2.0 / (self.hidden + 1))
        n = self.hidden * (d + 1)
        return np.array([(2 * u01(self.seed, "mlp", bag, i) - 1) * (a if i < n else b) for i in range(self._size(d))])

    def parts(self, p: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        h = self.hidden
        return p[:d * h].reshape(d, h), p[d * h:(d + 1) * h], p[(d + 1) * h:(d + 2) * h], p[-1]

    def gradient(self, p: np.ndarray, z: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Gradient of the weighted sum of log losses."""
        return self._gradient(p, z.shape[1], _Layer.rows(z), y, w, _room(len(z), self.hidden))

    def _gradient(self, p: np.ndarray, d: int, rows: np.ndarray, y: np.ndarray, w: np.ndarray, room: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.parts(p, d)
        inner, out, back_rows = np.zeros((rows.shape[1], self.hidden)), np.zeros(self.hidden), np.zeros(rows.shape[1])
        for lo, hi, u, t, square in _Layer(w1, b1, w2, b2, room).blocks(rows):
            back = w[lo:hi] * (sigmoid(t) - y[lo:hi])
            part = rows[lo:hi] * back[:, None]
            out += back @ u
            back_rows += part.sum(axis=0)
            inner += part.T @ np.multiply(u, u, out=square)
        # h = (1 + u) / 2 and h (1 - h) = (1 - u^2) / 4; the column of ones adds up ``back``
        inner = (back_rows[:, None] - inner)[:d + 1] * (w2 / 4.0)
        return np.concatenate([inner.ravel(), (out + back_rows[d]) / 2.0, back_rows[d:d + 1]])

    def _trained(self, rows, axes, scales, d, b0, b1, masks) -> np.ndarray:
        one, size, h = self, self._size(d), self.hidden

        def add(acc, part, state):
            (mean, sd), models = state
            z = _Layer.rows(one._scaled(part.x, mean, sd))
            room = _room(len(z), h)
            for b, r, w in part.of_bags(len(acc)):
                acc[b, :-1] += one._gradient(models[b], d, z[r], part.y[r], w, room)
                acc[b, -1] += w.sum()

        # features that a bag does not use keep weights of 0
        used = np.concatenate([np.repeat(masks, h, axis=1), np.ones((len(masks), 2 * h + 1))], axis=1)
        p = np.tile(np.array([self.first_weights(b, d) for b in range(b0, b1)]) * used, (len(axes), 1, 1))
        penal = np.concatenate([np.ones(d * h), np.zeros(h), np.ones(h), np.zeros(1)])
        m, s = np.zeros_like(p), np.zeros_like(p)
        for k in range(1, self.steps + 1):
            got = B.summed(rows, axes, b0, b1, d, size + 1, add, list(zip(scales, p)))
            grad = used * (got[..., :-1] + self.alpha * penal * p) / np.maximum(got[..., -1:], 1e-300)
            m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad * grad
            p = p - self.rate * (m / (1 - 0.9 ** k)) / (np.sqrt(s / (1 - 0.999 ** k)) + 1e-8)
        return p

    # -- scoring -----------------------------------------------------------------

    def unpack(self, row) -> dict:
        mean = np.array(row["mean"])
        w1, b1, w2, b2 = self.parts(np.array(row["params"]), len(mean))
        return {"w1": w1, "b1": b1, "w2": w2, "b2": b2, "mean": mean, "sd": np.array(row["sd"])}

    def np_decision(self, m: dict, x: np.ndarray) -> np.ndarray:
        out, rows = np.empty(len(x)), _Layer.rows(x)
        for lo, hi, _, t, _ in _Layer(m["w1"], m["b1"], m["w2"], m["b2"], _room(len(x), self.hidden)).blocks(rows):
            out[lo:hi] = t
        return out

    def np_proba(self, m: dict, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.np_decision(m, x))
