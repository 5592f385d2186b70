"""What the reliability grid needs to grow: draws hashed in arrays, nested prefixes without a full order, scoring over many axis values."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType

from pubag.functions.hashing import numbered_hash
from pubag.operators import sampling as S
from pubag.operators import scoring
from pubag.operators.learners import bag_sums as B
from pubag.operators.learners.gnb import GaussianNB


def test_numbered_hash_is_md5():
    rng = np.random.default_rng(0)
    starts = [b"42|boot|0|", "x|ä|".encode() + b"y" * 55, b"", b"z" * 130]
    of, number = rng.integers(0, 4, 3000), np.concatenate([np.arange(101), 10 ** np.arange(18), rng.integers(0, 3_000_000, 2881)])
    want = [int(hashlib.md5(starts[o] + str(n).encode()).hexdigest()[:15], 16) for o, n in zip(of, number)]
    assert numbered_hash(starts, of, number).tolist() == want
    short = number < 10
    assert numbered_hash(starts, of[short], number[short]).tolist() == np.array(want)[short].tolist()


@pytest.mark.parametrize("axis, values", [(["a", "b"], [(0, "x"), (7, None), (None, "é")]), (["a"], [(0.5,), (2.0,)]), (["_ax"], [(0,)])])
def test_draws_in_lists_are_the_draws_of_sql(spark, axis, values):
    m, n_u = [300, 7, 1][:len(values)], [40, 9, 5][:len(values)]
    kinds = {int: IntegerType(), str: StringType(), float: DoubleType()}
    types = [kinds[next(type(v[i]) for v in values if v[i] is not None)] for i in range(len(axis))]
    lists = S.bootstrap_lists(spark, 12, m, n_u, 5, axis, values, 3, axis_types=types)
    got = {(*[r[a] for a in axis], v // S.TIMES, r["pos"]): v % S.TIMES for r in lists.collect() for v in r["_drawn"]}
    plain = S.bootstrap_draws(spark, 12, m, n_u, 5, axis, values, 3, axis_types=types)
    assert got == {(*[r[a] for a in axis], r["bag"], r["pos"]): r["w"] for r in plain.collect()} and sum(got.values()) == 12 * sum(m)


@pytest.mark.parametrize("bits", [1, 4, 8])
def test_prefixes_are_first_n_of_each_size(spark, bits):
    df = spark.range(0, 900, 1, 5).select((F.col("id") % 3).cast("int").alias("g"), (F.col("id") / 2).cast("int").alias("k"), "id")
    sizes = spark.createDataFrame([(0, 0, 300), (0, 1, 299), (0, 2, 1), (1, 0, 150), (1, 1, 37), (2, 5, 8)], "g int, c int, n bigint")
    extra = (F.col("g"),)
    counts = S.prefix_counts(df, "k", 1, "t", "g", extra, bits)
    got = S.prefixes(df, counts, sizes, "k", 1, "t", ["g"], ["c"], extra, bits)
    assert got.columns == ["g", "k", "id", "c"]
    want = set()
    for r in sizes.collect():
        part = df.filter(F.col("g") == r["g"])
        want |= {(*t, r["c"]) for t in S.first_n(part, r["n"], "k", 1, "t", parts=["g"], extra=extra).collect()}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) == 795 and set(rows) == want


def _models(axes: int, bags: int, d: int) -> dict:
    rng, learner = np.random.default_rng(3), GaussianNB()
    row = lambda: {"fmult": [1] * d, "n0": 5.0, "n1": rng.integers(0, 3), **{f"mu{c}": list(rng.normal(size=d)) for c in (0, 1)},
                   **{f"v{c}": [None if rng.random() < 0.2 else v for v in rng.random(d) + 0.1] for c in (0, 1)}}
    return {str(a): [(b + 4, learner.unpack(row())) for b in range(bags) if (a + b) % 5] for a in range(axes)}


@pytest.mark.parametrize("axes, oob", [(1, False), (40, False), (40, True)])
def test_few_rows_an_axis_value_are_scored_together(axes, oob):
    """As many calls as there are bags, not one for each axis value and bag, and the votes of the models one by one."""
    d, bags, rows = 3, 6, 500
    rng, models, learner = np.random.default_rng(1), _models(axes, bags, d), GaussianNB()
    x, of = rng.normal(size=(rows, d)), rng.integers(0, axes + 1, rows)
    x[rng.random(x.shape) < 0.1] = np.nan
    drawn = rng.random((rows, bags)) < 0.3 if oob else None
    calls = []

    class Counted(GaussianNB):
        def np_proba(self, m, x):
            calls.append(len(x))
            return super().np_proba(m, x)

    n, s = np.zeros(rows, dtype=np.int32), np.zeros(rows)
    scoring._add_stacked(n, s, Counted(), scoring._stack(learner, models, 4, 4 + bags), x, [str(a) for a in range(axes + 1)], of, drawn, "proba", bags)
    want_n, want = np.zeros(rows, dtype=int), np.zeros(rows)
    for r in range(rows):
        for bag, m in models.get(str(of[r]), ()):
            if drawn is None or not drawn[r, bag - 4]:
                want_n[r] += 1
                want[r] += learner.np_proba(m, x[r:r + 1])[0]
    assert (n == want_n).all() and np.allclose(s, want, rtol=1e-13, atol=0) and len(calls) <= bags


def test_layout_samples_no_rows_and_takes_even_parts(spark):
    """Axis values lie in stretches of even tasks; the plan deals by number, so that no pass samples the rows first."""
    df = spark.range(0, 3000, 1, 3).select(F.when(F.col("id") < 2700, 0).otherwise(F.col("id") % 4).cast("string").alias("_axt"), F.col("id").alias("v"))
    got = B._by_axis(df, 3000)
    parts = [pd.Series([r["_axt"] for r in p]) for p in got.rdd.glom().collect()]
    sizes = [len(p) for p in parts]
    assert sum(sizes) == 3000 and max(sizes) < 2 * 3000 / len(parts) and "rangepartitioning" not in got._jdf.queryExecution().toString()
    assert all(p.is_monotonic_increasing for p in parts) and got.select("v").distinct().count() == 3000


def test_a_slice_has_bags_of_all_axis_values(monkeypatch):
    """Rows lie by axis value, so a slice of one axis value would leave most tasks without work."""
    monkeypatch.setattr(B, "SLICE_BYTES", 176)
    found = list(B.slices(15, 3, 100, 1))
    assert all((a0, a1) == (0, 15) and (a1 - a0) * (b1 - b0) <= 176 for a0, a1, b0, b1 in found)
    for n, bags, most in ((15, 100, 176), (15, 100, 7), (3, 2, 100), (400, 1, 30)):
        monkeypatch.setattr(B, "SLICE_BYTES", most)
        got = [(a, b) for a0, a1, b0, b1 in B.slices(n, 3, bags, 1) for a in range(a0, a1) for b in range(b0, b1)]
        assert sorted(got) == [(a, b) for a in range(n) for b in range(3, 3 + bags)]
        assert all((a1 - a0) * (b1 - b0) <= most for a0, a1, b0, b1 in B.slices(n, 3, bags, 1))


def test_whole_counts_give_the_sums_of_weights_and_targets(spark):
    """One count a feature (whole weights, targets 0 or 1) grows the trees that two weighted sums grow."""
    from pubag.operators.learners import tree as T

    df = spark.range(0, 900, 1, 3).select(F.lit(0).alias("ax"), "id", ((F.col("id") * 7) % 10 < 4).cast("int").alias("y"), ((F.col("id") * 13) % 29).cast("double").alias("x"),
                                         (F.col("id") % 11).cast("double").alias("z"), F.lit(None).cast("array<struct<bag:int,w:int>>").alias("_bags"))
    rows = B.packed(B.training_rows(df, ["ax"], ["x", "z"], "y", None, ["id"]), 900, 2)
    bins = T.Bins.over(rows, 2, 8, False)

    def grown(whole):
        def pairs(part, x, _):
            for b, row, w in part.of_bags(2):
                w = w * (part.r[row] % 3)
                y = part.y[row]
                yield b, x[:, row], w, None if whole else w * y, y.astype(np.uint8) if whole else None

        return T.grow(rows, ["0"], 2, 0, 2, 1, 3, bins, pairs, [None], np.ones((2, 2), dtype=bool), np.ones(2), np.array([3, 2]))

    for a, b in zip(grown(True), grown(False)):
        assert np.array_equal(a, b, equal_nan=True)
