"""Passes over training rows: what crosses to Python, where rows of an axis value lie, tree paths."""

import numpy as np
from pyspark.sql import functions as F

from pubag.operators.learners import bag_sums as B
from pubag.operators.learners.tree import ends, paths

KIND = "array<struct<bag:int,w:int>>"


def _rows(spark, n=400):
    df = spark.range(0, n, 1, 4).select(
        (F.col("id") % 5).cast("int").alias("ax"), "id", (F.col("id") % 2).cast("int").alias("y"), F.col("id").cast("double").alias("x"),
        F.when(F.col("id") % 2 == 0, F.array(F.struct(F.lit(1).alias("bag"), F.lit(2).alias("w")))).cast(KIND).alias("_bags"))
    return B.training_rows(df, ["ax"], ["x"], "y", None, ["id"])


def test_no_list_is_null(spark):
    """A run of null lists is written to Arrow in square time; rows of every bag are told by a flag."""
    rows = _rows(spark)
    assert rows.where(F.col("_b").isNull() | F.col("_m").isNull()).count() == 0
    assert rows.where("_every").count() == 200 and rows.where("_every and size(_b) > 0").count() == 0


def test_a_task_holds_few_axis_values(spark):
    """Each axis value is one piece of a task, and tasks share few of them; no row is lost."""
    rows = B.laid_out(_rows(spark), 400)
    parts = [[r["_axt"] for r in part] for part in rows.rdd.glom().collect()]
    pieces = [sum(a != b for a, b in zip([None, *p], p)) for p in parts]
    assert all(k == len(set(p)) for k, p in zip(pieces, parts))
    assert sum(pieces) <= len(parts) + 4 and sum(map(len, parts)) == 400


def test_draws_are_those_of_the_modulus():
    r = np.array([0, 1, 2, B.PRIME - 1, B.PRIME // 2, 12345])
    for a, c in ((1, 0), (B.PRIME - 1, B.PRIME - 1), (99991, 5), (1, B.PRIME - 1)):
        assert (B.row_uniform(r, a, c) == ((a * r + c) % B.PRIME + 0.5) / B.PRIME).all()


def test_paths_end_where_a_walk_ends():
    rng = np.random.default_rng(1)
    x = rng.integers(-1, 9, (3, 500)).astype(np.int8)
    for _ in range(20):
        feat, cut = rng.integers(-1, 3, 16), rng.integers(-1, 8, 16)
        feat[8:] = -1
        got = ends(feat, 3)[paths(feat, cut, x, 3)]
        for i in range(x.shape[1]):
            node = 1
            while feat[node] >= 0:
                node = 2 * node + int(x[feat[node], i] > cut[node])
            assert got[i] == node


def test_packed_rows_are_the_rows(spark):
    """Rows kept as arrays give the same sums, in a few records instead of a record a row; rows of no bag stay out on demand."""
    rows = _rows(spark)
    packed = B.packed(rows, 400, 1)
    assert packed.count() <= 16 + 5 and B.loose(packed, 1).count() == 400

    def add(acc, part, state):
        times = part.dense(len(acc))
        acc += np.column_stack([times.sum(axis=0), times.T @ part.x[:, 0], times.T @ part.y, np.full(len(acc), len(part.y)), times.T @ part.r]).astype(np.int64)

    axes = [str(a) for a in range(5)]
    for some, all_ in ((packed, rows), (B.in_bags(packed), B.in_bags(rows))):
        for first, last in ((0, 3), (1, 2)):
            got, want = (B.summed(r, axes, first, last, 1, 5, add, [None] * 5, np.int64) for r in (some, all_))
            assert (got == want).all() and got[:, 0, 3].sum() == 400


def test_packed_rows_leave_out_rows_of_no_bag(spark):
    rows = _rows(spark).withColumn("_every", F.col("_every") & (F.col("_y") == 0))
    packed = B.packed(rows, 400, 1)
    count = lambda r: B.summed(r, [str(a) for a in range(5)], 0, 2, 1, 1, lambda acc, part, _: acc.__iadd__(len(part.y)), [None] * 5)[:, 0, 0].sum()
    assert count(packed) == 400 and count(B.in_bags(packed)) == count(B.in_bags(rows)) == 200


def test_draws_by_ordinal_are_the_draws(spark):
    """The lists cross once; they are the counts of the draws, whatever the sizes of the axis values."""
    from pubag.operators import sampling as S

    args = (spark, 7, [30, 5], [20, 90], 3, ["ax"], [(4,), (9,)], 2)
    want = {(r.ax, r.pos, r.bag): r.w for r in S.bootstrap_draws(*args).collect()}
    lists = S.bootstrap_lists(*args)
    assert lists._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 0
    got = [(r.ax, r.pos, v) for r in lists.collect() for v in r._drawn]
    assert {(a, p, v // S.TIMES): v % S.TIMES for a, p, v in got} == want and len(got) == len(want)


def test_rows_are_dealt_before_slow_votes(spark):
    """Rows that lie in one partition are scored by all cores."""
    from pubag.operators.bagging import PUBagging
    from pubag.operators.learners import registry

    df = spark.range(0, 60, 1, 1).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"), F.col("id").cast("double").alias("x"))
    m = PUBagging(learner=registry("mlp", hidden=2, steps=1), n_estimators=10, max_samples=5, seed=1).fit(df, ["x"], ["id"])
    parts = [len(p) for p in m.predict_proba(df).rdd.glom().collect()]
    assert sum(parts) == 60 and max(parts) < 30
