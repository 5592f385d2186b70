"""What the driver must not hold: tables that grow with the rows are never gathered there to be sent to all tasks."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from pubag.operators import bagging
from pubag.operators.learners import bag_sums as B
from pubag.operators.learners import tree, tree_ensembles


@pytest.mark.parametrize("bootstrap", [True, False])
def test_draws_are_not_sent_by_the_driver(spark, monkeypatch, bootstrap):
    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().sparkPlan().toString())
        return df

    df = spark.range(0, 400, 1, 4).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"), (F.col("id") % 7).cast("double").alias("x"))
    monkeypatch.setattr(bagging, "kept", kept)
    m = bagging.PUBagging(n_estimators=5, max_samples=200, seed=1, bootstrap=bootstrap, oob_score=False).fit(df, ["x"], "id")
    joins = [p for p in plans if "_drawn" in p]
    assert joins and all("BroadcastHashJoin" not in p.split("_drawn")[0] and "SortMergeJoin" in p for p in joins)
    assert m.members().groupBy("bag").agg(F.sum("w").alias("w")).collect() and m.members().agg(F.sum("w")).first()[0] == 1000


def _grown(monkeypatch, models, split_bytes):
    depth, d, nb = 4, 6, 32

    def summed(rows, axes, first, last, d, size, add, state, **_):
        return np.random.default_rng(size).integers(0, 50, (len(axes), last - first, size)).astype(float)

    monkeypatch.setattr(B, "in_bags", lambda rows: rows)
    monkeypatch.setattr(B, "summed", summed)
    monkeypatch.setattr(tree, "SPLIT_BYTES", split_bytes)
    return tree.grow(None, ["0"], d, 0, models, 1, depth, tree.Bins(nb, np.zeros(d), np.ones(d), None), None, [None], np.ones((models, d), dtype=bool),
                     np.ones(models), np.full(models, depth))


def test_splits_are_the_same_in_parts(monkeypatch):
    one, many = (_grown(monkeypatch, 7, n) for n in (1 << 30, 1))
    assert (one[0] >= 0).any() and all(np.array_equal(a, b, equal_nan=True) for a, b in zip(one, many))


def test_growing_trees_holds_a_few_times_its_histograms(monkeypatch):
    models, largest = 1500, 1500 * 4 * 6 * 33 * 2 * 8
    tracemalloc.start()
    _grown(monkeypatch, models, tree.SPLIT_BYTES)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 * largest


def test_model_tables_are_made_of_parts_of_bounded_bytes(spark, monkeypatch):
    learner, given = tree_ensembles.Forest(n_trees=10), []
    plain = spark.createDataFrame

    def create(data, schema):
        given.append(len(data))
        return plain(data, schema)

    nodes = 2 ** (learner.max_depth + 1)
    trees = [(t, 1.0, [-1] * nodes, [-1] * nodes, [0.5] * nodes) for t in range(10)]
    found = ((0, b, trees, [0.0] * 2, [1.0] * 2, [[], []]) for b in range(1000))
    rows = plain([(0,)], "a int")
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, schema=None: create(data, schema))
    table = bagging._model_table(spark, learner, rows, ["a"], [(0,)], found, {b: [1, 1] for b in range(1000)})
    monkeypatch.undo()
    assert table.count() == sum(given) == 1000 and max(given) * learner.model_bytes(2) <= bagging.BYTES_AT_ONCE
