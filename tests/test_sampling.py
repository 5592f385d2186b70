"""Properties of the exact hash sampling and splitting operators."""

import pytest
from pyspark.sql import functions as F

from pubag.operators import sampling as S
from pubag.operators import relational as R

K = ["doc_id"]


def keys(df, k="doc_id"):
    return {r[0] for r in df.select(k).collect()}


def test_sample_n_exact_subset_and_stable(spark, docs):
    a = S.sample_n(docs, 123, K, 7)
    b = S.sample_n(docs.repartition(5), 123, K, 7)
    assert a.count() == 123
    assert keys(a) <= keys(docs)
    assert keys(a) == keys(b)  # invariant to partitioning


def test_sample_n_bucket_cut_equals_sort(spark, docs):
    a = keys(S.sample_n(docs, 400, K, 3, bits=4))
    b = keys(S.take_n(docs, 400, K, 3))
    assert a == b


def test_sample_n_too_large_raises(spark, docs):
    for n in (10 ** 6, docs.count() + 1, 0, -1):
        with pytest.raises(ValueError):
            S.sample_n(docs, n, K, 1)
    with pytest.raises(ValueError, match="grp"):  # the partition value is named
        S.first_n(docs, 10 ** 5, K, 1, parts=["grp"])
    assert S.first_n(docs, 10 ** 6, K, 1, at_most=True).count() == docs.count()


def test_first_n_of_nothing(spark, docs):
    none = docs.limit(0)
    assert S.first_n(docs, 0, K, 1).count() == 0
    assert S.first_n(none, 0, K, 1).count() == 0
    assert S.first_n(none, 5, K, 1, at_most=True).count() == 0
    assert S.dense_position(none, K, 1).count() == 0
    with pytest.raises(ValueError):
        S.first_n(none, 5, K, 1)
    missing = spark.createDataFrame([("nowhere", 3)], "grp string, n bigint")
    with pytest.raises(ValueError, match="nowhere"):
        S.first_n(docs, missing, K, 1, parts=["grp"])


@pytest.mark.parametrize("bits", [1, 4, 16])
def test_same_rows_for_any_bits_and_partitioning(spark, bits):
    """4,000 rows with two keys: the order among rows of one key is by their content."""
    rows = [(i % 2, i, f"v{i % 7}") for i in range(4000)]
    df = spark.createDataFrame(rows, "k int, i int, v string")
    want = {r.i for r in S.first_n(df, 1500, "k", 3).collect()}
    for n in (1, 5, 13):
        part = df.repartition(n)
        assert {r.i for r in S.first_n(part, 1500, "k", 3, bits=bits).collect()} == want
    pos = {r.i: r.pos for r in S.dense_position(df.repartition(5), "k", 3, "sample").collect()}
    assert sorted(pos.values()) == list(range(4000))
    assert {i for i, p in pos.items() if p < 1500} == want
    assert pos == {r.i: r.pos for r in S.dense_position(df.repartition(3), "k", 3, "sample").collect()}


def test_positions_by_null_and_many_groups(spark):
    rows = [(i, None if i % 5 == 0 else f"g{i % 40}") for i in range(600)]
    df = spark.createDataFrame(rows, "k int, g string")
    got = {}
    for r in S.dense_position(df, "k", 1, parts=["g"]).collect():
        got.setdefault(r.g, []).append(r.pos)
    assert all(sorted(p) == list(range(len(p))) for p in got.values()) and len(got[None]) == 120


def test_subsample_bags_differ_by_bag_axis_and_warm_start(spark, docs):
    u = docs.filter("y = 0").select("doc_id").withColumn("rep", F.explode(F.array(F.lit(0), F.lit(1))))
    sets = {}
    for first in (0, 2):
        for r in S.subsample_members(u, K, 2, 60, 9, axis=["rep"], first_bag=first).collect():
            sets.setdefault((r.rep, r.bag), set()).add(r.doc_id)
    assert len(sets) == 8 and len({frozenset(s) for s in sets.values()}) == 8
    assert all(len(s) == 60 for s in sets.values())


def test_hide_more_than_there_are_raises(spark, docs):
    n = docs.filter("y = 1").count()
    for levels in ([0, 10, 10], [0, n + 1], [-1]):
        with pytest.raises(ValueError):
            S.hide_sweep(docs, levels, K, 4)
    with pytest.raises(ValueError):
        S.hide_labels(docs, n + 1, K, 4)


def test_stratified_split_by_largest_remainder(spark):
    df = spark.createDataFrame([(i, 0 if i < 7 else 1 if i < 14 else 2) for i in range(21)], "k int, y int")
    sizes = {r.y: r.n for r in S.stratified_split(df, "k", 1, 0.2).filter("is_test").groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert sizes == {0: 2, 1: 1, 2: 1}  # 4.2 test rows: 4 in all, 1.33 each


def test_poisson_steps_reach_one():
    for lam in (0.1, 1.0, 30.0):
        steps = S.poisson_cdf(lam)
        assert abs(steps[-1] - 1) < 1e-12 and all(b > a for a, b in zip(steps, steps[1:]))


def test_matched_counts_equal_positives_per_group(spark, docs):
    pos = docs.filter("y = 1")
    m = S.sample_matched(docs.filter("y = 0"), pos, K, 11)
    got = {r["grp"]: r["count"] for r in m.groupBy("grp").count().collect()}
    want = {r["grp"]: r["count"] for r in pos.groupBy("grp").count().collect()}
    assert got == want


def test_dense_position_is_permutation(spark, docs):
    p = S.dense_position(docs, K, 5)
    pos = sorted(r[0] for r in p.select("pos").collect())
    assert pos == list(range(docs.count()))


def test_holdout_disjoint_by_key(spark, docs):
    train, test = S.holdout_n(docs, 20, K, 9)
    assert test.count() == 40
    assert not (keys(train) & keys(test))
    assert train.count() + test.count() == docs.count()


def test_anti_by_key_removes_all_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    held = spark.createDataFrame([(1,)], "k int")
    assert [r.k for r in R.anti_by_key(df, held, "k").collect()] == [2]
    with pytest.raises(KeyError):
        R.anti_by_key(df, spark.createDataFrame([(9,)], "k int"), "k", check_missing=True)


def test_kfold_balanced_per_class(spark, docs):
    f = S.stratified_kfold(docs, K, 2, 5)
    for y in (0, 1):
        sizes = [r["count"] for r in f.filter(F.col("y") == y).groupBy("fold").count().collect()]
        assert max(sizes) - min(sizes) <= 1


def test_hide_sweep_nested(spark, docs):
    sw = S.hide_sweep(docs, [0, 50, 100], K, 4)
    hidden = {lv: keys(sw.filter((F.col("level") == lv) & (F.col("y_true") == 1) & (F.col("y") == 0)))
              for lv in (0, 50, 100)}
    assert len(hidden[0]) == 0 and len(hidden[50]) == 50 and len(hidden[100]) == 100
    assert hidden[50] <= hidden[100]


def test_chunks_last_short(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "k int")
    c = S.chunks(df, "k", 1, 4)
    sizes = sorted(r["count"] for r in c.groupBy("chunk").count().collect())
    assert sizes == [2, 4, 4]


def test_bootstrap_draw_counts(spark):
    d = S.bootstrap_draws(spark, 5, 37, 100, 3)
    tot = {r["bag"]: r["s"] for r in d.groupBy("bag").agg(F.sum("w").alias("s")).collect()}
    assert tot == {b: 37 for b in range(5)}
    # bag b is the same whatever T is (warm start for free)
    d2 = S.bootstrap_draws(spark, 8, 37, 100, 3)
    a = sorted(tuple(r) for r in d.collect())
    b = sorted(tuple(r) for r in d2.filter("bag < 5").collect())
    assert a == b


def test_poisson_weights_mean(spark, docs):
    u = docs.select(F.posexplode(S.poisson_weights(K, 1, 20, 1.0)).alias("b", "w"))
    m = u.agg(F.avg("w")).first()[0]
    assert 0.9 < m < 1.1


def test_feature_bag(spark):
    fb = S.feature_bag(6, 3, 4, 1)
    assert all(len(set(b)) == 3 for b in fb)
    assert S.feature_bag(6, 3, 6, 1)[:4] == fb
    with pytest.raises(ValueError):
        S.feature_bag(6, 7, 1, 1)
