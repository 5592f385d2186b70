"""A group of identical copies holding a large share of the rows."""

from pyspark.sql import functions as F

from pubag.operators import sampling as S


def test_hot_copies_sample_and_positions(spark):
    base = spark.range(300).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    hot = spark.range(200).select(F.lit(1000).cast("bigint").alias("k"), F.lit("hot").alias("v"))
    df = base.unionByName(hot)
    for n in (1, 50, 299, 350, 499):
        assert S.sample_n(df, n, "k", 3, bits=2).count() == n
    pos = S.dense_position(df, "k", 3).collect()
    assert sorted(r.pos for r in pos) == list(range(500))
    copies = sorted(r.pos for r in pos if r.k == 1000)
    assert copies == list(range(copies[0], copies[0] + 200))  # copies are consecutive


def test_hot_copies_spread_over_tasks(spark):
    """Nine tenths of the rows are one row: its copies still go to several range partitions."""
    one = spark.range(90_000).select(F.lit(7).cast("bigint").alias("k"))
    df = one.unionByName(spark.range(10_000).select((F.col("id") + 100).alias("k")))
    p = S.dense_position(df.repartition(8), "k", 3)
    assert p.agg(F.countDistinct("pos"), F.max("pos")).first() == (100_000, 99_999)
    spread = df.repartition(8)
    spread = S.with_hash(spread, "k", 3, "pos").withColumn("_rid", F.monotonically_increasing_id()).repartitionByRange(8, "_h", "k", "_rid")
    sizes = [r.n for r in spread.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 30_000
