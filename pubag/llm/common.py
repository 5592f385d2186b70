"""Shared helpers: table access, stage tables in the shared folder, bounded Arrow output, ordered prefix sums."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pubag.session import checkpoint_dir

#: Documents without an id sort after all others; inside the operators they carry this id.
NO_ID = (1 << 63) - 1

#: Bytes of text after which an operator hands an output batch back to Spark.
BATCH_BYTES = 8 << 20

SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared checkpoint folder and read back: cuts the lineage,
    survives lost executors and is computed once. A new folder each time."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/pubag-llm/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def doc_key(col: str = "doc_id") -> F.Column:
    return F.coalesce(F.col(col), F.lit(NO_ID))


def no_key(col: F.Column) -> F.Column:
    """Inverse of :func:`doc_key`."""
    return F.when(col != F.lit(NO_ID), col)


def batches(rows: Iterable[tuple], schema: pa.Schema, weight=None, most: int = 4096) -> Iterator[pa.RecordBatch]:
    """Row tuples to record batches of at most ``most`` rows and about ``BATCH_BYTES`` of ``weight(row)``."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += weight(row) if weight else 0
        if len(out) >= most or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def id_and_text(it: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(id, text) of batches whose first two columns these are, in slices that keep Python's copies small."""
    for batch in it:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist())


def blocks(rows: Iterable[tuple], most: int) -> Iterator[tuple[list, list]]:
    """(ids, texts) of up to ``most`` rows and about ``BATCH_BYTES`` of text together."""
    ids, texts, size = [], [], 0
    for i, text in rows:
        ids.append(i)
        texts.append(text)
        size += len(text or "")
        if len(ids) >= most or size >= BATCH_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def ordered_prefix(df: DataFrame, order: list[str], value: str, partitions: int | None = None) -> DataFrame:
    """Adds ``row_no`` (from 0) and ``before`` (sum of ``value`` over the rows ahead) in the global order
    of ``order``, without a window over all rows: range partitions, one total per partition, then a
    window inside each. ``order`` must identify rows."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = saved(df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()), "ranges")
    totals = parts.groupBy("_p").agg(F.count("*").alias("_n"), F.sum(value).alias("_v"))
    # one row per range partition, so at most as many rows as the session has shuffle partitions
    ahead = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select("_p", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_n0"),
                           F.coalesce(F.sum("_v").over(ahead), F.lit(0)).alias("_v0"))
    w = W.partitionBy("_p").orderBy(*order)
    inside = w.rowsBetween(W.unboundedPreceding, -1)
    return (parts.join(F.broadcast(totals), "_p")
            .withColumn("row_no", F.col("_n0") + F.row_number().over(w) - 1)
            .withColumn("before", F.col("_v0") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .drop("_p", "_n0", "_v0"))
