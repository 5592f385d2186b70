"""Sources and sinks (IO1-IO6).

Feature tables are read with an explicit schema (never inferred), group files
are read in one multi-path scan with the file name joined to the manifest, and
results are written as Parquet/CSV tables. Model tables are small and written
with one folder per repeat.
"""

from __future__ import annotations

import json
import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pubag.session import checkpoint_dir


def feature_schema(key: str, features: list[str], label: str | None = "Score") -> T.StructType:
    fields = [T.StructField(key, T.StringType(), True)]
    fields += [T.StructField(f, T.DoubleType(), True) for f in features]
    if label:
        fields.append(T.StructField(label, T.IntegerType(), True))
    return T.StructType(fields)


def read_features(spark: SparkSession, path, schema: T.StructType | None = None, fmt: str | None = None) -> DataFrame:
    """IO1: CSV with header (first column = key, blanks = null) or Parquet."""
    paths = [path] if isinstance(path, str) else list(path)
    fmt = fmt or ("parquet" if paths[0].rstrip("/").endswith(".parquet") else "csv")
    if fmt == "parquet":
        df = spark.read.parquet(*paths)
        return df.select(*[f.name for f in schema.fields]) if schema else df
    r = spark.read.option("header", True).option("nullValue", "")  # a blank field is null
    if schema is None:
        raise ValueError("CSV feature tables need an explicit schema")
    return r.schema(schema).csv(paths)


def read_manifest(spark: SparkSession, pos_list: str, neg_list: str) -> DataFrame:
    """IO2: two headerless one-column lists of files, paired by line number -> (group, role, file)."""
    def lines(path: str, role: str) -> DataFrame:
        # a manifest is a handful of lines: read them in file order and number them
        rows = [r["value"].strip() for r in spark.read.text(path).collect() if r["value"].strip()]
        return spark.createDataFrame([(f, i, role) for i, f in enumerate(rows)], "file string, group_idx int, role string")

    return lines(pos_list, "pos").unionByName(lines(neg_list, "neg"))


def _qualified(spark: SparkSession, path: str) -> str:
    """The path as Spark names files in it (scheme and all, not URL-encoded)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def read_groups(spark: SparkSession, manifest: DataFrame, schema: T.StructType, base_dir: str = "",
                group_names: list[str] | None = None, fmt: str | None = None) -> DataFrame:
    """IO2 + SE1: every listed file (or folder of files) in one scan; group and role from the file name.

    A row is matched by the whole path of the listed entry that holds its file; a row that
    belongs to no entry is an error."""
    files = [(r["file"], r["group_idx"], r["role"]) for r in manifest.collect()]  # manifest lines only
    paths = [_qualified(spark, os.path.join(base_dir, f)) for f, _, _ in files]
    df = read_features(spark, paths, schema, fmt=fmt)
    m = spark.createDataFrame([(p, g, r) for p, (_, g, r) in zip(paths, files)], "_path string, group_idx int, role string")
    # paths read as local files lose the slashes of an empty authority; + stays + in a file name
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    own = plain(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))))
    depth = F.lit(None).cast("string")
    for k in sorted({p.count("/") - p.startswith("file:///") * 2 for p in paths}):
        at = F.substring_index(own, "/", k + 1)
        depth = F.coalesce(F.when(at.isin([_plain(p) for p in paths]), at), depth)
    out = df.withColumn("_path", F.coalesce(depth, F.raise_error(F.concat(F.lit("no manifest line for "), own))))
    out = out.join(m.withColumn("_path", plain(F.col("_path"))), "_path").drop("_path")
    if group_names:
        names = F.element_at(F.array(*[F.lit(n) for n in group_names]), F.col("group_idx") + 1)
        out = out.withColumn("grp", names)
    return out


def _plain(path: str) -> str:
    return re.sub("^file:/+", "file:/", path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location (never machine-local on a cluster)."""
    return os.path.join(checkpoint_dir(spark), "pubag-out", f"{name}-{uuid.uuid4().hex[:12]}")


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """IO3: write a table (key kept as a column)."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)
    return path


def write_scores(df: DataFrame, key, score: str, path: str, fmt: str = "csv") -> str:
    """IO4: key and score columns, header line, one row per key."""
    keys = [key] if isinstance(key, str) else list(key)
    return write_table(df.select(*keys, score), path, fmt)


def write_matrix(long: DataFrame, row: str, col: str, value: str, path: str, col_values: list | None = None,
                 fmt: str = "csv") -> str:
    """IO5: pivot a long result table to a labelled matrix and write it."""
    from pubag.operators.relational import result_matrix

    return write_table(result_matrix(long, row, col, value, col_values).orderBy(row), path, fmt)


def save_model(models: DataFrame, path: str, partition_by: str | None = None) -> str:
    """IO6: persist fitted model tables (one folder per repeat when partitioned)."""
    w = models.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    return path


def load_model(spark: SparkSession, path: str, repeats: list[int] | None = None,
               partition_by: str = "repeat") -> DataFrame:
    """IO6: read model tables back; a repeat whose folder is missing is reported and skipped."""
    df = spark.read.parquet(path)
    if repeats is None:
        return df
    have = {r[0] for r in df.select(partition_by).distinct().collect()}
    for r in repeats:
        if r not in have:
            print(f"Model file for {partition_by}={r} not found.")
    return df.filter(F.col(partition_by).isin([r for r in repeats if r in have]))


def save_ensemble(model, path: str) -> str:
    """IO6: a fitted ensemble: its model table and, as one JSON line, what prediction needs to know."""
    kind = {k: v for k, v in vars(model.learner).items()}
    about = {"learner": model.learner.name, "params": kind, "features": model.features, "key": model.key, "label": model.label,
             "axis": model.axis, "user_axis": model.user_axis, "n_estimators": model.n_estimators, "mode": model.mode,
             "first_bag": model.first_bag, "estimators_features_": model.estimators_features_, "n_axis": max(1, len(model.counts))}
    if model.ext_models is not None:
        raise ValueError("ensembles of external learners cannot be saved")
    spark = model.models.sparkSession
    model.models.write.mode("overwrite").parquet(os.path.join(path, "models"))
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(os.path.join(path, "about"))
    return path


def load_ensemble(spark: SparkSession, path: str):
    """IO6: the ensemble saved at ``path``; it predicts as before (out-of-bag scores need the training rows)."""
    from pubag.operators.bagging import PUModel
    from pubag.operators.learners import registry

    about = json.loads(spark.read.text(os.path.join(path, "about")).first()[0])
    models = spark.read.parquet(os.path.join(path, "models"))
    learner = registry(about.pop("learner"), **about.pop("params"))
    n_axis = about.pop("n_axis")
    return PUModel(learner=learner, models=models, rows_u=None, rows_p=None, seed=None, counts=[{}] * n_axis, **about)
