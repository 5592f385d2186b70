"""Projections, filters, joins, set operations and aggregates (PR, FI, JO, SE, AG).

These are the table operations the reference performs with pandas index
alignment, written as the DataFrame operations a Spark user would write:
named columns instead of positions, joins on a key column instead of index
labels, one aggregate instead of repeated passes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubag.functions.hashing import as_list

# --- PR: projections -----------------------------------------------------------


def feature_columns(df: DataFrame, key, label: str = "y", exclude=()) -> list[str]:
    """All columns but key, label and the excluded ones (the reference's implicit feature list)."""
    drop = set(as_list(key)) | {label} | set(exclude)
    return [c for c in df.columns if c not in drop]


def select_feature(df: DataFrame, features: list[str], i: int, label: str = "y", key=()) -> DataFrame:
    """PR1: one feature by position plus the label."""
    return df.select(*as_list(key), features[i], label)


def feature_slice(df: DataFrame, lo: int, hi: int) -> DataFrame:
    """PR2: columns [lo, hi) by position."""
    return df.select(*df.columns[lo:hi])


def drop_columns(df: DataFrame, cols) -> DataFrame:
    """PR3."""
    return df.drop(*as_list(cols))


def feature_sets(base: list[str], new: list[str]) -> dict[str, list[str]]:
    """PR5: the ablation variants: only the new feature(s), the base set, both."""
    return {"F1": list(new), f"F{len(base)}": list(base), f"F{len(base) + len(new)}": list(base) + list(new)}


def with_label(df: DataFrame, value: int, label: str = "y") -> DataFrame:
    """PR6: assign a constant label (pseudo-positives)."""
    return df.withColumn(label, F.lit(int(value)).cast("int"))


def to_vector(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    """PR9: feature vector column for MLlib learners (nulls kept as NaN)."""
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)


# --- FI: filters -----------------------------------------------------------------


def split_pu(df: DataFrame, label: str = "y") -> tuple[DataFrame, DataFrame]:
    """FI1: P = y == 1, U = y < 1."""
    return df.filter(F.col(label) == 1), df.filter(F.col(label) < 1)


def reliable_negatives(scores: DataFrame, lo: float, score: str = "score") -> DataFrame:
    """FI2: strictly below the threshold."""
    return scores.filter(F.col(score) < F.lit(float(lo)))


def pseudo_positives(scores: DataFrame, hi: float, score: str = "score") -> DataFrame:
    """FI3: strictly above the threshold (a score equal to it is in neither class)."""
    return scores.filter(F.col(score) > F.lit(float(hi)))


def class_filter(df: DataFrame, value: int, label: str = "y") -> DataFrame:
    """FI4."""
    return df.filter(F.col(label) == int(value))


def background_only(scores: DataFrame, label: str = "y") -> DataFrame:
    """FI5: the unlabelled block (what the reference's positional tail means)."""
    return scores.filter(F.col(label) == 0)


# --- JO: joins -------------------------------------------------------------------


def anti_by_key(df: DataFrame, held: DataFrame, key, check_missing: bool = False) -> DataFrame:
    """JO1: remove every row whose key is in ``held`` (duplicates included).

    With ``check_missing`` a key of ``held`` absent from ``df`` raises, as the
    reference's label drop does (one reverse anti-join, limited to one row).
    """
    key = as_list(key)
    keys = held.select(*key)
    if check_missing:
        miss = keys.join(df.select(*key), key, "left_anti").limit(1).collect()
        if miss:
            raise KeyError(f"{miss[0].asDict()} not found in axis")
    return df.join(keys, key, "left_anti")


def semi_by_key(df: DataFrame, keys: DataFrame, key) -> DataFrame:
    """JO2: rows whose key occurs in ``keys``."""
    return df.join(keys.select(*as_list(key)), as_list(key), "left_semi")


def pair_groups(pos_counts: DataFrame, neg: DataFrame, group: str = "grp") -> DataFrame:
    """JO5: i-th positive table with i-th negative table = equi-join on the group column."""
    return neg.join(pos_counts, group)


def score_features(scores: DataFrame, features: DataFrame, key) -> DataFrame:
    """JO8: attach the score table to the feature table by key (AQE picks the strategy)."""
    return features.join(scores, as_list(key))


def attach_truth(pred: DataFrame, orig: DataFrame, key, label: str = "y", name: str = "y_true") -> DataFrame:
    """JO9: evaluate against the labels kept before hiding."""
    return pred.join(orig.select(*as_list(key), F.col(label).alias(name)), as_list(key))


def threshold_cells(values: list[float]) -> list[tuple[int, int, float, float]]:
    """JO7: (i, j, lo, hi) with lo <= hi from one threshold list (45 cells for 9 values)."""
    return [(i, j, float(values[i]), float(values[j])) for i in range(len(values)) for j in range(i, len(values))]


# --- SE: set operations ------------------------------------------------------------


def union_tables(dfs: list[DataFrame]) -> DataFrame:
    """SE1: stack by column name; missing columns become null; duplicates kept."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def build_training(pos: DataFrame, neg: DataFrame) -> DataFrame:
    """SE2: positives then negatives."""
    return pos.unionByName(neg, allowMissingColumns=True)


def augment_positives(pos: DataFrame, pseudo: DataFrame, label: str = "y") -> DataFrame:
    """SE3: known positives plus relabelled background (PR6 on the pseudo rows)."""
    return pos.unionByName(with_label(pseudo, 1, label), allowMissingColumns=True)


def missing_classes(all_classes: DataFrame, seen: DataFrame, col: str = "cls") -> DataFrame:
    """SE4: class codes not seen."""
    return all_classes.select(col).exceptAll(seen.select(col))


def complement(df: DataFrame, members: DataFrame, key) -> DataFrame:
    """SE5: rows not in the member set (not in the bag / chunk)."""
    return df.join(members.select(*as_list(key)), as_list(key), "left_anti")


# --- AG: aggregates ----------------------------------------------------------------


def class_counts(df: DataFrame, label: str = "y", parts=()) -> DataFrame:
    """AG3."""
    return df.groupBy(*parts, label).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def positive_count(df: DataFrame, label: str = "y", parts=()) -> DataFrame:
    """AG4: sum(y), the per-bag draw size of the experiments (max_samples = |P|)."""
    return df.groupBy(*parts).agg(F.sum(F.col(label)).cast("bigint").alias("n_pos"))


def draw_counts(draws: DataFrame, universe: DataFrame, key, n_bags: int) -> DataFrame:
    """AG5: multiplicity of each row in each bag, zero if absent (dense bincount form).

    The bag ids are the driver-side range 0..T-1, so rows are replicated by
    ``explode`` (T per row), never by a join of two tables.
    """
    key = as_list(key)
    cnt = draws.groupBy("bag", *key).agg(F.count(F.lit(1)).cast("int").alias("w"))
    grid = universe.select(*key).withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(n_bags - 1))))
    return grid.join(cnt, ["bag", *key], "left").withColumn("w", F.coalesce(F.col("w"), F.lit(0)))


def class_domain(df: DataFrame, label: str = "cls") -> DataFrame:
    """AG6: sorted distinct labels with dense codes 0..k-1 (k is small by definition)."""
    from pyspark.sql import Window

    d = df.select(label).distinct()
    return d.withColumn("code", (F.row_number().over(Window.orderBy(label)) - 1).cast("int"))


def mean_prediction(preds: DataFrame, universe: DataFrame, key, value: str = "p") -> DataFrame:
    """AG7: per key the mean of the collected predictions, 0.0 when there is none."""
    key = as_list(key)
    m = preds.groupBy(*key).agg(F.avg(value).alias("score"), F.count(F.lit(1)).cast("int").alias("n_votes"))
    return (universe.select(*key).join(m, key, "left")
            .withColumn("score", F.coalesce(F.col("score"), F.lit(0.0)))
            .withColumn("n_votes", F.coalesce(F.col("n_votes"), F.lit(0))))


def repeat_mean(long: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """AG12 / AG13: mean over repeats (and folds) per row label."""
    return long.groupBy(*by).agg(F.avg(value).alias(value))


def result_matrix(long: DataFrame, row: str, col: str, value: str, col_values: list | None = None) -> DataFrame:
    """AG15 / IO5: rows x columns of a metric (pivot over a known, small column list)."""
    g = long.groupBy(row)
    g = g.pivot(col, col_values) if col_values is not None else g.pivot(col)
    return g.agg(F.first(value))
