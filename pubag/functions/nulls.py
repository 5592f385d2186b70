"""Missing-value policies (SC1-SC3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_same(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", large: bool = False) -> DataFrame:
    """Join on equal values of ``on`` where null equals null; the columns of ``left``, then the others of ``right``.
    ``large``: ``right`` grows with the rows and is never gathered on the driver to be sent to all tasks, whatever size Spark
    takes it to have (rows that Python makes of a few others count as few)."""
    renamed = right.select(*[F.col(c).alias(f"_same{i}") for i, c in enumerate(on)], *[c for c in right.columns if c not in on])
    if large:
        renamed = renamed.hint("merge")
    cond = F.lit(True)
    for i, c in enumerate(on):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_same{i}"))
    return left.join(renamed, cond, how).drop(*[f"_same{i}" for i in range(len(on))])


def fill_zero(df: DataFrame, features: list[str]) -> DataFrame:
    """SC1: null -> 0.0 in every feature column."""
    return df.fillna(0.0, subset=list(features))


def class_means(df: DataFrame, features: list[str], label: str = "y", parts=()) -> DataFrame:
    """AG1: per class (and per partition value) the mean of each feature, nulls ignored."""
    return df.groupBy(*parts, label).agg(*[F.avg(c).alias(f"mean_{c}") for c in features])


def fill_class_mean(df: DataFrame, features: list[str], label: str = "y", parts=()) -> DataFrame:
    """SC2: null -> mean of that column within the same class (the reference's leaky fill).

    The class-mean table has one row per class (x partition value).
    A feature that is null for a whole class stays null.
    """
    parts = list(parts)
    means = class_means(df, features, label, parts)
    j = join_same(df, means, [*parts, label])
    out = j
    for c in features:
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"mean_{c}")))
    return out.drop(*[f"mean_{c}" for c in features])


def keep_null(df: DataFrame, features: list[str]) -> DataFrame:
    """SC3: no fill; learners route nulls themselves (GNB skips them, trees give them a bin)."""
    return df
