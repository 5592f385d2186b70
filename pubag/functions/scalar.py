"""Scalar helpers (SC5, SC6) and parameter validation (SC8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_ratio(a, b) -> Column:
    """SC5: a / b, NULL when b = 0 (the reference's 0/0 -> NaN without warnings)."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.try_divide(a.cast("double"), b.cast("double"))


def log_proba(p) -> Column:
    """SC6: ln(p); p = 0 gives NULL (documented stand-in for -inf)."""
    p = F.col(p) if isinstance(p, str) else p
    return F.when(p > 0, F.log(p))


def validate_features(df: DataFrame, needed: list[str]) -> None:
    """SC8: rows to predict must have the columns that the model was fitted on."""
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"the rows lack {len(missing)} of the model's {len(needed)} columns: {missing}")


def check_warm_start(n_old: int, n_new: int) -> int:
    """SC8 / PU10: number of bags to add; fewer than fitted is an error, equal is a no-op."""
    if n_new < n_old:
        raise ValueError(f"a warm start cannot go from {n_old} bags to {n_new}")
    return n_new - n_old
