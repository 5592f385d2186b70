"""Shared parameters and helpers of the registered queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default seed, ensemble size and draw size of the checked queries.
SEED = 42
T_OOB = 100
M_OOB = 100
T_SMALL = 10


def n_pos(df) -> int:
    """Number of positives, of which the experiments' sizes are shares."""
    return df.filter(F.col("y") == 1).count()


def r6(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


def with_sql(prefix_ctes: list[str], body: str) -> str:
    return "WITH " + ",\n".join(prefix_ctes) + "\n" + body
