"""Connected components of an edge table by hooking, pointer jumping and contraction, on the executors only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubag.llm.common import saved


def _some(df: DataFrame) -> bool:
    return df.limit(1).count() > 0


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): for every node of ``edges`` (a, b) the smallest node that it reaches.

    Each round points every node to its smallest neighbour, follows the pointers to their ends (half the
    way is left after each jump) and contracts the edges to the ends that they connect, so the next round
    sees only edges between groups: stars are done in one round, chains and rings in few. All tables stay
    in the shared folder; the driver sees only whether anything is left. No edges give no rows.
    """
    cur = saved(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    result = None
    while result is None or _some(cur):
        both = cur.union(cur.select("b", "a"))
        ends = saved(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "pointers")
        while True:
            step = ends.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
            ends = saved(ends.join(step, "comp").select("node", F.col("far").alias("comp"), (F.col("far") < F.col("comp")).alias("moved")), "pointers")
            if not _some(ends.where("moved")):
                break
            ends = ends.drop("moved")
        ends = ends.drop("moved")
        at = lambda c: ends.select(F.col("node").alias(c), F.col("comp").alias(f"to_{c}"))  # noqa: E731, B023
        left = cur.join(at("a"), "a").join(at("b"), "b").where("to_a <> to_b")
        cur = saved(left.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
        if result is None:
            result = ends
        else:
            result = result.join(ends.select(F.col("node").alias("comp"), F.col("comp").alias("far")), "comp", "left")
            result = result.select("node", F.coalesce("far", "comp").alias("comp"))
    return result
