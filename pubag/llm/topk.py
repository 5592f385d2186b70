"""Exact top-k inner-product search, term at a time, over integer vectors.

Rows are sparse integer vectors. Candidates and queries are dealt into blocks; a task holds one block of
each, accumulates term by term (the postings of a dimension, scattered with the query's weight into a
dense array of scores), selects each query's best of the block by partition, and the per-block lists are
merged. Every (query, candidate) pair is scored; nothing is broadcast or collected.

Cases: vectors that are null or hold null, NaN or infinite components take no part, nor do rows without an
id. Vectors of different lengths are compared as if padded with zeros. Equal rows (id and vector) are
searched once and returned as often as they occur; each is a candidate for the others. Rows of one id
with different vectors are different rows. Equal scores go to the smaller id. Scores beyond 64 bits stop
at the largest integer. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Rows of a block of candidates and of queries; queries whose scores are held at once.
CANDIDATES, QUERIES, AT_ONCE = 8192, 1024, 128


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of rows with an id and a vector of finite components."""
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))


def distinct_rows(rows: DataFrame) -> DataFrame:
    """(id, vec, h, copies): equal rows once; (id, h) names them."""
    return rows.groupBy("id", "vec").agg(F.count("*").alias("copies")).withColumn("h", F.xxhash64("vec"))


def matrix(vectors: pd.Series, dtype, width: int = 0) -> np.ndarray:
    """Vectors as rows of a matrix, the shorter ones padded with zeros."""
    width = max([width, *(len(v) for v in vectors)])
    out = np.zeros((len(vectors), width), dtype=dtype)
    for k, v in enumerate(vectors):
        out[k, :len(v)] = v
    return out


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Dense scores (queries x candidates), one dimension's postings at a time."""
    bound = int(np.abs(queries).max(initial=0)) * int(np.abs(candidates).max(initial=0)) * max(1, queries.shape[1])
    kind = np.int32 if bound < 1 << 31 else np.int64 if bound < 1 << 62 else object
    queries, candidates = queries.astype(kind), candidates.astype(kind)
    scores = np.zeros((len(queries), len(candidates)), dtype=kind)
    for d in range(queries.shape[1]):
        asks, holds = np.flatnonzero(queries[:, d]), np.flatnonzero(candidates[:, d])
        if 2 * len(holds) > len(candidates):  # a full posting list needs no scatter; its zeros add nothing
            scores += queries[:, d, None] * candidates[None, :, d]
        elif len(asks) and len(holds):
            scores[np.ix_(asks, holds)] += queries[asks, d, None] * candidates[None, holds, d]
    most = (1 << 63) - 1
    return scores.clip(-most, most).astype(np.int64) if kind is object else scores.astype(np.int64)


def select(scores: np.ndarray, k: int) -> np.ndarray:
    """Per row the positions of its ``k`` highest scores, ties to the smaller position, in any order."""
    n = scores.shape[1]
    if n <= k:
        return np.tile(np.arange(n), (len(scores), 1))
    least = np.partition(scores, n - k, axis=1)[:, n - k, None]
    above, equal = scores > least, scores == least
    take = above | equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True))
    return np.nonzero(take)[1].reshape(len(scores), k)


def merged(found: DataFrame, k: int, score_type: str) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best of what the tasks found for each query. ``found`` has one
    row per query and distinct candidate: query_id, qh, asked (times the query occurs), vec_id, score,
    copies (times the candidate counts)."""
    w = W.partitionBy("query_id", "qh").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)
    spread = best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("copies"), F.lit(k)).cast("int"))))
    ranked = spread.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return (ranked.withColumn("ask", F.explode(F.sequence(F.lit(1), F.col("asked").cast("int"))))
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").cast(score_type).alias("score")))


def top_k(rows: DataFrame, is_query, k: int) -> DataFrame:
    """The ``k`` best other rows of every query row of ``rows`` (id, vec: integers); ``is_query`` is a condition on ``id``."""
    rows = distinct_rows(rows)
    n, asked = rows.agg(F.count("*"), F.coalesce(F.sum(is_query.cast("long")), F.lit(0))).first()
    n_c, n_q = max(1, -(-n // CANDIDATES)), max(1, -(-asked // QUERIES))
    own = F.xxhash64("id", "h")
    candidates = (rows.withColumn("c", F.pmod(own, F.lit(n_c)).cast("int"))
                  .withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))).select("c", "q", "id", "h", "vec", "copies"))
    queries = (rows.where(is_query).withColumn("q", F.pmod(own, F.lit(n_q)).cast("int"))
               .withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1)))).select("c", "q", "id", "h", "vec", "copies"))
    names = ["query_id", "qh", "asked", "vec_id", "score", "copies"]

    def search(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(cs):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in names})
        cs = cs.sort_values(["id", "h"]).reset_index(drop=True)
        width = max(len(v) for s in (qs["vec"], cs["vec"]) for v in s)
        held, out = matrix(cs["vec"], np.int64, width), []
        ids, hs, copies = (cs[c].to_numpy() for c in ("id", "h", "copies"))
        for at in range(0, len(qs), AT_ONCE):
            part = qs.iloc[at:at + AT_ONCE]
            scores = accumulate(matrix(part["vec"], np.int64, width), held)
            best = select(scores, min(k + 1, len(cs)))  # one more, as the query's own row may be among them
            qi, qh, qn = (np.repeat(part[c].to_numpy(), best.shape[1]) for c in ("id", "h", "copies"))
            flat = best.ravel()
            times = copies[flat] - ((ids[flat] == qi) & (hs[flat] == qh))
            made = pd.DataFrame(dict(zip(names, (qi, qh, qn, ids[flat], np.take_along_axis(scores, best, axis=1).ravel(), times))))
            out.append(made[made["copies"] > 0])
        return pd.concat(out)

    found = (queries.groupBy("c", "q").cogroup(candidates.groupBy("c", "q"))
             .applyInPandas(search, ", ".join(f"{c} bigint" for c in names)))
    return merged(found, k, "long")
