"""Approximate nearest neighbours by shifted space-filling curves.

Each distinct vector is indexed once, with the smallest ids that hold it, as many as an answer can need, and
searched once for all query rows that hold it. Vectors are cut into bands of norm (each twice as long as the
one before). In a band they are scaled to the unit ball and given one more coordinate that makes them unit
vectors, so that the largest inner product is the smallest angle (queries get zero there; in their own band,
on every other curve, they stand where they stand as candidates). Each of ``CURVES`` orderings projects them
on ``DIMS`` random orthogonal directions, replaces each projection by its quantile in the band, shifts the
grid, and sorts by Hilbert key (equal keys in an order of the curve's own), range-partitioned in Spark; the
position in the order comes from partition totals. Candidates form blocks of consecutive keys of a band, and
a query is sent to its block and to the two neighbouring ones. Each block returns its best for the query, scored
on the original vectors in double precision; the lists of all curves and bands are merged.

A block of a band of n rows has ``SCALE`` * n^0.75 rows, so a query meets 48 * SCALE * n^0.75 of them: its share
of the table falls as the table grows, and so does what a neighbour needs to be near, as the nearest rows of a
larger table are nearer. On nearly isotropic data, the worst case, that keeps recall above 0.9 (README has the
figures and what a smaller share would cost). All rows are indexed. A band of at most ``SMALL`` rows is searched
exactly.
Quantiles make a cluster as wide on the grid as its share of the rows, so its inside is ordered too, and a
long vector leaves the grid of the others as it is.

Cases: vectors that are null, zero, or hold null, NaN or infinite components take no part, nor do rows
without an id. Vectors of different lengths are padded with zeros. Equal rows are returned as often as they
occur; rows of one id with different vectors are different rows. Equal scores go to the smaller id: exactly
so among rows of one vector. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pubag.llm.common import ordered_prefix, saved
from pubag.llm.topk import matrix

CURVES, DIMS, BITS, SMALL, SCALE = 16, 10, 6, 2048, 0.25

#: Vectors of a band from which its quantiles are taken (about), quantiles, and rows of one vector that are gathered at once.
SAMPLE, KNOTS, GATHER = 1024, 129, 8192


def block_rows(n: int) -> int:
    """Rows of a block in a band of ``n`` rows."""
    return n if n <= SMALL else -int(-SCALE * n ** 0.75 // 1)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of cell coordinates (below ``2 ** bits``): Gray-code
    rotations from the top bit down, then the coordinates' bits interleaved."""
    x = cells.astype(np.int64).copy()
    dims = x.shape[1]
    for bit in range(bits - 1, 0, -1):
        q, low = 1 << bit, (1 << bit) - 1
        for d in range(dims):
            high = (x[:, d] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] ^= np.where(high, low, swap)
            x[:, d] ^= swap
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    flip = np.zeros(len(x), dtype=np.int64)
    for bit in range(bits - 1, 0, -1):
        flip ^= np.where((x[:, -1] >> bit) & 1, (1 << bit) - 1, 0)
    x ^= flip[:, None]
    key = np.zeros(len(x), dtype=np.int64)
    for bit in range(bits - 1, -1, -1):
        for d in range(dims):
            key = key << 1 | (x[:, d] >> bit) & 1
    return key


def _curve(c: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([7, c])
    return np.linalg.qr(rng.normal(size=(width, min(DIMS, width))))[0], rng.random(min(DIMS, width))


def lifted(x: np.ndarray) -> np.ndarray:
    """Vectors of the unit ball with one more coordinate that makes them unit vectors."""
    return np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))])


def grid(unit: np.ndarray, c: int) -> np.ndarray:
    """Quantiles (``KNOTS`` x dimensions) of the projections of ``unit`` on curve ``c``."""
    return np.quantile(unit @ _curve(c, unit.shape[1])[0], np.linspace(0, 1, KNOTS), axis=0)


def keys(unit: np.ndarray, c: int, knots: np.ndarray) -> np.ndarray:
    """Hilbert keys of unit vectors on curve ``c``: a cell grid over the quantiles ``knots`` of the
    projections, shifted by up to its own width."""
    directions, shift = _curve(c, unit.shape[1])
    at = unit @ directions
    for d in range(at.shape[1]):
        at[:, d] = np.interp(at[:, d], knots[:, d], np.linspace(0, 1, KNOTS))
    return hilbert(np.minimum(((at + shift) / 2 * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def _tie(h: np.ndarray, c: int) -> np.ndarray:
    """Order of equal keys on curve ``c``."""
    x = (h.view(np.uint64) ^ np.uint64(c + 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def distinct_vectors(rows: DataFrame, is_query, most: int) -> DataFrame:
    """(h1, h2, vec, ids, asks): each vector of ``rows`` (id, vec, h1, h2) once, the ``most`` smallest ids of
    its rows (repeated rows repeat theirs), and whether any is a query. Ids are gathered in groups of
    bounded size, so a vector that many rows hold is spread over tasks."""
    least = lambda c: F.slice(F.sort_array(F.flatten(F.collect_list(c))), 1, most)
    out = rows.groupBy("h1", "h2", "id").agg(F.first("vec").alias("vec"), F.count("*").alias("n"))
    out = out.select("h1", "h2", "id", "vec", F.array_repeat("id", F.least(F.col("n"), F.lit(most)).cast("int")).alias("ids"), is_query.alias("asks"))
    out, salts = saved(out, "rows"), 0
    while salts != 1:
        salts = -(-salts // 256) if salts else max(1, -(-out.count() // GATHER))
        salted = out.withColumn("salt", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(salts)))
        out = salted.groupBy("h1", "h2", "salt").agg(F.first("vec").alias("vec"), least("ids").alias("ids"), F.max("asks").alias("asks"))
    return out.select("h1", "h2", "vec", "ids", "asks")


def _positions(vectors: DataFrame, bands: dict[int, tuple], width: int) -> DataFrame:
    """One row per band and curve for each candidate (one = 1, in its own band) and each query (one = 0, in all):
    curve, band, key, tie, asked, h1, h2, one, and the candidates ahead of the band and curve, the last
    block and the rows of a block."""
    names = ["curve", "band", "key", "tie", "asked", "h1", "h2", "one", "start", "last", "size"]
    schema = pa.schema([(c, pa.int64()) for c in names])

    def run(it):
        for batch in it:
            if not batch.num_rows:
                continue
            whole = matrix(batch.column("vec").to_pylist(), np.float64, width)
            norm, own = batch.column("norm").to_numpy(), batch.column("band").to_numpy()
            h1, h2 = batch.column("h1").to_numpy(), batch.column("h2").to_numpy()
            asks = np.flatnonzero(batch.column("asks").to_numpy(zero_copy_only=False).astype(bool))
            flat = np.column_stack([whole[asks] / norm[asks, None], np.zeros(len(asks))])
            for band, (longest, starts, last, size, knots) in bands.items():
                here = np.flatnonzero(own == band)
                unit = lifted(whole[here] / longest)
                inside = own[asks] == band
                lift = flat.copy()
                lift[inside] = lifted(whole[asks[inside]] / longest)
                row, asked = np.concatenate([here, asks]), np.repeat([0, 1], [len(here), len(asks)])
                if not len(row):
                    continue
                for c, start in enumerate(starts):
                    key = keys(np.vstack([unit, lift if c % 2 else flat]), c, knots[c]) if knots else np.zeros(len(row), dtype=np.int64)
                    const = (np.full(len(row), v) for v in (start, last, size))
                    cols = (np.full(len(row), c), np.full(len(row), band), key, _tie(h1[row], c), asked, h1[row], h2[row], 1 - asked, *const)
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in cols], schema=schema)

    return vectors.select("h1", "h2", "vec", "norm", "band", "asks").mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def _bands(vectors: DataFrame) -> tuple[dict[int, tuple], int]:
    """Per band: its longest norm, the candidates ahead of it on each curve, its last block, the rows of a
    block, and the quantiles of each curve (none for one block, which needs one curve);
    and the number of components. There are at most as many bands as exponents of a norm."""
    found = vectors.groupBy("band").agg(F.count("*").alias("n"), F.max("norm").alias("longest"), F.max(F.size("vec")).alias("width")).orderBy("band").collect()
    width = max((r.width for r in found), default=1)
    large = {r.band: r for r in found if r.n > SMALL}
    picked: dict[int, list] = {b: [] for b in large}
    if large:
        share = F.coalesce(*(F.when(F.col("band") == b, F.lit(min(1 << 20, -(-(SAMPLE << 20) // r.n)))) for b, r in large.items()))
        for r in vectors.where(F.pmod("h1", F.lit(1 << 20)) < share).select("band", "vec").toLocalIterator():
            picked[r.band].append(np.array(r.vec, dtype=np.float64))
    curves, ahead, out = [{} for _ in range(CURVES)], 0, {}
    for c in range(CURVES):
        for r in found:
            if c == 0 or r.band in large:
                curves[c][r.band], ahead = ahead, ahead + r.n
    for r in found:
        knots = None
        if r.band in large:
            unit = lifted(matrix(picked[r.band], np.float64, width) / r.longest)
            knots = [grid(unit, c) for c in range(CURVES)]
        starts = [x[r.band] for x in curves if r.band in x]
        out[r.band] = (r.longest, starts, -(-r.n // block_rows(r.n)) - 1, block_rows(r.n), knots)
    return out, width


def nearest(rows: DataFrame, is_query, k: int) -> DataFrame:
    """The ``k`` nearest other rows found for every query row of ``rows`` (id, vec: finite components);
    ``is_query`` is a condition on ``id``."""
    square = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = (rows.where(F.exists("vec", lambda x: x != 0))
            .select("id", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2")))
    vectors = distinct_vectors(rows, is_query, k + 1).withColumn("norm", F.sqrt(square(F.col("vec"))))
    vectors = saved(vectors.withColumn("band", F.floor(F.log2("norm") + 0.5)), "vectors")
    bands, width = _bands(vectors)
    order = ["curve", "band", "key", "tie", "asked", "h1", "h2"]
    placed = ordered_prefix(_positions(vectors, bands, width), order, "one")
    at = F.floor((F.col("before") - F.col("start")) / F.col("size"))
    lo = F.greatest(F.lit(0), F.least(at - 1, F.col("last") - 2))
    span = F.sequence(lo, F.least(F.col("last"), lo + 2))
    place = ["curve", "band", "block"]
    candidates = placed.where("asked = 0").select("curve", "band", at.alias("block"), "h1", "h2").join(vectors.select("h1", "h2", "vec", "ids"), ["h1", "h2"])
    candidates = candidates.select(*(F.col(c).alias(f"c_{c}") for c in (*place, "h1", "h2", "vec", "ids")))
    queries = (placed.where("asked = 1").select("curve", "band", span.alias("blocks"), "h1", "h2").join(vectors.select("h1", "h2", "vec"), ["h1", "h2"])
               .withColumn("block", F.explode("blocks")).select(*place, "h1", "h2", "vec"))
    names = ["qh1", "qh2", "vh1", "vh2", "nth", "vec_id", "score"]

    def search(qs: pd.DataFrame, cs: pd.DataFrame) -> pd.DataFrame:
        out, cs = [], cs.rename(columns=lambda c: c.removeprefix("c_"))
        if len(qs) and len(cs):
            held, h1, h2 = matrix(cs["vec"], np.float64, width), cs["h1"].to_numpy(), cs["h2"].to_numpy()
            ids, counts = np.concatenate(cs["ids"].tolist()), cs["ids"].map(len).to_numpy()
            first = np.cumsum(counts) - counts
            for start in range(0, len(qs), 256):
                part = qs.iloc[start:start + 256]
                asks = matrix(part["vec"], np.float64, width)
                near = asks @ held.T
                m = min(k + 1, near.shape[1])  # one more, as the query's own row may be among them
                # a product over a block may differ in the last bit from the one over a row: take all near the
                # last, then score them row by row
                least = np.partition(near, -m, axis=1)[:, -m]
                least = least - 1e-9 * np.maximum(1, np.abs(least))
                for i, (q1, q2) in enumerate(zip(part["h1"].tolist(), part["h2"].tolist())):
                    pick = np.flatnonzero(near[i] >= least[i])
                    score, n = (held[pick] * asks[i]).sum(axis=1), counts[pick]
                    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    pick, score = np.repeat(pick, n), np.repeat(score, n)
                    vec_id = ids[first[pick] + nth]
                    best = np.lexsort((vec_id, -score))[:k + 1]
                    pick = pick[best]
                    out.append((np.full(len(pick), q1), np.full(len(pick), q2), h1[pick], h2[pick], nth[best], vec_id[best], score[best]))
        made = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0)] * len(names)
        return pd.DataFrame({c: v.astype("float64" if c == "score" else "int64") for c, v in zip(names, made)})

    ddl = ", ".join(f"{c} {'double' if c == 'score' else 'bigint'}" for c in names)
    found = queries.groupBy(*place).cogroup(candidates.groupBy(*(f"c_{c}" for c in place))).applyInPandas(search, ddl)
    once = found.groupBy(*names[:-1]).agg(F.max("score").alias("score"))
    w = W.partitionBy("qh1", "qh2").orderBy(F.desc("score"), "vec_id", "vh1", "vh2", "nth")
    best = once.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k + 1)
    own = ((F.col("vh1") == F.col("qh1")) & (F.col("vh2") == F.col("qh2"))).alias("own")
    lists = saved(best.groupBy("qh1", "qh2").agg(F.sort_array(F.collect_list(F.struct("rn", "vec_id", "score", own))).alias("best")), "lists")
    # of the list of a vector, each of its rows takes all but itself
    asked = rows.where(is_query).select("id", "h1", "h2").join(lists, (F.col("h1") == F.col("qh1")) & (F.col("h2") == F.col("qh2")))
    asked = asked.withColumn("self", F.expr("array_position(transform(best, x -> x.own AND x.vec_id = id), true)"))
    others = asked.select(F.col("id").alias("query_id"), F.posexplode(F.expr(f"slice(filter(best, (x, i) -> i + 1 <> self), 1, {int(k)})")).alias("at", "x"))
    return others.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
