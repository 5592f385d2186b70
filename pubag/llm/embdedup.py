"""Near-duplicate embeddings: int8 tile products with rigorous error bounds, exact where they cannot decide.

Every distinct vector is one class. Classes are dealt into blocks by hash and every pair of blocks is one cell;
a task holds the two blocks of a cell. There each vector u of norm 1 becomes int8 steps q of its own scale s,
with e = |u - s q| and m = |s q|; for two vectors |u.v - s s' q.q'| <= m e' + e. Tiles of q.q' are whole numbers
and therefore exact. A pair whose product plus bound stays below the threshold is not a link, one whose product
less bound reaches it is, and only the others are computed again on the original vectors in double precision.

A cell returns one row per vector with links: how many rows it is linked with, and the vector that stands for
its group inside the cell. So a group of m near copies costs m rows a cell, not m * m pairs; the exact copies of
a vector are counted by their number and never compared. Links add up over cells, and the components of the
representatives are those of the links. Nothing is broadcast or collected.

Every pair of distinct vectors is compared: work grows with the square of their number, and the rows sent with
(distinct vectors)^2 / ``block_rows``.

Cases: vectors that are null, zero or hold null, NaN or infinite components link with nothing and are their own
component. Shorter vectors are padded with zeros. Repeated rows are links of each other; rows of one id with
different vectors are different rows. Rows without an id take part; a component's id is its smallest one, null
only if no row of it has any, and a row is kept if its id is the component's (both null included). An empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubag.llm.common import saved
from pubag.llm.components import components

#: Bytes of a block of vectors (as 4-byte numbers), least number of blocks, rows of a tile, numbers of a chunk of exact products.
BLOCK_BYTES, LEAST_BLOCKS, TILE, CHUNK = 4 << 20, 4, 1024, 1 << 22

#: Added to every bound for the rounding of norms and products in doubles.
SLACK = 1e-9


def block_rows(width: int) -> int:
    return max(256, BLOCK_BYTES // (4 * max(1, width)))


class Block:
    """Vectors of a block in the order of their scales, so that the rows of a tile have similar ones."""

    def __init__(self, x: np.ndarray, node: np.ndarray, copies: np.ndarray):
        x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])  # by a power of two: exact
        norm = np.sqrt((x * x).sum(axis=1))
        unit = x / norm[:, None]
        scale = np.abs(unit).max(axis=1, initial=0) / 127
        order = np.argsort(-scale, kind="stable")
        self.x, self.norm, self.scale, unit = x[order], norm[order], scale[order], unit[order]
        self.node, self.copies = node[order], copies[order]
        q = np.rint(unit / self.scale[:, None])
        self.steps = q.astype(np.int8)
        self.error = np.sqrt(((unit - self.scale[:, None] * q) ** 2).sum(axis=1))
        self.length = np.sqrt(((self.scale[:, None] * q) ** 2).sum(axis=1))

    def __len__(self):
        return len(self.node)

    def tile(self, at: int) -> np.ndarray:
        """Steps of the tile's rows as floats in which sums of their products are exact."""
        kind = np.float32 if 127 * 127 * self.steps.shape[1] < 1 << 24 else np.float64
        return self.steps[at:at + TILE].astype(kind)


def linked(a: Block, b: Block, threshold: float, work: dict | None = None):
    """(i, j) arrays, tile by tile, of the pairs of ``a`` and ``b`` (``i`` < ``j`` if they are one block) with
    cosine >= ``threshold``. ``work`` counts pairs, those within the bounds' reach and those recomputed."""
    count = work if work is not None else {}
    for lo in range(0, len(a), TILE):
        mine = slice(lo, lo + TILE)
        left = a.tile(lo)
        for at in range(lo if a is b else 0, len(b), TILE):
            product = left @ b.tile(at).T
            # least product that any pair of this row in the tile needs: a cheap screen before the bounds of the pair
            rest = threshold - SLACK - a.error[mine] - a.length[mine] * b.error[at:at + TILE].max()
            least = np.where(rest > 0, rest / (a.scale[mine] * b.scale[at:at + TILE].max()) - 1, -np.inf)
            i, j = np.nonzero(product >= least[:, None])
            value = product[i, j].astype(np.float64)
            i, j = i + lo, j + at
            if a is b:
                once = i < j
                i, j, value = i[once], j[once], value[once]
            near = value * a.scale[i] * b.scale[j]
            bound = a.length[i] * b.error[j] + a.error[i] + SLACK
            maybe = near + bound >= threshold
            i, j, sure = i[maybe], j[maybe], (near - bound >= threshold)[maybe]
            asked = np.flatnonzero(~sure)
            step = max(1, CHUNK // max(1, a.x.shape[1]))
            for k in range(0, len(asked), step):
                p = asked[k:k + step]
                exact = (a.x[i[p]] * b.x[j[p]]).sum(axis=1) / (a.norm[i[p]] * b.norm[j[p]])
                sure[p] = exact >= threshold
            for name, n in (("pairs", product.size), ("reach", len(i)), ("exact", len(asked))):
                count[name] = count.get(name, 0) + n
            if sure.any():
                yield i[sure], j[sure]


def join_groups(group: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``group`` (each position's smallest known member) after the links (i, j)."""
    while True:
        a, b = group[i], group[j]
        apart = a != b
        if not apart.any():
            return group
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(group, np.maximum(a, b), np.minimum(a, b))
        while (up := group[group]).tobytes() != group.tobytes():
            group = up


def cell(a: Block, b: Block, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, links, representative) of the vectors with links in the cell of the blocks ``a`` and ``b``."""
    one = a is b
    n, node = len(a), a.node if one else np.concatenate([a.node, b.node])
    links, group, off = np.zeros(len(node), dtype=np.int64), np.arange(len(node)), 0 if one else n
    for i, j in linked(a, b, threshold):
        np.add.at(links, i, b.copies[j])
        np.add.at(links, j + off, a.copies[i])
        group = join_groups(group, i, j + off)
    some = np.flatnonzero(links)
    return node[some], links[some], node[group[some]]


def _block(t: pa.Table, width: int) -> Block:
    column = t.column("vec").combine_chunks()
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    x = np.zeros((len(sizes), width))
    x[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return Block(x, t.column("node").to_numpy(), t.column("copies").to_numpy())


def _classes(rows: DataFrame) -> DataFrame:
    """(node, h1, h2, vec, copies, least): each distinct vector of ``rows`` (id, vec, h1, h2) once. The numbers
    are those of the written table, so a task that runs again sees the same ones."""
    once = rows.groupBy("h1", "h2").agg(F.first("vec").alias("vec"), F.count("*").alias("copies"), F.min("id").alias("least"))
    return saved(once.withColumn("node", F.monotonically_increasing_id()), "classes")


def near_duplicates(rows: DataFrame, id_col: str, vec_col: str, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links (other rows of cosine >= ``threshold``), component_id, kept: one row per row."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a cosine above 0, at most 1")
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.coalesce(finite & F.exists("vec", lambda x: x != 0), F.lit(False))
    hashed = rows.where(usable).select("id", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2"))
    classes = _classes(hashed)
    n, width = classes.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
    k = max(LEAST_BLOCKS, -(-n // block_rows(width)))
    block = F.pmod(F.xxhash64("node"), F.lit(k)).cast("int")
    held = classes.select("node", "vec", "copies", block.alias("own"))
    left = held.select(F.col("own").alias("a"), F.explode(F.sequence("own", F.lit(k - 1))).alias("b"), "node", "vec", "copies")
    before = F.when(F.col("own") > 0, F.sequence(F.lit(0), F.col("own") - 1)).otherwise(F.array().cast("array<int>"))
    right = held.select(F.explode(before).alias("a"), F.col("own").alias("b"), "node", "vec", "copies")
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("to", pa.int64())])

    def search(key, ts: pa.Table, us: pa.Table) -> pa.Table:
        same = key[0].as_py() == key[1].as_py()
        if not ts.num_rows or not (same or us.num_rows):
            return schema.empty_table()
        a = _block(ts, width)
        found = cell(a, a if same else _block(us, width), threshold)
        return pa.table([pa.array(c, pa.int64()) for c in found], schema=schema)

    found = saved(left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(search, "node bigint, links bigint, to bigint"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    ends = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")))
    known = classes.select("node", "h1", "h2", "copies", "least").join(links, "node", "left").join(ends, "node", "left")
    known = known.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "least", F.coalesce("comp", "node").alias("comp"))
    known = saved(known, "known")
    first = known.groupBy("comp").agg(F.min("least").alias("component_id"))
    facts = known.join(first, "comp").select("h1", "h2", "n_links", "component_id")
    out = hashed.select("id", "h1", "h2").join(facts, ["h1", "h2"]).select("id", "n_links", "component_id")
    alone = rows.where(~usable).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
