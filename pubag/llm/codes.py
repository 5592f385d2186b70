"""Vector codes: product quantisation by an active-entry Lloyd iteration on integer vectors.

Components become integers floor(256 * x), a vector is cut into ``PARTS`` equal parts, and every part position
has a codebook of ``ENTRIES`` entries, seeded with the rows of the smallest ids. A round assigns every part to
its nearest entry and replaces each entry by the floor of its parts' mean. The assigned entry and the exact
distance to it stay beside each row. An entry is active if the last update moved it. A part whose own entry
did not move still knows its nearest entry among all that did not, so it is compared with the active entries
only, against the stored distance; a part whose own entry moved is compared with the whole codebook. Equal
distances go to the lower index in both cases, so the result is that of complete scans.

Rows never move: each round is one pass over the table in Arrow batches, written to the shared folder, and one
aggregate of the tasks' own sums. Only the codebooks reach the driver and the tasks (``ENTRIES`` rows long);
what a task sums has the codebooks' size too, so a group of copies of any size weighs nothing.

Cases: vectors that are null or hold null, NaN or infinite components are dropped. Shorter vectors are padded
with zeros to the longest, and all to a multiple of ``PARTS``. Integers stop at +-``LIMIT``, so that all sums
and distances fit 64 bits. Repeated rows and ids count as often as they occur; among rows of one id the smaller
integer vector seeds first, rows without an id seed last. With fewer rows than entries the codebooks are as
short as the table. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubag.llm.common import saved

PARTS, ENTRIES, ROUNDS, LIMIT = 16, 64, 2, 1 << 24

#: Numbers of a batch (rows x components) that are worked on at once.
AT_ONCE = 1 << 20


@dataclass
class Coded:
    """``rows``: id, label, code (binary, one byte a part), error. ``books``: parts x entries x width."""

    rows: DataFrame
    books: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances (rows x entries) of integer vectors."""
    top = max(np.abs(x).max(initial=0), np.abs(book).max(initial=0))
    if 4 * max(1, x.shape[1]) * int(top) ** 2 < 1 << 53:  # whole numbers below 2^53 are exact in doubles
        a, c = x.astype(np.float64), book.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    out = np.zeros((len(x), len(book)), dtype=np.int64)
    for j in range(x.shape[1]):
        out += (x[:, j, None].astype(np.int64) - book[None, :, j]) ** 2
    return out


def assign(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, its distance) of each row by a complete scan; ties to the lower index."""
    d = distances(x, book)
    code = d.argmin(axis=1)
    return code, d[np.arange(len(x)), code]


def reassign(x: np.ndarray, book: np.ndarray, moved: np.ndarray, code: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The same from the assignment and distances before ``moved`` entries changed, and the comparisons made."""
    code, dist = code.copy(), dist.copy()
    active, lost = np.flatnonzero(moved), moved[code]
    again, fixed = np.flatnonzero(lost), np.flatnonzero(~lost)
    if len(again):
        code[again], dist[again] = assign(x[again], book)
    if len(active) and len(fixed):
        near, d = assign(x[fixed], book[active])
        near = active[near]
        better = (d < dist[fixed]) | (d == dist[fixed]) & (near < code[fixed])
        code[fixed[better]], dist[fixed[better]] = near[better], d[better]
    return code, dist, len(again) * len(book) + len(fixed) * len(active)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows, padded with zeros."""
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), dtype=flat.dtype)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _pass(state: DataFrame, books: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """Every part's nearest entry: id, label, vec, code, dist."""
    parts, _, w = books.shape
    schema = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("vec", pa.list_(pa.int32())), ("code", pa.binary()), ("dist", pa.list_(pa.int64()))])

    def run(it):
        for whole in it:
            step = max(1, AT_ONCE // (parts * w))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                n, x = batch.num_rows, _matrix(batch.column("vec"), parts * w)
                code, dist = np.zeros((n, parts), dtype=np.int64), np.zeros((n, parts), dtype=np.int64)
                if moved is not None:
                    code[:] = np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype=np.uint8).reshape(n, parts)
                    dist[:] = _matrix(batch.column("dist"), parts)
                for p in range(parts):
                    own = x[:, p * w:(p + 1) * w]
                    if moved is None:
                        code[:, p], dist[:, p] = assign(own, books[p])
                    else:
                        code[:, p], dist[:, p], _ = reassign(own, books[p], moved[p], code[:, p], dist[:, p])
                bytes_ = code.astype(np.uint8).tobytes()
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel(), t))
                         for m, t in ((x, pa.int32()), (dist, pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), lists[0],
                                                  pa.array([bytes_[k * parts:(k + 1) * parts] for k in range(n)], pa.binary()), lists[1]], schema=schema)

    return state.mapInArrow(run, "id bigint, label bigint, vec array<int>, code binary, dist array<bigint>")


def _updated(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry replaced by the floor of the mean of its parts; unused entries stay."""
    parts, entries, w = books.shape
    slots = pa.schema([("slot", pa.int64()), ("value", pa.int64())])

    def run(it):
        total = np.zeros((parts, entries, w + 1), dtype=np.int64)
        for whole in it:
            step = max(1, AT_ONCE // (parts * w))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                x = _matrix(batch.column("vec"), parts * w).astype(np.int64)
                code = np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype=np.uint8).reshape(len(x), parts)
                for p in range(parts):
                    np.add.at(total[p, :, :w], code[:, p], x[:, p * w:(p + 1) * w])
                    total[p, :, w] += np.bincount(code[:, p], minlength=entries)
        used = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total.ravel()[used])], schema=slots)

    sums = state.select("vec", "code").mapInArrow(run, "slot bigint, value bigint").groupBy("slot").agg(F.sum("value").alias("value"))
    total = np.zeros(parts * entries * (w + 1), dtype=np.int64)
    for slot, value in sums.collect():  # one row per number of the codebooks
        total[slot] = value
    total = total.reshape(parts, entries, w + 1)
    count = total[:, :, w:]
    return np.where(count > 0, total[:, :, :w] // np.maximum(count, 1), books)


def whole_vectors(rows: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(id, label, vec): rows with a vector of finite components, as integers floor(256 * x)."""
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    held = lambda x: F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), x.cast("double") * 256))
    return rows.where(F.col(vec_col).isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
        F.transform(vec_col, lambda x: F.floor(held(x)).cast("int")).alias("vec"))


def compress(rows: DataFrame, id_col: str, vec_col: str, label_col: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Coded:
    """Codes of all usable rows after ``rounds`` rounds of training on all of them."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte a part: 1 to 256 entries")
    state = whole_vectors(rows, id_col, vec_col, label_col)
    width = state.agg(F.max(F.size("vec"))).first()[0] or 0
    w = max(1, -(-width // parts))
    seeds = [r.vec for r in state.orderBy(F.asc_nulls_last("id"), "vec").limit(entries).collect()]
    if not seeds:
        return Coded(state.select("id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), np.zeros((parts, 0, w), dtype=np.int64))
    first = np.array([v + [0] * (parts * w - len(v)) for v in seeds], dtype=np.int64)
    books, moved = first.reshape(len(seeds), parts, w).transpose(1, 0, 2), None
    for k in range(rounds):
        state = saved(_pass(state, books, moved), f"codes{k}")
        new = _updated(state, books)
        books, moved = new, (new != books).any(axis=2)
    last = _pass(state, books, moved).select("id", "label", "code", F.aggregate("dist", F.lit(0).cast("long"), lambda a, d: a + d).alias("error"))
    return Coded(saved(last, "codes"), books)


def decoded(coded: Coded) -> DataFrame:
    """(id, label, vec): each row's integer vector as its code says it, padding included."""
    books = coded.books
    parts, _, w = books.shape
    schema = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("vec", pa.list_(pa.int64()))])

    def run(it):
        for batch in it:
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), dtype=np.uint8).reshape(batch.num_rows, parts)
            vec = books[np.arange(parts), code].reshape(batch.num_rows, parts * w)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(vec) + 1, dtype=np.int32) * (parts * w)), pa.array(vec.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), lists], schema=schema)

    return coded.rows.mapInArrow(run, "id bigint, label bigint, vec array<bigint>")


def with_label_error(coded: Coded) -> DataFrame:
    """``coded.rows`` and label_error: the errors of all rows of the label together (rows without a label are
    one group), at most the largest 64-bit integer. A hot label is summed in its tasks before the shuffle."""
    sums = coded.rows.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    sums = sums.select(F.col("label").alias("of"), F.least("total", most).cast("long").alias("label_error"))
    return coded.rows.join(sums, F.col("label").eqNullSafe(F.col("of"))).drop("of")
