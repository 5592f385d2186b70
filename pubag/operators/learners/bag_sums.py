"""Sums over the training rows for the models of all bags in one job: the step of every iterative learner.

A training row is stored once, with the list of the bags that drew it and how often (no list: it is in every
bag). A pass reads the rows in Arrow batches; a task adds up, per axis value and bag, ``size`` numbers that the
learner's ``add`` derives from the rows and from the models as they are (sent to the tasks), and returns one
vector per model. The vectors are merged by a tree of reducers, ``MERGE`` at a time, and the learner's step is
made from the merged ones; where all of them together are small (``DIRECT_BYTES``, whatever the number of rows) the
driver adds them up, which saves every pass a shuffle. Rows are never copied per bag or written back.

The rows are laid out by axis value once (``laid_out``): a task holds few axis values, each in one piece, so that
it returns vectors of few models and works on long arrays, however many axis values there are. For learners that
read them in many passes they are kept as arrays (``packed``): a record holds the rows of a few Arrow batches and one axis
value, column by column, so that a pass turns no single row or list into Arrow again.

Models are trained in slices of at most ``SLICE_BYTES`` (all that is held per model counts), so what a task, a
reducer and the driver hold is bounded whatever the number of bags and axis values; models are independent of
each other, so slicing changes no result.

:class:`Exact` makes sums that do not depend on the order of the rows: a value is cut into whole multiples of
descending powers of two, which are added as 64-bit integers.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubag.functions.hashing import h, key_text
from pubag.operators.scoring import axis_text
from pubag.session import kept

# Vectors merged by one reducer, bytes of all vectors of a pass that need none, bytes of one vector blob,
# bytes of the models trained at once, (row, bag) pairs worked on at once, the prime of the row draws, and rows of a
# task beyond two tasks a core.
MERGE = 64
DIRECT_BYTES = 32 << 20
BLOB_BYTES = 1 << 20
SLICE_BYTES = 64 << 20
PAIRS = 1 << 19
PRIME = (1 << 31) - 1
TASK_ROWS = 1 << 18
# Rows of an Arrow batch or more that a record of packed rows takes: a call for a bag then works on long arrays.
RECORD_ROWS = 1 << 15


def training_rows(df: DataFrame, axis: list[str], features: list[str], label: str, weight: str | None, key: list[str] | None = None) -> DataFrame:
    """``df`` (axis…, key…, label, features…, _bags: array of (bag, w), null = every bag) as the passes read it.
    ``key`` numbers the rows for learners that draw rows. No list is null: writing a run of null lists to Arrow takes
    time with the square of its length."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    none = F.array().cast("array<int>")
    return df.select(
        axis_text(axis).alias("_axt"), F.col(label).cast("double").alias("_y"), F.coalesce(w, F.lit(0.0)).alias("_w0"),
        F.array(*[F.col(c).cast("double") for c in features]).alias("_x"),
        F.col("_bags").isNull().alias("_every"),
        F.coalesce(F.transform("_bags", lambda b: b["bag"].cast("int")), none).alias("_b"),
        F.coalesce(F.transform("_bags", lambda b: b["w"].cast("int")), none).alias("_m"),
        (h("row", key_text(key)) % PRIME if key else F.lit(0).cast("bigint")).alias("_r"))


def laid_out(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` (``n`` of them), kept so that a task has the rows of few axis values, in order. Rows of an axis value
    are mixed, as those in every bag cost most, and an axis value of any size is cut into several tasks."""
    return kept(_by_axis(rows, n))


def _by_axis(rows: DataFrame, n: int) -> DataFrame:
    spark = rows.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-n // TASK_ROWS))
    # an axis value has a stretch of the numbers below n, as long as it has rows; a task takes as many numbers as any other
    found = sorted((r["_axt"], r["count"]) for r in rows.groupBy("_axt").count().collect())  # one row per axis value
    n = max(1, sum(c for _, c in found))
    ends = list(itertools.accumulate(c for _, c in found))
    place = spark.createDataFrame([(a, e - c, c) for (a, c), e in zip(found, ends)], "_axt string, _from bigint, _rows bigint")
    rows = rows.withColumn("_at", F.monotonically_increasing_id())
    mine = F.floor((F.col("_from") + F.pmod(F.xxhash64("_at"), F.col("_rows"))) * F.lit(tasks) / F.lit(n)).cast("int")
    rows = rows.join(F.broadcast(place), "_axt").withColumn("_to", mine).drop("_at", "_from", "_rows")
    return rows.repartitionById(tasks, F.col("_to")).drop("_to").sortWithinPartitions("_axt")


# A record of packed rows (of one axis value, from about ``RECORD_ROWS`` rows): ``_x``, ``_y``, ``_w0`` and ``_r`` of all rows, ``_every``: the rows of every bag, ``_in``: those
# of any bag, ``_size``: the length of each row's list of bags, ``_bag`` and ``_times``: the lists. Whole numbers are
# written in as few bytes as they need, after the letter of their type. ``_skip``: leave out rows of no bag.
_BLOBS = ("_x", "_y", "_w0", "_r", "_every", "_in", "_size", "_bag", "_times")
_PACKED = "_axt string, _skip boolean, " + ", ".join(f"{c} binary" for c in _BLOBS)
_PACKED_SCHEMA = pa.schema([("_axt", pa.string()), ("_skip", pa.bool_()), *[(c, pa.binary()) for c in _BLOBS]])


def _blob(v: np.ndarray) -> bytes:
    small = v.astype(np.min_scalar_type(int(v.max(initial=0))))
    return small.dtype.char.encode() + small.tobytes()


def _whole(blob) -> np.ndarray:
    buf = blob.as_buffer()
    return np.frombuffer(buf, dtype=chr(buf[0]), offset=1)


def packed(rows: DataFrame, n: int, d: int) -> DataFrame:
    """``rows`` (``n`` of them, ``d`` features) laid out by axis value and kept as arrays."""

    def run(it):
        for batch in _joined(it, RECORD_ROWS):
            lists = batch.column("_b")
            sizes, every = _numbers(lists.value_lengths()).astype(np.int64), _numbers(batch.column("_every"))
            x = _finite(batch, d)
            y, w0, r = (_numbers(batch.column(c)) for c in ("_y", "_w0", "_r"))
            bag, times = _numbers(lists.flatten()), _numbers(batch.column("_m").flatten())
            ends = np.cumsum(sizes)
            names = batch.column("_axt").dictionary_encode()
            codes = _numbers(names.indices)
            for k, name in enumerate(names.dictionary.to_pylist()):
                here = np.flatnonzero(codes == k)
                own = np.flatnonzero(np.repeat(codes == k, sizes)) if len(here) < len(codes) else slice(0, ends[-1])
                found = (x[here].tobytes(), y[here].tobytes(), w0[here].tobytes(), _blob(r[here]), _blob(np.flatnonzero(every[here])),
                         _blob(np.flatnonzero(every[here] | (sizes[here] > 0))), _blob(sizes[here]), _blob(bag[own]), _blob(times[own]))
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([False]), *[pa.array([v], pa.binary()) for v in found]],
                                                 schema=_PACKED_SCHEMA)

    return kept(_by_axis(rows, n).mapInArrow(run, _PACKED))


def _joined(it, rows: int):
    """The batches of ``it``, as many put together as have ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    for batch in it:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def loose(rows: DataFrame, d: int) -> DataFrame:
    """(_axt, _w0, _x) of all rows, for statistics of the features; a missing or infinite value of packed rows is NaN."""
    if "_skip" not in rows.columns:
        return rows.select("_axt", "_w0", "_x")

    def run(it):
        for batch in it:
            for name, x, w0 in zip(batch.column("_axt"), batch.column("_x"), batch.column("_w0")):
                w0, x = (np.frombuffer(v.as_buffer()) for v in (w0, x))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w0) + 1) * d, pa.int32()), pa.array(x))
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(w0), pa.string()), pa.array(w0), lists], names=["_axt", "_w0", "_x"])

    return rows.mapInArrow(run, "_axt string, _w0 double, _x array<double>")


def in_bags(rows: DataFrame) -> DataFrame:
    """The rows that any bag has."""
    if "_skip" in rows.columns:
        return rows.withColumn("_skip", F.lit(True))
    return rows.where(F.col("_every") | (F.size("_b") > 0))


def row_uniform(r: np.ndarray, a, c) -> np.ndarray:
    """One number in (0, 1) per row number (below ``PRIME``) and line (a, c)."""
    v = np.asarray(a, dtype=np.int64) * r + np.asarray(c, dtype=np.int64)
    for _ in range(2):  # modulo 2^31 - 1 by folding
        v = (v & PRIME) + (v >> 31)
    return (np.where(v == PRIME, 0, v) + 0.5) / PRIME


def line(*parts) -> tuple[int, int]:
    """The line (a, c) of a draw's name; two different names give independent numbers for a row."""
    from pubag.operators.sampling import feature_bag_hash

    return 1 + feature_bag_hash(*parts, "a") % (PRIME - 1), feature_bag_hash(*parts, "c") % PRIME


@dataclass
class Rows:
    """Rows of one axis value: ``x`` (missing: NaN), ``y``, ``w0`` (the row's weight), ``r`` (its number), ``every``
    (the rows that all bags have once) and the pairs (``row``, ``bag`` from 0 in the slice, ``times``) of the others."""

    x: np.ndarray
    y: np.ndarray
    w0: np.ndarray
    r: np.ndarray
    every: np.ndarray
    row: np.ndarray
    bag: np.ndarray
    times: np.ndarray

    def dense(self, bags: int) -> np.ndarray:
        """(row, bag) matrix of how often the bag has the row."""
        out = np.zeros((bags, len(self.y)))
        out[self.bag, self.row] = self.times
        out[:, self.every] = 1.0
        return out.T

    def pairs(self, bags: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, bag, times) of all pairs."""
        n = len(self.every)
        return (np.concatenate([self.row, np.repeat(self.every, bags)]), np.concatenate([self.bag, np.tile(np.arange(bags), n)]),
                np.concatenate([self.times, np.ones(n * bags)]))

    def of_bags(self, bags: int):
        """(bag, its rows, its weights of them) of the bags that have rows."""
        times = self.dense(bags).T
        plain = bool((self.w0 == 1).all())
        for b in range(bags):
            rows = np.flatnonzero(times[b])
            if len(rows):
                yield b, rows, times[b, rows] if plain else times[b, rows] * self.w0[rows]


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _finite(batch: pa.RecordBatch, d: int) -> np.ndarray:
    x = np.asarray(_numbers(batch.column("_x").flatten()), dtype=float).reshape(batch.num_rows, d)
    return np.where(np.isfinite(x), x, np.nan)


def pieces(batch: pa.RecordBatch, d: int, index: dict, first: int, last: int, step: int):
    """(axis index, Rows) of the axis values in ``index``, at most ``step`` rows at a time; bags ``first`` to ``last`` - 1."""
    if "_skip" not in batch.schema.names:
        for at in range(0, batch.num_rows, step):
            yield from split(batch.slice(at, step), d, index, first, last)
        return
    for i, name in enumerate(batch.column("_axt").to_pylist()):
        if name in index:
            yield from ((index[name], part) for part in _unpacked({c: batch.column(c)[i] for c in ("_skip", *_BLOBS)}, d, first, last, step))


def _unpacked(record: dict, d: int, first: int, last: int, step: int):
    """Rows of a record of packed rows, at most ``step`` at a time."""
    x, y, w0 = (np.frombuffer(record[c].as_buffer()) for c in ("_x", "_y", "_w0"))
    r, every, used, sizes, bag, times = (_whole(record[c]) for c in ("_r", "_every", "_in", "_size", "_bag", "_times"))
    x, n = x.reshape(-1, d), len(y)
    place = np.arange(n)
    if record["_skip"].as_py() and len(used) < n:  # what is left out has no bags
        place = np.zeros(n, dtype=np.int64)
        place[used] = np.arange(len(used))
        x, y, w0, r, sizes, n = x[used], y[used], w0[used], r[used], sizes[used], len(used)
    every, ends = place[every], np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        own = slice(ends[lo], ends[hi])
        row, b, t = np.repeat(np.arange(hi - lo), sizes[lo:hi]), bag[own].astype(np.int64) - first, times[own].astype(float)
        mine = (b >= 0) & (b < last - first)
        if not mine.all():
            row, b, t = row[mine], b[mine], t[mine]
        yield Rows(x[lo:hi], y[lo:hi], w0[lo:hi], r[lo:hi].astype(np.int64), every[np.searchsorted(every, lo):np.searchsorted(every, hi)] - lo, row, b, t)


def split(batch: pa.RecordBatch, d: int, index: dict, first: int, last: int):
    """(axis index, Rows) of the axis values in ``index``; bags ``first`` to ``last`` - 1."""
    n = batch.num_rows
    x = _finite(batch, d)
    y, w0, r = (_numbers(batch.column(c)) for c in ("_y", "_w0", "_r"))
    lists = batch.column("_b")
    every = np.flatnonzero(_numbers(batch.column("_every")))
    sizes = _numbers(lists.value_lengths()).astype(np.int64)
    row, bag, times = np.repeat(np.arange(n), sizes), _numbers(lists.flatten()).astype(np.int64) - first, _numbers(batch.column("_m").flatten())
    mine = (bag >= 0) & (bag < last - first)
    row, bag, times = row[mine], bag[mine], times[mine].astype(float)
    names = batch.column("_axt").dictionary_encode()
    codes, place = _numbers(names.indices), np.zeros(n, dtype=np.int64)
    for k, name in enumerate(names.dictionary.to_pylist()):
        if name in index:
            here = np.flatnonzero(codes == k)
            place[here] = np.arange(len(here))
            own = codes[row] == k
            yield index[name], Rows(x[here], y[here], w0[here], r[here], place[every[codes[every] == k]], place[row[own]], bag[own], times[own])


def summed(rows: DataFrame, axes: list[str], first: int, last: int, d: int, size: int, add: Callable, state: list, kind=np.float64, pairs: int = PAIRS) -> np.ndarray:
    """(axis values, bags, ``size``) sums of ``kind`` over all rows. ``add(acc, rows, state of the axis value)`` adds
    a batch's part, of at most ``pairs`` (row, bag), to ``acc`` (bags x ``size``)."""
    spark = rows.sparkSession
    bags = last - first
    sent = spark.sparkContext.broadcast(({a: i for i, a in enumerate(axes)}, state))
    per = max(1, BLOB_BYTES // (8 * size))
    blobs, step = -(-bags // per), max(64, pairs // bags)
    schema = pa.schema([("slot", pa.int32()), ("task", pa.int32()), ("sums", pa.binary())])
    ddl = "slot int, task int, sums binary"

    def run(it):
        index, models = sent.value
        total: dict[int, np.ndarray] = {}
        for whole in it:
            for a, part in pieces(whole, d, index, first, last, step):
                if a not in total:
                    total[a] = np.zeros((bags, size), dtype=kind)
                add(total[a], part, models[a])
        task = TaskContext.get().partitionId()
        for a, acc in total.items():
            for b in range(blobs):
                part = acc[b * per:(b + 1) * per]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([a * blobs + b], pa.int32()), pa.array([task], pa.int32()), pa.array([part.tobytes()], pa.binary())], schema=schema)

    def merge(key, table):
        total = None
        for blob in table.column("sums"):
            v = np.frombuffer(blob.as_buffer(), dtype=kind)
            total = v.copy() if total is None else total + v
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], schema=schema)

    found = rows.mapInArrow(run, ddl)
    tasks = rows.rdd.getNumPartitions()
    # packed rows lie by axis value: together the tasks have at most one piece a task more than there are axis values
    direct = "_skip" in rows.columns and (len(axes) + tasks) * bags * size * 8 <= DIRECT_BYTES
    while not direct:
        found = found.withColumn("task", F.floor(F.col("task") / MERGE).cast("int")).groupBy("slot", "task").applyInArrow(merge, ddl)
        tasks = -(-tasks // MERGE)
        if tasks <= 1:
            break
    out = np.zeros((len(axes), bags, size), dtype=kind)
    got = sorted(found.collect(), key=lambda r: (-r["slot"], -r["task"]))  # one vector per model of the slice, or few bytes
    while got:  # a vector is let go when it is added
        r = got.pop()
        a, b = divmod(r["slot"], blobs)
        part = np.frombuffer(r["sums"], dtype=kind).reshape(-1, size)
        out[a, b * per:b * per + len(part)] += part
    sent.destroy()
    return out


def slices(n_axes: int, first: int, bags: int, model_bytes: int):
    """(axis values lo, hi, bags lo, hi) of the slices of models of at most ``SLICE_BYTES`` each. A slice has a few bags
    of all axis values, as far as they fit: rows lie by axis value, so that all tasks have work in every pass."""
    most = max(1, SLICE_BYTES // model_bytes)
    axes = max(1, min(n_axes, most))
    step = max(1, min(bags, most // axes))
    # as even as they can be
    step = -(-bags // -(-bags // step))
    for a in range(0, n_axes, axes):
        for b in range(first, first + bags, step):
            yield a, min(n_axes, a + axes), b, min(first + bags, b + step)


class Exact:
    """Sums of doubles below 2^``top`` in absolute value as ``LIMBS`` integers, the same for any order of the rows.

    A limb has ``BITS`` bits; 2^41 rows fit a 64-bit sum. What is below 2^(top - LIMBS * BITS) is lost."""

    LIMBS, BITS = 5, 22

    @classmethod
    def cut(cls, v: np.ndarray, top: np.ndarray) -> np.ndarray:
        """Limbs (..., LIMBS) of ``v``; missing values count as 0."""
        rest = np.where(np.isnan(v), 0.0, v)
        out = np.empty((*v.shape, cls.LIMBS))
        for k in range(cls.LIMBS):
            shift = top - cls.BITS * (k + 1)
            if np.abs(shift).max() < 1022:  # a product by a power of two is exact
                down, up = np.ldexp(1.0, -shift), np.ldexp(1.0, shift)
                whole = np.rint(rest * down)
                rest = rest - whole * up
            else:
                whole = np.rint(np.ldexp(rest, -shift))
                rest = rest - np.ldexp(whole, shift)
            out[..., k] = whole
        return out

    @classmethod
    def whole(cls, limbs: np.ndarray) -> np.ndarray:
        """Python integers, in units of 2^(top - LIMBS * BITS), of summed limbs (..., LIMBS)."""
        out = limbs[..., 0].astype(object)
        for k in range(1, cls.LIMBS):
            out = out * (1 << cls.BITS) + limbs[..., k].astype(object)
        return out


def exponent(v: float | None) -> int:
    """Least e with abs(v) < 2^e (0 for a missing or zero value)."""
    return int(np.frexp(abs(v))[1]) if v else 0


def squares(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x * x as a double and what it lacks, exactly."""
    big = x * 134217729.0
    high = big - (big - x)
    low = x - high
    p = x * x
    return p, ((high * high - p) + 2 * high * low) + low * low
