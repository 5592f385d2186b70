"""Scoring rows with every bag's model: Arrow batches and NumPy inside tasks, one slice of bags at a time.

Rows stay in their partitions and keep their columns; only the features, the axis value and
(for out-of-bag scores) the row's drawn bags cross to Python. The model table reaches the tasks
as broadcasts of at most ``SLICE_BYTES`` each; sums and counts of the slices are added per row,
so the plan is the same for a small and a large model table. Models of a learner with ``np_stack`` are arrays over
axis value and bag: a batch in which few rows share an axis value (rows times axis values) takes each row's own model
from them, as a call for each (axis value, bag) would cost far more than its rows. Rows for many bags of a learner whose votes cost far
more than moving a row (``slow_votes``) are dealt evenly first and sorted by axis value in their partitions: partitions of few bytes may hold most of the votes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: bound of one slice of the model table (by the learners' own size of a model).
SLICE_BYTES = 32 << 20
# Fixed value: bytes of the models of a slice that the driver reads at once: numbers of a row are objects until they are in arrays.
READ_BYTES = 8 << 20
# Fixed value: bags from which on rows are dealt evenly before they are scored by a learner of ``slow_votes``.
MANY_BAGS = 10
# Fixed value: a batch with fewer rows an axis value than this is scored by rows, each with the model of its own axis value.
FEW_ROWS = 256
# What stacked models are asked for.
STACKED = ("proba", "vote", "decision")

_TYPES = {
    "proba": "struct<s:double,n:int>",
    "vote": "struct<s:double,n:int>",
    "decision": "struct<s:double,n:int>",
    "log": "struct<l0:double,l1:double,n:int>",
    "terms": "struct<t:array<double>,n:int>",
    "per_bag": "array<struct<bag:int,p:double>>",
}


def axis_text(axis: list[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(a).cast("string"), F.lit("\x01null")) for a in axis])


def _numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _is_drawn(drawn: pa.Array, lo: int, hi: int) -> np.ndarray:
    """(row, bag) mask of the bags lo..hi-1 that drew the row."""
    out = np.zeros((len(drawn), hi - lo), dtype=bool)
    lists = drawn.fill_null([]) if drawn.null_count else drawn
    sizes = np.diff(lists.offsets.to_numpy())
    bags = lists.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(drawn)), sizes)
    mine = (bags >= lo) & (bags < hi)
    out[rows[mine], (bags[mine] - lo).astype(int)] = True
    return out


def _stack(learner, packed: dict[str, list], lo: int, hi: int) -> tuple:
    """(index of each axis value, (axis value, bag) that have a model, their arrays) of a slice of models."""
    there = np.zeros((len(packed), hi - lo), dtype=bool)
    models: list[list] = [[None] * (hi - lo) for _ in packed]
    for a, own in enumerate(packed.values()):
        for bag, m in own:
            there[a, bag - lo], models[a][bag - lo] = True, m
    return {ax: a for a, ax in enumerate(packed)}, there, learner.np_stack(models) if packed else {}


def _add_stacked(n: np.ndarray, s: np.ndarray, learner, sent: tuple, x: np.ndarray, axes: list[str], of: np.ndarray, drawn, value: str, bags: int) -> None:
    """Adds to ``n`` and ``s`` the votes of stacked models on a batch."""
    index, there, models = sent
    where = np.array([index.get(a, -1) for a in axes], dtype=np.int64)
    if len(x) < FEW_ROWS * len(axes):
        parts = [(np.flatnonzero(where[of] >= 0), None)]
    else:
        parts = [(np.flatnonzero(of == k), a) for k, a in enumerate(where.tolist()) if a >= 0]
    for mine, a in parts:
        at = where[of[mine]] if a is None else None
        for b in range(bags):
            left = there[at, b] if a is None else np.full(len(mine), there[a, b])
            if drawn is not None:
                left &= ~drawn[mine, b]
            whole = left.all()
            rows = mine if whole else mine[left]
            if not len(rows):
                continue
            m = learner.np_pick(models, a if at is None else at if whole else at[left], b)
            n[rows] += 1
            if value == "decision":
                s[rows] += learner.np_decision(m, x[rows])
            else:
                p = learner.np_proba(m, x[rows])
                s[rows] += p > 0.5 if value == "vote" else p


def _slice_udf(sent, learner, d: int, value: str, lo: int, hi: int, oob: bool, stacked: bool):
    """Arrow UDF (features…, axis text, drawn bags) -> sums over the slice's bags that count for the row."""

    def score(*columns: pa.Array) -> pa.Array:
        x = np.column_stack([_numbers(c) for c in columns[:d]]) if d else np.zeros((len(columns[0]), 0))
        size = len(x)
        names = columns[d].dictionary_encode()
        axes, of = names.dictionary.to_pylist(), names.indices.to_numpy(zero_copy_only=False)
        drawn = _is_drawn(columns[d + 1], lo, hi) if oob else None
        n = np.zeros(size, dtype=np.int32)
        s = np.zeros(size)
        logs = np.full((2, size), -np.inf)
        terms = np.zeros((size, d))
        per = [[] for _ in range(size)] if value == "per_bag" else None
        if stacked:
            _add_stacked(n, s, learner, sent.value, x, axes, of, drawn, value, hi - lo)
            axes = []
        for k, ax in enumerate(axes):
            mine = np.flatnonzero(of == k)
            own = sent.value.get(ax, ())
            seen, out = x[mine], None if drawn is None else drawn[mine]
            if own and hasattr(learner, "np_map"):  # the rows as all models of the axis value see them
                seen = learner.np_map(own[0][1], seen)
            for bag, m in own:
                rows, its = mine, seen
                if out is not None:
                    left = ~out[:, bag - lo]
                    rows, its = mine[left], seen[left]
                if not len(rows):
                    continue
                n[rows] += 1
                if value == "log":
                    for c, one in enumerate(learner.np_log_proba(m, its)):
                        logs[c, rows] = np.logaddexp(logs[c, rows], one)
                elif value == "terms":
                    terms[rows] += learner.np_terms(m, its)
                elif value == "decision":
                    s[rows] += learner.np_decision(m, its)
                else:
                    p = learner.np_proba(m, its)
                    if per is not None:
                        for r, v in zip(rows.tolist(), p.tolist()):
                            per[r].append({"bag": bag, "p": v})
                    s[rows] += p > 0.5 if value == "vote" else p
        count = pa.array(n, pa.int32())
        if value == "per_bag":
            return pa.array(per, pa.list_(pa.struct([("bag", pa.int32()), ("p", pa.float64())])))
        if value == "log":
            return pa.StructArray.from_arrays([pa.array(logs[0]), pa.array(logs[1]), count], names=["l0", "l1", "n"])
        if value == "terms":
            lists = pa.ListArray.from_arrays(pa.array(np.arange(size + 1) * d, pa.int32()), pa.array(terms.ravel()))
            return pa.StructArray.from_arrays([lists, count], names=["t", "n"])
        return pa.StructArray.from_arrays([pa.array(s), count], names=["s", "n"])

    # the annotation of a variable number of columns
    score.__annotations__ = {"columns": pa.Array, "return": pa.Array}
    return F.arrow_udf(score, _TYPES[value])


def _added(value: str, a: Column, b: Column) -> Column:
    if value == "per_bag":
        return F.concat(a, b)
    n = (a["n"] + b["n"]).alias("n")
    if value == "log":
        def both(f):
            top = F.greatest(a[f], b[f])
            return (top + F.log(F.exp(a[f] - top) + F.exp(b[f] - top))).alias(f)

        return F.struct(both("l0"), both("l1"), n)
    if value == "terms":
        return F.struct(F.zip_with(a["t"], b["t"], lambda p, q: p + q).alias("t"), n)
    return F.struct((a["s"] + b["s"]).alias("s"), n)


def scored(model, df: DataFrame, value: str = "proba", drawn: Column | None = None, name: str = "_acc") -> DataFrame:
    """``df`` (with the model's axis columns) plus ``name``: what the bags say about each row.

    ``drawn`` (array<int>) names the bags that must not vote on a row.
    """
    spark, learner, feats = df.sparkSession, model.learner, list(model.features)
    per_bag = max(1, len(model.counts)) * learner.model_bytes(len(feats))
    step = max(1, SLICE_BYTES // per_bag)
    last = model.first_bag + model.n_estimators
    args = [*[F.col(c).cast("double") for c in feats], axis_text(model.axis),
            F.array().cast("array<int>") if drawn is None else drawn]  # no nulls: a run of them is written to Arrow in square time
    parts = []
    out = df
    if getattr(learner, "slow_votes", False) and model.n_estimators >= MANY_BAGS:
        out = df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "200"))))
        if len(model.counts) > 1:  # a batch then has rows of few axis values, so that a call for a model has many
            out = out.sortWithinPartitions(*model.axis)
    for k, lo in enumerate(range(model.first_bag, last, step)):
        hi = min(last, lo + step)
        packed: dict[str, list] = {}
        some = max(1, READ_BYTES // per_bag)
        for at in range(lo, hi, some):  # in all at most SLICE_BYTES
            rows = model.models.filter((F.col("bag") >= at) & (F.col("bag") < min(hi, at + some))).withColumn("_axt", axis_text(model.axis)).collect()
            for r in sorted(rows, key=lambda r: r["bag"]):
                packed.setdefault(r["_axt"], []).append((int(r["bag"]), learner.unpack(r)))
            del rows
        stacked = value in STACKED and hasattr(learner, "np_stack")
        sent = spark.sparkContext.broadcast(_stack(learner, packed, lo, hi) if stacked else packed)
        udf = _slice_udf(sent, learner, len(feats), value, lo, hi, drawn is not None, stacked)
        parts.append(f"{name}{k}")
        out = out.withColumn(parts[-1], udf(*args))
    total = F.col(parts[0])
    for p in parts[1:]:
        total = _added(value, total, F.col(p))
    return out.withColumn(name, total).drop(*[p for p in parts if p != name])
