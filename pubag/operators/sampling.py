"""Exact-size, reproducible sampling and splitting (SA1-SA19, SO2, SO4, WI4, WI5).

Every random order is ``(h(seed, tag, key), key, content hash)``; rows that agree in all
of it are interchangeable. There is one path for every size:

* dense positions come from a range partitioning of that order: one count per range
  partition gives the offsets, ``row_number`` runs inside each partition. A row id is the
  last sort column, so even a group of identical rows is cut into several partitions.
* "the first n rows" takes a histogram over the top bits of the hash, keeps every bucket
  below the cut bucket whole and gives dense positions to the cut bucket only. The result
  does not depend on the number of bits.

Asking for more rows than there are is an error unless the caller says ``at_most``.
Partition columns (``parts``) make one call serve many independent samples at
once (per group, per repeat, per class, per bag): they are ordinary columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pubag.functions.hashing import HASH_BITS, as_list, h, key_text, numbered_hash, uniform
from pubag.session import checkpoint_dir

DEFAULT_BITS = 12
_H = "_h"
_B = "_b"
_H2, _R, _P = "_h2", "_rid", "_part"


def with_hash(df: DataFrame, key, seed, tag: str, extra: tuple = (), name: str = _H) -> DataFrame:
    """Add the order hash h(seed, tag, *extra, key-text)."""
    parts = [seed, tag, *extra, key_text(as_list(key))]
    return df.withColumn(name, h(*parts))


def _order(key) -> list[Column]:
    return [F.col(_H)] + [F.col(k) for k in as_list(key)]


def _content(df: DataFrame) -> Column:
    cols = [f.name for f in df.schema.fields if f.dataType.typeName() != "map" and not f.name.startswith("_")]
    return F.xxhash64(*cols) if cols else F.lit(0).cast("bigint")


def dense_position(df: DataFrame, key, seed, tag: str = "pos", parts=(), name: str = "pos", extra: tuple = ()) -> DataFrame:
    """0-based ordinal in (h, key, content) order within each partition value (SO4).

    The rows are range-partitioned once by that order and kept in the shared checkpoint
    folder; offsets come from one count per range partition. Only the first partition value
    of a range partition can have started before it, so the table of offsets has at most
    one row per range partition whatever the partition axis.
    """
    parts = as_list(parts)
    cols = df.columns
    d = with_hash(df, key, seed, tag, extra)
    d = d.withColumn(_H2, _content(df)).withColumn(_R, F.monotonically_increasing_id())
    order = [*parts, *_order(key), _H2, _R]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    checkpoint_dir(df.sparkSession)
    d = d.repartitionByRange(n, *order).withColumn(_P, F.spark_partition_id()).checkpoint(eager=True)
    per = d.groupBy(_P, *parts).agg(F.count(F.lit(1)).alias("_c"))
    ahead = Window.partitionBy(*parts).orderBy(_P).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_off", F.sum("_c").over(ahead)).filter(F.col("_off") > 0)
    per = per.select(F.col(_P).alias("_p2"), *[F.col(p).alias(f"_k_{i}") for i, p in enumerate(parts)], "_off")
    on = F.col(_P) == F.col("_p2")
    for i, p in enumerate(parts):
        on = on & F.col(p).eqNullSafe(F.col(f"_k_{i}"))
    d = d.join(F.broadcast(per), on, "left")  # at most one row per range partition
    rn = F.row_number().over(Window.partitionBy(_P, *parts).orderBy(*_order(key), _H2, _R))
    return d.withColumn(name, (F.coalesce("_off", F.lit(0)) + rn - 1).cast("bigint")).select(*cols, name)


def _wanted(hist: DataFrame, parts: list[str], n) -> DataFrame:
    """(parts…, _n, _total): rows asked for and rows there, one row per partition value."""
    total = hist.groupBy(*parts).agg(F.sum("_c").alias("_total"))
    if isinstance(n, DataFrame):
        ask = n.select(*[F.col(p).alias(f"_k_{i}") for i, p in enumerate(parts)], F.col("n").cast("bigint").alias("_n"))
        on = F.lit(True)
        for i, p in enumerate(parts):
            on = on & F.col(p).eqNullSafe(F.col(f"_k_{i}"))
        return ask.join(total, on, "left").select(
            *[F.col(f"_k_{i}").alias(p) for i, p in enumerate(parts)], "_n", F.coalesce("_total", F.lit(0)).alias("_total"))
    ncol = n if isinstance(n, Column) else F.lit(int(n))
    return total.withColumn("_n", ncol.cast("bigint")).withColumn("_total", F.coalesce("_total", F.lit(0)))


def first_n(df: DataFrame, n, key, seed, tag: str = "sample", parts=(), bits: int = DEFAULT_BITS,
            extra: tuple = (), at_most: bool = False) -> DataFrame:
    """Exactly n rows per partition value: the first in (h, key, content) order.

    ``n``: int, Column over ``parts``, or DataFrame(parts…, n); 0 gives no rows. More than
    there are is a ``ValueError`` naming the partition value, or all rows with ``at_most``.
    """
    parts = as_list(parts)
    cols = df.columns
    d = with_hash(df, key, seed, tag, extra).withColumn(_B, F.shiftright(F.col(_H), HASH_BITS - bits))
    hist = d.groupBy(*parts, _B).agg(F.count(F.lit(1)).alias("_c"))
    checkpoint_dir(df.sparkSession)
    hist = hist.checkpoint(eager=True)  # at most 2**bits rows per partition value
    want = _wanted(hist, parts, n)
    if not at_most:
        short = want.filter(F.col("_n") > F.col("_total")).limit(1).collect()
        if short:
            where = ", ".join(f"{p}={short[0][p]!r}" for p in parts)
            raise ValueError(f"{short[0]['_n']} rows asked for, {short[0]['_total']} there" + (f" ({where})" if where else ""))
    run = Window.partitionBy(*parts).orderBy(_B).rowsBetween(Window.unboundedPreceding, 0)
    cum = hist.withColumn("_cum", F.sum("_c").over(run))
    want = want.select(*[F.col(p).alias(f"_k_{i}") for i, p in enumerate(parts)], "_n")
    on = F.lit(True)
    for i, p in enumerate(parts):
        on = on & F.col(p).eqNullSafe(F.col(f"_k_{i}"))
    # per partition value the number of buckets below the cut, and what is left for the cut bucket
    cut = (cum.join(want, on).groupBy(*parts, "_n")
           .agg(F.coalesce(F.max(F.when(F.col("_cum") <= F.col("_n"), F.col(_B))), F.lit(-1)).alias("_bfull"),
                F.min(F.when(F.col("_cum") > F.col("_n"), F.col(_B))).alias("_bcut"),
                F.coalesce(F.max(F.when(F.col("_cum") <= F.col("_n"), F.col("_cum"))), F.lit(0)).alias("_before"))
           .select(*[F.col(p).alias(f"_k_{i}") for i, p in enumerate(parts)], "_bfull", "_bcut", (F.col("_n") - F.col("_before")).alias("_rem")))
    if parts:
        j = d.join(_small(cut), on)
    else:
        row = cut.first()  # three numbers
        full, at, rem = (row["_bfull"], row["_bcut"], row["_rem"]) if row else (-1, None, 0)
        j = d.withColumns({"_bfull": F.lit(full).cast("bigint"), "_bcut": F.lit(at).cast("bigint"), "_rem": F.lit(rem).cast("bigint")})
    whole = j.filter(F.col(_B) <= F.col("_bfull")).select(*cols)
    edge = j.filter((F.col(_B) == F.col("_bcut")) & (F.col("_rem") > 0)).select(*cols, "_rem")
    edge = dense_position(edge, key, seed, tag, parts, name="_pos", extra=extra)
    return whole.unionByName(edge.filter(F.col("_pos") < F.col("_rem")).select(*cols))


# Most rows of a table of cuts that is sent to all tasks; bits of the buckets of many prefixes.
SENT_ROWS = 100_000
PREFIX_BITS = 8


def _small(cut: DataFrame) -> DataFrame:
    """``cut``, sent to the tasks if it has few rows: the sampled rows are not shuffled for it."""
    return F.broadcast(cut) if cut.limit(SENT_ROWS + 1).count() <= SENT_ROWS else cut


def prefix_counts(df: DataFrame, key, seed, tag: str, parts, extra: tuple = (), bits: int = PREFIX_BITS) -> DataFrame:
    """(parts…, _b, _c, _cum): rows per top bits of the hash, and those up to there; at most 2**bits rows per partition value."""
    parts = as_list(parts)
    d = with_hash(df, key, seed, tag, extra).withColumn(_B, F.shiftright(F.col(_H), HASH_BITS - bits))
    checkpoint_dir(df.sparkSession)
    hist = d.groupBy(*parts, _B).agg(F.count(F.lit(1)).alias("_c")).checkpoint(eager=True)
    run = Window.partitionBy(*parts).orderBy(_B).rowsBetween(Window.unboundedPreceding, 0)
    return hist.withColumn("_cum", F.sum("_c").over(run))


def prefixes(df: DataFrame, counts: DataFrame, sizes: DataFrame, key, seed, tag: str, parts, by, extra: tuple = (),
             bits: int = PREFIX_BITS) -> DataFrame:
    """Several "first n rows" of each partition value: the rows of ``df`` once for each row of ``sizes`` (parts…, by…,
    n: at most the rows there are) whose n reaches them, in the order of ``first_n``. ``counts``: its
    ``prefix_counts``. No column of ``parts`` is null.

    Rows are ordered in the buckets only that some n cuts; the others are taken whole."""
    parts, by, cols = as_list(parts), as_list(by), df.columns
    edge = (F.col("_cum") > F.col("n")) & (F.col("_cum") - F.col("_c") < F.col("n"))
    # per row of sizes: the bucket that n cuts, and the rows before it (none is cut if n is all rows or ends a bucket)
    cut = counts.join(_small(sizes), parts).groupBy(*parts, *by, "n").agg(
        F.coalesce(F.max(F.when(F.col("_cum") <= F.col("n"), F.col(_B))), F.lit(-1)).alias("_bfull"),
        F.max(F.when(edge, F.col(_B))).alias("_bcut"), F.max(F.when(edge, F.col("n") - F.col("_cum") + F.col("_c"))).alias("_rem"))
    checkpoint_dir(df.sparkSession)
    cut = cut.checkpoint(eager=True)
    d = with_hash(df, key, seed, tag, extra).withColumn(_B, F.shiftright(F.col(_H), HASH_BITS - bits))
    last = cut.groupBy(*parts).agg(F.max(F.greatest("_bfull", F.coalesce("_bcut", F.lit(-1)))).alias("_last"))
    near = d.join(_small(last), parts).filter(F.col(_B) <= F.col("_last")).select(*cols, _B).checkpoint(eager=True)
    whole = near.join(_small(cut.select(*parts, *by, "_bfull")), parts).filter(F.col(_B) <= F.col("_bfull")).select(*cols, *by)
    cuts = cut.filter(F.col("_bcut").isNotNull()).select(*parts, *by, F.col("_bcut").alias(_B), "_rem")
    edges = near.join(_small(cuts.select(*parts, _B).distinct()), [*parts, _B]).checkpoint(eager=True)
    edges = dense_position(edges.withColumnRenamed(_B, "cut"), key, seed, tag, [*parts, "cut"], name="_pos", extra=extra)
    edges = edges.withColumnRenamed("cut", _B).join(_small(cuts), [*parts, _B]).filter(F.col("_pos") < F.col("_rem"))
    return whole.unionByName(edges.select(*cols, *by))


def rank_in(df: DataFrame, key, seed, tag: str, parts=(), name: str = "rank", extra: tuple = ()) -> DataFrame:
    """1-based rank in (h, key) order within ``parts`` (WI4)."""
    return dense_position(df, key, seed, tag, parts, name="_pos", extra=extra).withColumn(
        name, (F.col("_pos") + 1).cast("bigint")).drop("_pos")


# --- SA1 - SA4 -----------------------------------------------------------------


def sample_n(df: DataFrame, n: int, key, seed, tag: str = "sample", bits: int = DEFAULT_BITS) -> DataFrame:
    """SA1: exactly n rows without replacement; n must be in (0, rows]."""
    if n <= 0:
        raise ValueError(f"a sample needs at least one row, not {n}")
    return first_n(df, n, key, seed, tag, bits=bits)


def take_n(df: DataFrame, n: int, key, seed, tag: str = "sample") -> DataFrame:
    """SO2: small-n form; TakeOrderedAndProject keeps only n rows per task."""
    return with_hash(df, key, seed, tag).orderBy(*_order(key)).limit(n).drop(_H)


def group_counts(pos: DataFrame, group: str = "grp") -> DataFrame:
    """AG2: positives per group -> (grp, n)."""
    return pos.groupBy(group).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def sample_matched(neg: DataFrame, pos: DataFrame, key, seed, group: str = "grp", tag: str = "matched",
                   bits: int = DEFAULT_BITS) -> DataFrame:
    """SA2: per group as many negatives as that group has positives."""
    return first_n(neg, group_counts(pos, group), key, seed, tag, parts=[group], bits=bits)


def sample_balanced(neg: DataFrame, pos: DataFrame, key, seed, tag: str = "balanced",
                    bits: int = DEFAULT_BITS) -> DataFrame:
    """SA3: |P| negatives, ungrouped."""
    return first_n(neg, pos.count(), key, seed, tag, bits=bits)


def undersample_majority(df: DataFrame, key, seed, label: str = "y", tag: str = "under",
                         bits: int = DEFAULT_BITS) -> DataFrame:
    """SA4: all of class 1 plus n1 rows of class 0 (class 0 first)."""
    pos = df.filter(F.col(label) == 1)
    neg = df.filter(F.col(label) == 0)
    return sample_balanced(neg, pos, key, seed, tag, bits).unionByName(pos)


# --- SA5 - SA11: bags ----------------------------------------------------------


def resolve_max_samples(max_samples, n_u: int, n_p: int | None = None) -> int:
    """int -> itself; float f -> int(f * |U|); 'n_pos' -> |P|. Must be in (0, |U|]."""
    if max_samples == "n_pos":
        m = int(n_p)
    elif isinstance(max_samples, bool):
        raise ValueError("max_samples must be a number")
    elif isinstance(max_samples, int):
        m = max_samples
    else:
        m = int(float(max_samples) * n_u)
    if not (0 < m <= n_u):
        raise ValueError(f"max_samples gives {m} draws; 1 to {n_u} unlabelled rows can be drawn")
    return m


def bootstrap_draws(spark, n_bags: int, m: int | list[int], n_u: int | list[int], seed, axis=(),
                    axis_values: list[tuple] | None = None, first_bag: int = 0, tag: str = "boot",
                    draws_per_partition: int = 1 << 20, aggregate: bool = True, axis_types: list | None = None) -> DataFrame:
    """SA5: per bag, m ordinals uniform with replacement from [0, |U|).

    Returns (axis…, bag, pos, w) with w = multiplicity (AG5: bincount; zero rows
    absent). Draws come from a distributed ``range`` and are aggregated map-side
    before the shuffle. With an axis (repeats, cells, groups…) ``axis_values`` lists
    the axis tuples and ``m`` / ``n_u`` give one value per tuple: the draw id is
    split into (axis index, bag, draw) arithmetically, so the whole grid of bags is
    one range. Bag ids start at ``first_bag`` so a warm start adds bags without
    changing the old ones (SA10).
    """
    axis = as_list(axis)
    if not axis:
        axis_values, m, n_u = [()], [int(m)], [int(n_u)]
    r = _drawn_ordinals(spark, n_bags, m, n_u, seed, axis, axis_values, first_bag, tag, draws_per_partition, axis_types)
    if not aggregate:
        return r.select(*axis, "bag", "draw", "pos")
    return r.groupBy(*axis, "bag", "pos").agg(F.count(F.lit(1)).cast("int").alias("w"))


def _axis_columns(r: DataFrame, axis: list[str], axis_values: list[tuple], axis_types: list | None) -> DataFrame:
    """Adds the axis value of the axis index ``_ai``."""
    for i, a in enumerate(axis):
        value = F.element_at(F.array(*[F.lit(t[i]) for t in axis_values]), F.col("_ai") + 1)
        r = r.withColumn(a, value.cast(axis_types[i]) if axis_types else value)
    return r


def _drawn_ordinals(spark, n_bags, m, n_u, seed, axis, axis_values, first_bag, tag, draws_per_partition, axis_types) -> DataFrame:
    """One row per draw: (axis…, _ai: index of the axis value, bag, draw, pos)."""
    m_max = max(m)
    per_axis = n_bags * m_max
    total = per_axis * len(axis_values)
    nparts = max(1, math.ceil(total / draws_per_partition))
    r = spark.range(0, total, 1, nparts)
    ai = (F.col("id") / F.lit(per_axis)).cast("int")
    within = F.col("id") % F.lit(per_axis)
    r = r.select(ai.alias("_ai"), (within / F.lit(m_max)).cast("int").alias("_bi"), (within % F.lit(m_max)).alias("draw"))
    r = r.withColumn("bag", (F.col("_bi") + F.lit(first_bag)).cast("int"))
    if axis:
        idx = F.col("_ai") + 1
        r = r.filter(F.col("draw") < F.element_at(F.array(*[F.lit(int(v)) for v in m]), idx))
        r = _axis_columns(r, axis, axis_values, axis_types)
        nu = F.element_at(F.array(*[F.lit(int(v)) for v in n_u]), idx).cast("bigint")
        # the internal single-axis placeholder is not part of the hash text
        hcol = h(seed, tag, *[F.col(a) for a in axis if not a.startswith("_")], F.col("bag"), F.col("draw"))
    else:
        nu = F.lit(int(n_u[0])).cast("bigint")
        hcol = h(seed, tag, F.col("bag"), F.col("draw"))
    return r.withColumn("pos", (hcol % nu).cast("bigint"))


# A row's bag and how often it drew the row as one number: bag * 2^31 + times.
TIMES = 1 << 31


# Fixed value: draws that are hashed together.
DRAWS_AT_ONCE = 1 << 16


def _hash_starts(spark, seed, tag: str, axis: list[str], axis_values: list[tuple], axis_types: list | None) -> list[bytes]:
    """Of each axis value, the text that its draws' hashes begin with (the bag and the draw follow), as Spark writes it."""
    # the internal single-axis placeholder is not part of the hash text
    used = [i for i, a in enumerate(axis) if not a.startswith("_")]
    plain = all(t[i] is None or type(t[i]) in (int, str) for t in axis_values for i in used)
    if plain:  # null parts are left out, as concat_ws does
        texts = [[str(t[i]) for i in used if t[i] is not None] for t in axis_values]
    else:
        typed = lambda v, i: F.lit(v).cast(axis_types[i]) if axis_types else F.lit(v)
        row = spark.range(1).select(F.array(*[F.array(*[typed(t[i], i).cast("string") for i in used]) for t in axis_values])).first()
        texts = [[v for v in own if v is not None] for own in row[0]]
    return ["|".join([str(seed), tag, *own, ""]).encode() for own in texts]


def bootstrap_lists(spark, n_bags: int, m: list[int], n_u: list[int], seed, axis: list[str], axis_values: list[tuple],
                    first_bag: int = 0, tag: str = "boot", axis_types: list | None = None) -> DataFrame:
    """The draws of ``bootstrap_draws`` by ordinal: (axis…, pos, _drawn), where ``_drawn`` lists the bags that drew it
    in order, as bag * ``TIMES`` + times.

    Tasks hash the draws of a range in arrays (``numbered_hash``). A draw crosses once to the partition of its ordinal;
    a partition (of about ``per`` draws, as ordinals are hashed) sorts them and counts equal ones."""
    import numpy as np
    import pyarrow as pa

    per, width = 1 << 20, max(n_u)
    total = sum(n_bags * v for v in m)
    nparts = max(spark.sparkContext.defaultParallelism, math.ceil(total / per))
    starts = _hash_starts(spark, seed, tag, axis, axis_values, axis_types)
    ends, sizes, of = np.cumsum([n_bags * v for v in m]), np.array(m), np.array(n_u)  # three numbers per axis value

    def draw(it):
        for chunk in (c for batch in it for c in batch.column(0).to_pylist()):
            ids = np.arange(chunk * DRAWS_AT_ONCE, min((chunk + 1) * DRAWS_AT_ONCE, total))
            ai = np.searchsorted(ends, ids, side="right")
            bag, number = np.divmod(ids - (ends[ai] - n_bags * sizes[ai]), sizes[ai])
            own = ai * n_bags + bag
            first = own[0]
            texts = [starts[k // n_bags] + f"{k % n_bags + first_bag}|".encode() for k in range(first, own[-1] + 1)]
            at = ai * width + numbered_hash(texts, own - first, number) % of[ai]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array((bag + first_bag).astype(np.int32))], names=["_at", "bag"])

    # the ordinal among those of all axis values, and the bag
    chunks = math.ceil(total / DRAWS_AT_ONCE)
    r = spark.range(0, chunks, 1, max(1, min(chunks, nparts))).mapInArrow(draw, "_at bigint, bag int")

    def lists(it):
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in it]
        if not got:
            return
        both = np.sort(np.concatenate([at * n_bags + (bag - first_bag) for at, bag in got]))
        at, bag = np.divmod(both, n_bags)
        bag += first_bag
        new = np.append(True, (at[1:] != at[:-1]) | (bag[1:] != bag[:-1]))  # first draw of an ordinal by a bag
        first = np.flatnonzero(new)
        at, code = at[first], bag[first] * TIMES + np.diff(np.append(first, len(at)))
        starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        ends = np.append(starts[1:], len(at))
        for k in range(0, len(starts), 1 << 14):
            lo, hi = starts[k:k + (1 << 14)], ends[k:k + (1 << 14)]
            drawn = pa.ListArray.from_arrays(pa.array(np.append(lo, hi[-1]) - lo[0], pa.int32()), pa.array(code[lo[0]:hi[-1]]))
            yield pa.RecordBatch.from_arrays([pa.array((at[lo] // width).astype(np.int32)), pa.array(at[lo] % width), drawn], names=["_ai", "pos", "_drawn"])

    r = r.repartition(nparts, "_at").mapInArrow(lists, "_ai int, pos bigint, _drawn array<bigint>")
    return _axis_columns(r, axis, axis_values, axis_types).select(*axis, "pos", "_drawn")


def poisson_cdf(lam: float) -> list[float]:
    """P(X <= j) for j = 0, 1, … (the inverse-CDF steps), until the sum no longer moves in double precision."""
    out, p, cdf = [], math.exp(-lam), math.exp(-lam)
    while not out or cdf > out[-1] or len(out) < lam:
        out.append(cdf)
        p = p * lam / len(out)
        cdf += p
    return out


def poisson_weights(key, seed, n_bags: int, lam: float | Column, first_bag: int = 0, tag: str = "pois",
                    fast: bool = False) -> Column:
    """SA7: array of T Poisson(lam) weights, one per bag, recomputable from the hash.
    ``lam`` is the rate, or a column with the steps of its distribution (``poisson_cdf``).

    One compact expression: the bag ids are a sequence, each maps to a uniform and
    the weight is the number of CDF steps at or below it. ``fast`` (the scale path) hashes
    the key once to a number r below the prime ``PRIME`` and takes ((a r + c) mod PRIME + 1/2) / PRIME
    with the line (a, c) of the bag (``bag_sums.line``) instead of hashing per row and bag.
    """
    kt = key_text(as_list(key))
    cdf = lam if isinstance(lam, Column) else F.array(*[F.lit(float(c)) for c in poisson_cdf(lam)])
    if fast:
        from pubag.operators.learners.bag_sums import PRIME, line

        lines = [line(seed, tag, b) for b in range(first_bag, first_bag + n_bags)]
        slopes, starts = (F.array(*[F.lit(v).cast("bigint") for v in column]) for column in zip(*lines))
        # an array of one: the key is hashed once a row, whatever the number of bags
        row = F.array(h("row", kt) % F.lit(PRIME))
        number = lambda a, c, r: ((a * r + c) % F.lit(PRIME) + F.lit(0.5)) / F.lit(float(PRIME))
        us = F.flatten(F.transform(row, lambda r: F.zip_with(slopes, starts, lambda a, c: number(a, c, r))))
    else:
        bags = F.sequence(F.lit(first_bag), F.lit(first_bag + n_bags - 1))
        us = F.transform(bags, lambda b: uniform(h(seed, tag, b, kt)))
    return F.transform(us, lambda u: F.size(F.filter(cdf, lambda c: u >= c)))


def subsample_members(u_rows: DataFrame, key, n_bags: int, m: int, seed, axis=(), first_bag: int = 0, tag: str = "sub",
                      bits: int = DEFAULT_BITS) -> DataFrame:
    """SA6: per bag, m distinct rows of U (bootstrap=False) -> (axis…, bag, key…, w=1).

    Bag ids start at ``first_bag``; they and the axis values are part of the hash, so the
    bags of a warm start and of another axis value are new draws."""
    axis = as_list(axis)
    ids = F.sequence(F.lit(first_bag), F.lit(first_bag + n_bags - 1))
    bags = u_rows.select(*axis, *as_list(key)).withColumn("bag", F.explode(ids))
    # the internal single-axis placeholder is not part of the hash text
    extra = (*[F.col(a) for a in axis if not a.startswith("_")], F.col("bag"))
    picked = first_n(bags, m, key, seed, tag, parts=axis + ["bag"], bits=bits, extra=extra)
    return picked.withColumn("w", F.lit(1))


def feature_bag_hash(*parts) -> int:
    """Driver-side h(...) for small parameter tables (same text and bits as the column hash)."""
    import hashlib

    return int(hashlib.md5("|".join(str(p) for p in parts).encode()).hexdigest()[:15], 16)


def feature_bag(n_features: int, k: int, n_bags: int, seed, replace: bool = False, first_bag: int = 0) -> list[list[int]]:
    """SA9: per bag, k of d feature indices (driver-side table of T x k ints).

    Drawn from the same hash so that bag b gets the same features whatever T is.
    Without replacement: the k smallest hashes; with replacement: k hashed draws.
    """
    if not (0 < k <= n_features):
        raise ValueError(f"{k} features asked for, 1 to {n_features} possible")
    out = []
    for b in range(first_bag, first_bag + n_bags):
        if replace:
            out.append([feature_bag_hash(seed, "feat", b, i) % n_features for i in range(k)])
        elif k == n_features:
            out.append(list(range(n_features)))
        else:
            order = sorted(range(n_features), key=lambda j: (feature_bag_hash(seed, "feat", b, j), j))
            out.append(sorted(order[:k]))
    return out


# --- SA12 - SA19: splits -------------------------------------------------------


def holdout_n(df: DataFrame, n: int, key, seed, label: str = "y", tag: str = "holdout",
              bits: int = DEFAULT_BITS) -> tuple[DataFrame, DataFrame]:
    """SA12: n test rows of each class; train = every row whose key is not in test (JO1)."""
    test = first_n(df, n, key, seed, tag, parts=[label], bits=bits)
    train = df.join(test.select(*as_list(key)).distinct(), as_list(key), "left_anti")
    return train, test


# Most folds of a leave-one-group-out split: every fold trains a model and holds all other rows.
MAX_FOLDS = 1000


def leave_one_group_out(df: DataFrame, key, group: str = "grp") -> DataFrame:
    """SA13: one fold per group g: rows with role 'test' (group = g) or 'train' (key not in test).

    Result (fold, role, …). Rows go to the folds of the other groups in one projection; more
    than ``MAX_FOLDS`` groups are an error.
    """
    groups = [r[0] for r in df.select(group).distinct().limit(MAX_FOLDS + 1).collect()]
    if len(groups) > MAX_FOLDS:
        raise ValueError(f"more than {MAX_FOLDS} groups in column {group}")
    test = df.withColumn("fold", F.col(group)).withColumn("role", F.lit("test"))
    test_keys = test.select("fold", *as_list(key)).distinct()
    others = F.filter(F.array(*[F.lit(g) for g in groups]), lambda g: ~g.eqNullSafe(F.col(group)))
    train = df.withColumn("fold", F.explode(others)).withColumn("role", F.lit("train"))
    return test.unionByName(train.join(test_keys, ["fold", *as_list(key)], "left_anti"))


def class_sizes(df: DataFrame, label: str = "y") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).cast("bigint").alias("n_c"))


def stratified_sizes(df: DataFrame, test_frac: float, label: str = "y") -> DataFrame:
    """(label, n_test): round(frac * rows) test rows in all, shared by class size, whole parts first
    and the rest to the largest remainders (ties: smaller label)."""
    sizes = class_sizes(df, label)
    total = sizes.agg(F.sum("n_c")).first()[0] or 0
    n_test = math.floor(total * test_frac + 0.5)
    share = F.col("n_c") * F.lit(n_test)
    sizes = sizes.withColumn("_whole", F.floor(share / F.lit(max(1, total))).cast("bigint"))
    sizes = sizes.withColumn("_left", share - F.col("_whole") * F.lit(total))
    one = Window.orderBy(F.desc("_left"), label)  # one row per class
    spare = F.lit(n_test) - F.sum("_whole").over(Window.partitionBy())
    return sizes.select(label, (F.col("_whole") + F.when(F.row_number().over(one) <= spare, 1).otherwise(0)).cast("bigint").alias("n_test"))


def stratified_split(df: DataFrame, key, seed, test_frac: float = 0.2, label: str = "y",
                     tag: str = "strat") -> DataFrame:
    """SA14: adds ``is_test``: per class the first rows by hash, as many as its share of the test rows."""
    sizes = stratified_sizes(df, test_frac, label).withColumnRenamed(label, "_label")
    r = rank_in(df, key, seed, tag, parts=[label], name="_r")
    r = r.join(sizes, F.col(label).eqNullSafe(F.col("_label")))
    return r.withColumn("is_test", F.col("_r") <= F.col("n_test")).drop("_r", "n_test", "_label")


def stratified_kfold(df: DataFrame, key, seed, k: int, label: str = "y", tag: str = "kfold") -> DataFrame:
    """SA15 / WI5: fold = (rank within class - 1) % k; folds differ by at most 1 per class."""
    return dense_position(df, key, seed, tag, parts=[label], name="_pos").withColumn(
        "fold", (F.col("_pos") % F.lit(k)).cast("int")).drop("_pos")


def chunks(df: DataFrame, key, seed, size: int, tag: str = "chunk") -> DataFrame:
    """SA16: chunk = floor(position / size) over the sampled order."""
    return dense_position(df, key, seed, tag, name="_pos").withColumn(
        "chunk", (F.col("_pos") / F.lit(size)).cast("int")).drop("_pos")


def hide_labels(df: DataFrame, n_hide: int, key, seed, label: str = "y", tag: str = "hide",
                bits: int = DEFAULT_BITS) -> DataFrame:
    """SA17: y_train = 0 for the first n_hide positives in hash order (no more than there are); y_true kept."""
    hidden = first_n(df.filter(F.col(label) == 1), n_hide, key, seed, tag, bits=bits)
    hidden = hidden.select(*as_list(key)).withColumn("_hid", F.lit(True))
    out = df.join(hidden, as_list(key), "left")
    return out.withColumn("y_true", F.col(label)).withColumn(
        label, F.when(F.col("_hid"), F.lit(0)).otherwise(F.col(label)).cast("int")).drop("_hid")


def hide_sweep(df: DataFrame, levels: list[int], key, seed, label: str = "y", tag: str = "hide") -> DataFrame:
    """SA18: one rank, nested hidden sets: level column, y_train = 0 if rank <= level.

    Levels must differ and hide no more positives than there are."""
    levels = [int(v) for v in levels]
    n_pos = df.filter(F.col(label) == 1).count()
    if len(set(levels)) < len(levels) or not all(0 <= v <= n_pos for v in levels):
        raise ValueError(f"levels {levels} must be different numbers from 0 to the {n_pos} positives")
    pos = rank_in(df.filter(F.col(label) == 1), key, seed, tag, name="_r").select(*as_list(key), "_r")
    x = df.join(pos, as_list(key), "left").withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels])))
    return x.withColumn("y_true", F.col(label)).withColumn(
        label, F.when(F.col("_r").isNotNull() & (F.col("_r") <= F.col("level")), 0).otherwise(F.col(label)).cast("int")
    ).drop("_r")


def repeats(df: DataFrame, n: int, name: str = "repeat") -> DataFrame:
    """SA19: rows x repeat ids (the repeat goes into every later hash)."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
