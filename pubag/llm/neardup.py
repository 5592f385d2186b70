"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian verification, exact check.

1. Each text becomes the set of its distinct word shingles (64-bit hashes) and a MinHash signature.
   Texts with equal sets form a class, which from here on is one node with a number of its own.
2. Bands of the signature put nodes into buckets. Every member is compared with the smallest and the
   largest member of its bucket (two stars, so pairs grow with the members, not with their square).
3. A pair is verified sequentially: after each batch of signature positions it is dropped if the
   posterior probability (uniform prior) that its similarity reaches the threshold, given the matches so
   far, is below ``MISS``. Buckets whose members are still in several groups after the stars compare
   only members of different groups, in blocks, and report a spanning forest of the survivors.
4. Survivors connect nodes to clusters. Each cluster gets one text a node; inside, all pairs that pass the
   sequential test are checked on the full sets, unless already connected, until every remaining pair of
   different groups has failed. The links found, and one between the classes of each document id, give the
   components; only then are they named by documents.

Bands and rows follow the threshold so that a pair at the threshold misses all bands with probability
below ``BAND_MISS``. No pair inside a group of copies is emitted more than the forest needs; buckets and
clusters beyond a task's capacity are split into blocks: first every block against one pivot block, then
only what is not yet in the group's main component against all blocks.

Cases: null, empty and blank texts have an empty set, no links, and stand for themselves. Fewer words
than a shingle are one shingle. Rows that share a document id are one document (its links are those of all
its rows). Rows without an id are documents of their own; as a name, a null id counts as the largest id and
is returned as null. An empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubag.llm.common import NO_ID, batches, doc_key, no_key, saved
from pubag.llm.components import components

#: Signature positions at most, chance to miss all bands at the threshold, chance to prune a true pair.
HASHES, BAND_MISS, MISS = 128, 1e-6, 1e-7

#: Positions compared before each posterior test; nodes of a bucket block; shingles of a cluster block.
BATCH, BUCKET_BLOCK, CLUSTER_BLOCK = 25, 2048, 1 << 20

_rng = np.random.default_rng(20)
_A = _rng.integers(0, 1 << 62, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 62, HASHES, dtype=np.uint64)
_C = _rng.integers(0, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_plan(threshold: float) -> tuple[int, int]:
    """(bands, rows): the most selective split that misses a pair at the threshold rarely enough."""
    for rows in range(8, 1, -1):
        if (1 - threshold**rows) ** (HASHES // rows) <= BAND_MISS:
            return HASHES // rows, rows
    return HASHES, 1


def needed_matches(threshold: float, positions: int) -> list[tuple[int, int]]:
    """(positions compared, least matches to go on): below, P(similarity >= threshold | matches) < ``MISS``.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose tail above t is the chance of at
    most m successes in n + 1 trials of probability t."""
    out = []
    for n in [*range(BATCH, positions, BATCH), positions]:
        tail, m = 0.0, -1
        while tail < MISS and m < n:
            m += 1
            tail += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    k = min(width, len(h))
    s = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        s += h[i:len(h) - k + 1 + i] * _C[i]
    return np.unique(_mixed(s))


def signature(s: np.ndarray, positions: int) -> np.ndarray:
    low = np.full(positions, (1 << 64) - 1, dtype=np.uint64)
    a, b = _A[:positions, None], _B[:positions, None]
    for at in range(0, len(s), 2048):
        np.minimum(low, (a * s[None, at:at + 2048] + b).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def _set_hash(s: np.ndarray) -> tuple[int, int]:
    a, b = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype="<i8").tolist()
    return a, b


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with _doc, _t1, _t2: the id (null as the largest) and a 128-bit hash of the text."""
    return (docs.withColumn("_doc", doc_key(id_col)).withColumn("_t1", F.xxhash64(text_col)).withColumn("_t2", F.xxhash64(F.lit(1), text_col)))


def signatures(texts: DataFrame, width: int, positions: int) -> DataFrame:
    """(doc, t1, t2, n, h1, h2, sig): size, 128-bit hash and MinHash signature of every text's shingle set,
    from ``texts`` (doc, t1, t2, text)."""
    schema = pa.schema([*((c, pa.int64()) for c in ("doc", "t1", "t2", "n", "h1", "h2")), ("sig", pa.binary())])

    def run(it):
        def rows():
            for batch in it:
                for at in range(0, batch.num_rows, 256):
                    for doc, t1, t2, text in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                        s = shingles(text, width)
                        yield doc, t1, t2, len(s), *_set_hash(s), signature(s, positions).tobytes() if len(s) else None

        yield from batches(rows(), schema)

    return texts.select("doc", "t1", "t2", "text").mapInArrow(run, "doc bigint, t1 bigint, t2 bigint, n bigint, h1 bigint, h2 bigint, sig binary")


def _matrix(column: pa.Array, positions: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, positions)


def band_members(nodes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(key, node) for every band of every node (node, sig)."""
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64())])

    def run(it):
        for batch in it:
            if not batch.num_rows:
                continue
            sig, node = _matrix(batch.column("sig"), bands * rows).astype(np.uint64), batch.column("node").to_numpy()
            for band in range(bands):
                key = np.full(len(sig), band + 1, dtype=np.uint64) * _C[63]
                for r in range(rows):
                    key = _mixed(key + sig[:, band * rows + r] * _C[r])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(node)], schema=schema)

    return nodes.select("node", "sig").mapInArrow(run, "key bigint, node bigint")


def _passes(left: np.ndarray, right: np.ndarray, plan: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of signature rows: indices that survive every posterior test, and their matches."""
    alive, matches, at = np.arange(len(left)), np.zeros(len(left), dtype=np.int64), 0
    for n, need in plan:
        matches = matches + (left[alive, at:n] == right[alive, at:n]).sum(axis=1)
        ok = matches >= need
        alive, matches, at = alive[ok], matches[ok], n
    return alive, matches


def similar_pairs(pairs: DataFrame, nodes: DataFrame, plan: list[tuple[int, int]]) -> DataFrame:
    """Those of ``pairs`` (a, b) that pass the sequential test on the signatures in ``nodes``."""
    positions = plan[-1][0]
    sig = nodes.select("node", "sig")
    both = (pairs.join(sig.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a")
            .join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b"))

    def run(it):
        for batch in it:
            if batch.num_rows:
                keep, _ = _passes(_matrix(batch.column("sa"), positions), _matrix(batch.column("sb"), positions), plan)
                yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep)), batch.column("b").take(pa.array(keep))], names=["a", "b"])

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def forest(sig: tuple[np.ndarray, np.ndarray], node: tuple[np.ndarray, np.ndarray], comp: tuple[np.ndarray, np.ndarray],
           plan: list[tuple[int, int]], check=None) -> Iterator[tuple[int, int]]:
    """Links between left and right nodes of different components that pass the sequential test (and
    ``check``), as many as connect everything that the links connect. Pairs are tried in blocks of left
    rows, likeliest first, and skipped once connected."""
    known, at = np.unique(np.concatenate(comp), return_inverse=True)
    group = np.arange(len(known))
    left, right = at[:len(comp[0])], at[len(comp[0]):]
    step = max(1, (1 << 17) // max(1, len(right)))
    for k in range(0, len(left), step):
        i, j = np.nonzero(group[left[k:k + step]][:, None] != group[right][None, :])
        for part in range(0, len(i), 1 << 16):
            pi, pj = i[part:part + (1 << 16)] + k, j[part:part + (1 << 16)]
            apart = group[left[pi]] != group[right[pj]]
            pi, pj = pi[apart], pj[apart]
            alive, matches = _passes(sig[0][pi], sig[1][pj], plan)
            for x in alive[np.argsort(-matches, kind="stable")].tolist():
                a, b = group[left[pi[x]]], group[right[pj[x]]]
                if a != b and (check is None or check(pi[x], pj[x])):
                    group[group == b] = a
                    yield int(node[0][pi[x]]), int(node[1][pj[x]])


def groups(it, keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of batches sorted by their first ``keys`` columns, one group at a time."""
    now, held = None, []
    for batch in it:
        for at in range(0, batch.num_rows, 1024):
            for row in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns)):
                if row[:keys] != now:
                    if held:
                        yield now, held
                    now, held = row[:keys], []
                held.append(row[keys:])
    if held:
        yield now, held


def apart(members: DataFrame, capacity: int) -> DataFrame:
    """Members (g, node, comp, weight) of groups with several components, dealt into tasks (g, i, j): on the
    left those outside the group's main component, in blocks i; on the right all members, in blocks j."""
    of = members.groupBy("g", "comp").agg(F.sum("weight").alias("w"))
    sizes = (of.groupBy("g").agg(F.max_by("comp", F.struct("w", "comp")).alias("main"), F.sum("w").alias("all"), F.max("w").alias("most"))
             .where(F.col("all") > F.col("most"))
             .select("g", "main", F.ceil(F.col("all") / capacity).cast("int").alias("nj"),
                     F.ceil((F.col("all") - F.col("most")) / capacity).cast("int").alias("ni")))
    # as a table of its own, so that the join is one that Spark sizes, or splits where a group is hot
    sizes = saved(sizes, "open_groups")
    dealt = members.join(sizes, "g").withColumn("at", F.xxhash64("node"))
    right = dealt.withColumn("left", F.lit(False)).withColumn("j", F.pmod("at", "nj").cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("ni") - 1)))
    left = (dealt.where("comp <> main").withColumn("left", F.lit(True)).withColumn("i", F.pmod("at", "ni").cast("int"))
            .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nj") - 1))))
    cols = ["g", "i", "j", "left", *[c for c in members.columns if c not in ("g", "weight")]]
    return right.select(*cols).unionByName(left.select(*cols))


def _together(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys)


def clusters(nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, comp): connected candidates that pass the sequential test, from ``nodes`` (node, sig)."""
    bands, rows = band_plan(threshold)
    plan = needed_matches(threshold, bands * rows)
    member = band_members(nodes, bands, rows)
    bucket = (member.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("size")).where("lo <> hi"))
    bucket = saved(bucket, "shared_keys")
    shared = saved(member.join(bucket, "key"), "buckets")
    stars = (shared.select(F.col("lo").alias("a"), F.col("node").alias("b"))
             .union(shared.select(F.col("node").alias("a"), F.col("hi").alias("b"))).where("a <> b").distinct())
    near = saved(similar_pairs(stars, nodes, plan), "stars")
    comp = components(near)

    rest = (shared.where("size > 3").select(F.col("key").alias("g"), "node").join(comp, "node", "left")
            .select("g", "node", F.coalesce("comp", "node").alias("comp"), F.lit(1).alias("weight")))
    open_ = apart(rest, BUCKET_BLOCK).join(nodes.select("node", "sig"), "node").select("g", "i", "j", "left", "node", "comp", "sig")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    positions = bands * rows

    def run(it):
        def links():
            for _, rows in groups(it, 3):
                side = [[r[1:] for r in rows if r[0]], [r[1:] for r in rows if not r[0]]]
                if side[0] and side[1]:
                    node, comp = ([np.array([r[c] for r in s], dtype=np.int64) for s in side] for c in (0, 1))
                    sig = [np.frombuffer(b"".join(r[2] for r in s), dtype=np.uint32).reshape(-1, positions) for s in side]
                    yield from forest(sig, node, comp, plan)

        yield from batches(links(), schema)

    more = saved(_together(open_, ["g", "i", "j"]).mapInArrow(run, "a bigint, b bigint"), "rest")
    return components(near.union(more))


def verified_links(texts: DataFrame, nodes: DataFrame, copies: DataFrame, comp: DataFrame, width: int, threshold: tuple[int, int]) -> DataFrame:
    """(a, b): links confirmed on the full shingle sets, as many as connect what the links connect. ``texts``
    (doc, t1, t2, text) has the text of each node's ``first`` row, several times if it is in ``copies``."""
    t = threshold[0] / threshold[1]
    bands, rows = band_plan(t)
    positions, plan = bands * rows, needed_matches(t, bands * rows)
    member = comp.join(nodes, "node").select(F.col("comp").alias("g"), "node", "first.*", "n", "sig")
    if copies.limit(1).count():
        member = member.join(copies, ["doc", "t1", "t2"], "left")
        found = texts.join(member, ["doc", "t1", "t2"])
        once = found.where("many").groupBy("node").agg(*(F.first(c).alias(c) for c in ("g", "n", "sig", "text")))
        cols = ["g", "node", "n", "sig", "text"]
        texts = found.where("many IS NULL").select(*cols).union(once.select(*cols))
    else:
        texts = texts.join(member, ["doc", "t1", "t2"]).select("g", "node", "n", "sig", "text")
    sizes = comp.join(nodes.select("node", "n"), "node").groupBy(F.col("comp").alias("g")).agg(F.sum("n").alias("w"))
    sizes = saved(sizes.select("g", F.ceil(F.col("w") / CLUSTER_BLOCK).cast("int").alias("nb")), "clusters")
    block = F.pmod(F.xxhash64("node"), "nb").cast("int")
    first = (texts.join(sizes, "g").withColumn("block", block)
             .withColumn("j", F.explode(F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("nb") - 1)).otherwise(F.array("block"))))
             .select("g", F.lit(0).alias("i"), "j", F.lit(None).cast("boolean").alias("left"), "node", F.col("node").alias("comp"), "sig", "text"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    num, den = threshold

    def run(it):
        def links():
            for _, rows in groups(it, 3):
                sets = {}
                for r in rows:
                    if r[1] not in sets:
                        sets[r[1]] = shingles(r[4], width)
                if rows[0][0] is None:
                    rows.sort(key=lambda r: r[1])
                    side = [rows, rows]
                else:
                    side = [[r for r in rows if r[0]], [r for r in rows if not r[0]]]
                if not side[0] or not side[1]:
                    continue
                node, comp = ([np.array([r[c] for r in s], dtype=np.int64) for s in side] for c in (1, 2))
                sig = [np.frombuffer(b"".join(r[3] for r in s), dtype=np.uint32).reshape(-1, positions) for s in side]

                def check(i, j, node=node, sets=sets):
                    a, b = sets[int(node[0][i])], sets[int(node[1][j])]
                    if den * min(len(a), len(b)) < num * max(len(a), len(b)):
                        return False
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    return den * both >= num * (len(a) + len(b) - both)

                yield from forest(sig, node, comp, plan, check)

        yield from batches(links(), schema)

    links = saved(_together(first, ["g", "i", "j"]).mapInArrow(run, "a bigint, b bigint"), "links")
    if not sizes.where("nb > 1").limit(1).count():
        return links
    now = components(links).withColumnRenamed("comp", "now")
    large = (texts.join(sizes.where("nb > 1"), "g").join(now, "node", "left")
             .select("g", "node", F.coalesce("now", "node").alias("comp"), F.col("n").alias("weight"), "sig", "text"))
    rest = apart(large, CLUSTER_BLOCK).select("g", "i", "j", "left", "node", "comp", "sig", "text")
    return links.union(saved(_together(rest, ["g", "i", "j"]).mapInArrow(run, "a bigint, b bigint"), "links_rest"))


def classes(docs: DataFrame, width: int, threshold: tuple[int, int], id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The signatures of all rows; the classes of equal sets (node, h1, h2, n, sig, ``first``: the smallest
    doc, t1, t2 of its rows); (doc, t1, t2, many) of what several rows hold; the links between classes."""
    t = threshold[0] / threshold[1]
    bands, rows = band_plan(t)
    texts = keyed(docs.select(id_col, text_col), id_col, text_col).select(*(F.col(f"_{c}").alias(c) for c in ("doc", "t1", "t2")), F.col(text_col).alias("text"))
    sized = saved(signatures(texts, width, bands * rows), "signatures")
    nodes = sized.where("n > 0").groupBy("h1", "h2").agg(F.min(F.struct("doc", "t1", "t2")).alias("first"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    nodes = saved(nodes.withColumn("node", F.monotonically_increasing_id()), "classes")
    copies = sized.groupBy("doc", "t1", "t2").agg(F.count("*").alias("c")).where("c > 1")
    copies = saved(copies.select("doc", "t1", "t2", F.lit(True).alias("many")), "copies")
    return sized, nodes, copies, verified_links(texts, nodes, copies, clusters(nodes, t), width, threshold)


def same_id(sized: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): links between the classes of each id whose rows are in several."""
    own = sized.where((F.col("n") > 0) & (F.col("doc") != NO_ID))
    several = own.groupBy("doc").agg(F.min(F.struct("h1", "h2")).alias("lo"), F.max(F.struct("h1", "h2")).alias("hi")).where("lo <> hi").select("doc")
    at = saved(own.join(saved(several, "several"), "doc").join(nodes.select("h1", "h2", "node"), ["h1", "h2"]).select("doc", "node"), "same_id")
    least = saved(at.groupBy("doc").agg(F.min("node").alias("a")), "same_id_least")
    return at.join(least, "doc").select("a", F.col("node").alias("b")).where("a <> b")


def _grouped(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(h1, h2, first, group) of every class."""
    return nodes.select("h1", "h2", "first", "node").join(components(links), "node", "left").select("h1", "h2", "first", F.coalesce("comp", "node").alias("group"))


def near_duplicates(docs: DataFrame, width: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``id_col``, ``n_shingles``, ``component_id`` (the smallest id reachable over links
    of Jaccard similarity ``threshold`` or more on ``width``-word shingles) and ``kept`` (it is that id)."""
    sized, nodes, _, links = classes(docs, width, threshold, id_col, text_col)
    found = saved(_grouped(nodes, links.union(same_id(sized, nodes))), "grouped")
    least = saved(found.groupBy("group").agg(F.min("first.doc").alias("component")), "components")
    found = found.join(least, "group").select("h1", "h2", "component")
    out = sized.select("doc", "n", "h1", "h2").join(found, ["h1", "h2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc"))
    return out.select(no_key(F.col("doc")).alias(id_col), F.col("n").alias("n_shingles"), no_key(component).alias("component_id"),
                      (F.col("doc") == component).alias("kept"))


def first_rows(docs: DataFrame, width: int = 5, threshold: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of all rows whose texts are connected by links, whatever
    their ids, one of the smallest id (null is the largest). Rows without words stay, once per id; without
    an id, all of them."""
    sized, nodes, copies, links = classes(docs, width, threshold, id_col, text_col)
    least = _grouped(nodes, links).groupBy("group").agg(F.min("first").alias("first")).select("first.*", F.lit(False).alias("all"))
    blank = sized.where((F.col("n") == 0) & (F.col("doc") != NO_ID)).groupBy("doc").agg(F.min(F.struct("t1", "t2")).alias("t"))
    free = sized.where((F.col("n") == 0) & (F.col("doc") == NO_ID)).select("doc", "t1", "t2", F.lit(True).alias("all")).distinct()
    stay = least.union(blank.select("doc", "t.t1", "t.t2", F.lit(False).alias("all"))).union(free).join(copies, ["doc", "t1", "t2"], "left")
    stay = saved(stay.select(*(F.col(c).alias(f"_{c}") for c in ("doc", "t1", "t2")), (F.col("many").isNotNull() & ~F.col("all")).alias("_several")), "stay")
    rows = keyed(docs, id_col, text_col).join(stay, ["_doc", "_t1", "_t2"])
    one = rows.where("NOT _several").select(*docs.columns)
    if not stay.where("_several").limit(1).count():
        return one
    again = rows.where("_several").groupBy("_doc", "_t1", "_t2").agg(F.min(F.struct(*docs.columns)).alias("_row"))
    return one.unionByName(again.select("_row.*"))
