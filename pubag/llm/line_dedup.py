"""Reversible line dedup: sharded cuckoo filters in front of exact reference-count tables.

The index holds, in the shared folder,

* ``refs``: rows (line key, document) with the number of rows of the document that hold it,
* ``counts``: one row per line key with its number of documents and the smallest of them,
* ``filters``: per shard of the key space one cuckoo filter of the keys that several documents share.

Inserting documents adds references and puts each key that becomes shared into its shard's filter;
deleting documents removes their references and takes each key that is no longer shared out of it, so
every insertion can be undone exactly. Both count the keys of the inserted or deleted documents again and write
those only; the tables before stay as they are, and are written as one after ``SEGMENTS`` changes. To find the lines to drop, references are probed against the
filters of their shard and only hits (shared keys and a few false positives) go on to the exact table.

A key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased, as a 128-bit
BLAKE2b digest; keys of fewer than ``min_length`` code points never count. A shared key keeps its lines
in the smallest document id that holds it (all of them, if it holds several) and loses them elsewhere.

Skew: references are dealt by (shard, salt), with as many salts as the shard's exact reference count
asks for, so a line that a third of all documents hold is probed by many tasks; counts are aggregated
before the shuffle; the exact join leaves a hot key to the adaptive skew join. Per-shard work is
bounded by the number of shards, which follows the number of keys.

Cases: a null or empty text is one empty line. Rows that share a document id are one document when
references are counted; each is returned. Rows without an id are documents of their own, one per distinct text
(told apart by a hash of it), so each gathers its own lines only and lines that only they share are dropped
too; they come after all ids, in the order of the hash, and are returned with a null id. An empty table gives an empty result. Only the id and text columns are read, others may have any name.
"""

from __future__ import annotations

import random
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pubag.llm.common import NO_ID, SPACES, batches, doc_key, saved

MIN_LENGTH = 10

#: Column that ``kept_rows`` adds.
LINES = "_lines"

#: Changes of an index after which its tables are written anew.
SEGMENTS = 8

#: Keys a shard should hold, most shards (bounds the broadcast table of their sizes), references a task probes.
SHARD_KEYS, MAX_SHARDS, TASK_REFS = 1 << 13, 1 << 20, 1 << 19


def line_key(line: str, min_length: int) -> bytes | None:
    line = line.strip(SPACES)
    return blake2b(line.encode().lower(), digest_size=16).digest() if len(line) >= min_length else None


# --- cuckoo filter -------------------------------------------------------------------------------

SLOTS, KICKS = 4, 200


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


class CuckooFilter:
    """Set of (k1, k2) keys with deletion: buckets of four 16-bit fingerprints, two buckets a key. Keys
    that find no place after ``KICKS`` moves are kept whole in a stash, so there are no false negatives."""

    def __init__(self, capacity: int):
        self.buckets = 1 << max(2, int(np.ceil(np.log2(max(1, capacity) / (SLOTS * 0.85)))))
        self.table = np.zeros((self.buckets, SLOTS), dtype=np.uint16)
        self.stash: set[tuple[int, int]] = set()

    def _places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(self.buckets - 1)
        mark = (_mix(k2) & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        first = _mix(k1) & mask
        return mark, first, first ^ (_mix(mark) & mask)

    def update(self, k1: np.ndarray, k2: np.ndarray, add: bool) -> None:
        rng, table = random.Random(0), self.table
        other = (_mix(np.arange(65536)) & np.uint64(self.buckets - 1)).astype(np.int64).tolist()
        for a, b, mark, first, second in zip(k1.tolist(), k2.tolist(), *(x.tolist() for x in self._places(k1, k2))):
            if not add:
                if (a, b) in self.stash:
                    self.stash.discard((a, b))
                    continue
                at = first if mark in table[first] else second
                slot = np.flatnonzero(table[at] == mark)
                if len(slot):
                    table[at, slot[0]] = 0
                continue
            if not (self._put(first, mark) or self._put(second, mark) or self._move(second, mark, other, rng)):
                self.stash.add((a, b))

    def _put(self, at: int, mark: int) -> bool:
        free = np.flatnonzero(self.table[at] == 0)
        if len(free):
            self.table[at, free[0]] = mark
        return len(free) > 0

    def _move(self, at: int, mark: int, other: list[int], rng: random.Random) -> bool:
        """Makes room by moving marks to their other bucket; undone if there is none."""
        done = []
        for _ in range(KICKS):
            slot = rng.randrange(SLOTS)
            done.append((at, slot, int(self.table[at, slot])))
            mark, self.table[at, slot] = int(self.table[at, slot]), mark
            at ^= other[mark]
            if self._put(at, mark):
                return True
        for at, slot, was in reversed(done):
            self.table[at, slot] = was
        return False

    def holds(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        mark, first, second = self._places(k1, k2)
        hit = (self.table[first] == mark[:, None]).any(axis=1) | (self.table[second] == mark[:, None]).any(axis=1)
        if self.stash:
            hit |= np.fromiter(((a, b) in self.stash for a, b in zip(k1.tolist(), k2.tolist())), bool, len(k1))
        return hit

    def to_bytes(self) -> bytes:
        stash = np.array(sorted(self.stash), dtype=np.int64).tobytes()
        return np.array([self.buckets], dtype=np.int64).tobytes() + self.table.tobytes() + stash

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        new = cls(0)
        new.buckets = int(np.frombuffer(raw, np.int64, 1)[0])
        new.table = np.frombuffer(raw, np.uint16, new.buckets * SLOTS, 8).reshape(-1, SLOTS).copy()
        stash = np.frombuffer(raw, np.int64, offset=8 + new.buckets * SLOTS * 2).reshape(-1, 2)
        new.stash = {tuple(x) for x in stash.tolist()}
        return new


# --- index ---------------------------------------------------------------------------------------


def ids_and_text(it):
    """(doc, part, text) of batches, in slices that keep Python's copies small."""
    for batch in it:
        for at in range(0, batch.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 256).columns))


def line_refs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """(k1, k2, doc, part, n): the distinct line keys of every document with its number of rows that hold them."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("doc", pa.int64()), ("part", pa.int64())])

    def run(it):
        def rows():
            for i, part, text in ids_and_text(it):
                keys = {line_key(line, min_length) for line in (text or "").split("\n")} - {None}
                if keys:
                    for a, b in np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2).tolist():
                        yield a, b, i, part

        yield from batches(rows(), schema, most=1 << 14)

    named = docs.select(doc_key(id_col).cast("long").alias("doc"), _part(id_col, text_col).alias("part"), text_col)
    pairs = named.mapInArrow(run, "k1 bigint, k2 bigint, doc bigint, part bigint")
    return pairs.groupBy("k1", "k2", "doc", "part").agg(F.count("*").alias("n"))


def _part(id_col: str, text_col: str) -> F.Column:
    """What tells documents of one key apart: nothing under an id, the text without one."""
    return F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(F.lit(0).cast("long"))


def _counts(refs: DataFrame) -> DataFrame:
    """Per key its number of documents and the smallest (doc, part) of ``refs``, which have a document's key once.
    Parts differ only without an id, and such documents come last: then all of the key's documents have none."""
    found = refs.groupBy("k1", "k2").agg(F.count("*").alias("n_docs"), F.min("doc").alias("first_doc"), F.min("part").alias("least"))
    return found.select("k1", "k2", "n_docs", "first_doc", F.when(F.col("first_doc") == NO_ID, F.col("least")).otherwise(F.lit(0)).cast("long").alias("first_part"))


def _once(refs: DataFrame) -> DataFrame:
    """``refs`` with every (key, document) once: a document may be in several segments."""
    return refs.groupBy("k1", "k2", "doc", "part").agg(F.sum("n").alias("n"))


def _changed(filters: DataFrame, changes: DataFrame, shards: int) -> DataFrame:
    """``filters`` after ``changes`` (k1, k2, add)."""

    def change(had: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        shard = int((had if len(had) else new)["shard"].iloc[0])
        cuckoo = CuckooFilter.from_bytes(had["filter"].iloc[0]) if len(had) else CuckooFilter(max(1024, 2 * len(new)))
        for add in (False, True):
            part = new[new["add"] == add].sort_values(["k1", "k2"])
            cuckoo.update(part["k1"].to_numpy(), part["k2"].to_numpy(), add)
        return pd.DataFrame({"shard": pd.Series([shard], dtype="int32"), "filter": [cuckoo.to_bytes()]})

    return (filters.groupBy("shard").cogroup(changes.withColumn("shard", _shard(shards)).groupBy("shard"))
            .applyInPandas(change, "shard int, filter binary"))


def _shard(shards: int) -> F.Column:
    return F.pmod("k1", F.lit(shards)).cast("int")


@dataclass(frozen=True)
class LineIndex:
    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    changes: int = 0

    @classmethod
    def empty(cls, spark: SparkSession) -> LineIndex:
        return cls(spark.createDataFrame([], "k1 bigint, k2 bigint, doc bigint, part bigint, n bigint"),
                   spark.createDataFrame([], "k1 bigint, k2 bigint, n_docs bigint, first_doc bigint, first_part bigint"),
                   spark.createDataFrame([], "shard int, filter binary"), 0)

    @classmethod
    def _fresh(cls, refs: DataFrame) -> LineIndex:
        """The index of ``refs``, all tables written anew."""
        refs = saved(refs, "line_refs")
        counts = saved(_counts(refs), "line_counts")
        shards = min(MAX_SHARDS, 1 + counts.count() // SHARD_KEYS)
        changes = counts.where("n_docs > 1").select("k1", "k2", F.lit(True).alias("add"))
        return cls(refs, counts, saved(_changed(cls.empty(refs.sparkSession).filters, changes, shards), "line_filters"), shards)

    def _with(self, refs: DataFrame, touched: DataFrame) -> LineIndex:
        """The index of ``refs``, which differ from those held in the keys of ``touched`` only."""
        keys = touched.select("k1", "k2").distinct()
        changed = saved(_counts(_once(refs.join(keys, ["k1", "k2"], "left_semi"))), "line_counts")
        before = self.counts.join(keys, ["k1", "k2"], "left_semi").where("n_docs > 1").select("k1", "k2")
        after = changed.where("n_docs > 1").select("k1", "k2")
        counts = self.counts.join(keys, ["k1", "k2"], "left_anti").unionByName(changed)
        if self.changes + 1 >= SEGMENTS or counts.count() > 2 * SHARD_KEYS * self.shards and self.shards < MAX_SHARDS:
            return LineIndex._fresh(_once(refs))
        changes = (after.join(before, ["k1", "k2"], "left_anti").withColumn("add", F.lit(True))
                   .unionByName(before.join(after, ["k1", "k2"], "left_anti").withColumn("add", F.lit(False))))
        filters = saved(_changed(self.filters, changes, self.shards), "line_filters")
        return LineIndex(refs, counts, filters, self.shards, self.changes + 1)

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH) -> LineIndex:
        new = line_refs(docs, id_col, text_col, min_length)
        if not self.shards:
            return LineIndex._fresh(new)
        new = saved(new, "line_refs")
        return self._with(self.refs.unionByName(new), new)

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """Without the documents whose ids are listed (null: all without an id); unknown ids change nothing."""
        gone = saved(ids.select(doc_key(id_col).alias("doc")).distinct(), "line_gone")
        lost = saved(self.refs.join(gone, "doc", "left_semi").select("k1", "k2").distinct(), "line_lost")
        return self._with(self.refs.join(gone, "doc", "left_anti").select("k1", "k2", "doc", "part", "n"), lost)

    def drops(self) -> DataFrame:
        """(doc, part, k1, k2): the lines to drop from each document."""
        sized = self.refs.withColumn("shard", _shard(max(1, self.shards)))
        sizes = (sized.groupBy("shard").agg(F.count("*").alias("rows"))
                 .select("shard", F.ceil(F.col("rows") / TASK_REFS).cast("int").alias("salts")))  # at most MAX_SHARDS rows
        salted = (sized.join(F.broadcast(sizes), "shard")
                  .select("shard", F.pmod(F.xxhash64("doc", "part"), "salts").cast("int").alias("salt"), "k1", "k2", "doc", "part"))
        filters = (self.filters.join(F.broadcast(sizes), "shard")
                   .select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "filter"))

        def probe(refs: pd.DataFrame, cuckoo: pd.DataFrame) -> pd.DataFrame:
            if not len(cuckoo) or not len(refs):
                return refs.iloc[:0][["k1", "k2", "doc", "part"]]
            hit = CuckooFilter.from_bytes(cuckoo["filter"].iloc[0]).holds(refs["k1"].to_numpy(), refs["k2"].to_numpy())
            return refs.loc[hit, ["k1", "k2", "doc", "part"]]

        hits = (salted.groupBy("shard", "salt").cogroup(filters.groupBy("shard", "salt"))
                .applyInPandas(probe, "k1 bigint, k2 bigint, doc bigint, part bigint"))
        exact = self.counts.where("n_docs > 1").select("k1", "k2", "first_doc", "first_part")
        return hits.join(exact, ["k1", "k2"]).where("doc <> first_doc OR part <> first_part").select("doc", "part", "k1", "k2")

    def kept_rows(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
        """The rows of ``docs`` with the text without its dropped lines, and ``LINES``: (total, dropped)."""
        drops = (self.drops().groupBy("doc", "part").agg(F.collect_list(F.struct("k1", "k2")).alias("d"))
                 .select(F.col("doc").alias("_doc"), F.col("part").alias("_part"), F.transform("d", lambda x: x["k1"]).alias("_k1"), F.transform("d", lambda x: x["k2"]).alias("_k2")))
        joined = docs.join(drops, (doc_key(id_col) == F.col("_doc")) & (_part(id_col, text_col) == F.col("_part")), "left")

        @F.arrow_udf("struct<text:string,total:bigint,dropped:bigint>")
        def without(text: pa.Array, k1: pa.Array, k2: pa.Array) -> pa.Array:
            texts, totals, dropped = [], [], []
            for at in range(0, len(text), 256):
                for t, a, b in zip(*(c.slice(at, 256).to_pylist() for c in (text, k1, k2))):
                    lines = (t or "").split("\n")
                    stay = lines
                    if a:
                        gone = {np.array(k, dtype="<i8").tobytes() for k in zip(a, b)}
                        stay = [x for x in lines if line_key(x, min_length) not in gone]
                    texts.append("\n".join(stay))
                    totals.append(len(lines))
                    dropped.append(len(lines) - len(stay))
            return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(dropped, pa.int64())], names=["text", "total", "dropped"])

        out = joined.withColumn("_kept", without(text_col, "_k1", "_k2"))
        return out.select(*(F.col("_kept.text").alias(c) if c == text_col else F.col(c) for c in docs.columns),
                          F.struct("_kept.total", "_kept.dropped").alias(LINES))

    def kept(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
        """Per row of ``docs``: ``id_col``, ``text`` without the dropped lines, ``n_lines`` before, ``n_dropped``."""
        rows = self.kept_rows(docs.select(id_col, text_col), id_col, text_col, min_length)
        return rows.select(id_col, F.col(text_col).alias("text"), F.col(LINES)["total"].alias("n_lines"), F.col(LINES)["dropped"].alias("n_dropped"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """Line dedup of one corpus: an index of all its documents, then each document without its dropped lines."""
    index = LineIndex.empty(docs.sparkSession).insert(docs, id_col, text_col, min_length)
    return index.kept(docs, id_col, text_col, min_length)
