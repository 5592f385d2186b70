"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: sources in code-point order (null last) have the weights ``WEIGHTS``, repeating, and share
``SHARE`` times all words; no target exceeds ``EPOCHS`` times its source, and what is cut is shared again
by weight until none is above.

Schedule: a source needs as many slots as its target has blocks of ``BLOCK_WORDS`` words. Slot t of the
mix has the van der Corput point x(t), the bits of t reversed behind the point, and belongs to the source
whose interval of cumulative slots holds x(t): with N = 2^m points the interval is a run of integers j and
t is j with its m bits reversed, so no slot has to be looked up. A source's words are its documents in hash order,
end to end, from the start again when they are used up, cut into blocks of equal length of which the last one
stops at the target; the blocks are shuffled by hash. The slots of each source are ranked, and slot rank r takes
the r-th shuffled block. ``mixed_blocks`` is the mix in the order of its slots, in which every long stretch has
close to the target weights; ``mixed_documents`` has whole documents in the order of their first slots.

Skew: documents and slots are ordered globally by (source, hash) over range partitions, so a source with
most of the rows is spread over tasks; blocks and slots meet on (source, rank), which no source can make
hot. Only per-source scalars are summed on the driver (one row an iteration of the cut).

Cases: a null or blank text has size 0 and is never taken. A null source is a source of its own, the last.
Repeated rows are separate documents of equal place. A null id sorts before all others in the hash order
of its source. An empty table gives an empty result. Reruns agree.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubag.llm.common import NO_ID, batches, ordered_prefix, saved

#: Weights of the sources in turn, words of the mix as numerator and denominator of all words, most passes over a source.
WEIGHTS, SHARE, EPOCHS = (3, 1, 2), (3, 2), 2

#: Words of a slot; slots that one row spreads to.
BLOCK_WORDS, CHUNK = 1024, 4096


def _text_hash(source_col: str, text_col: str) -> F.Column:
    return F.xxhash64(text_col, source_col, F.col(source_col).isNull())


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(uid, doc_id, source, size, text_hash): the words ``[^\\x20\\x09-\\x0D]+`` of every row; uid names the row in this run."""
    schema = pa.schema([("source", pa.string()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("size", pa.int64())])

    def run(it):
        def rows():
            for batch in it:
                for at in range(0, batch.num_rows, 256):
                    for s, t, i, h in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                        yield s, i, h, len((t or "").encode().split())

        yield from batches(rows(), schema)

    rows = docs.select(F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id"),
                       _text_hash(source_col, text_col).alias("text_hash"))
    counted = rows.mapInArrow(run, "source string, doc_id bigint, text_hash bigint, size bigint")
    return saved(counted.withColumn("uid", F.monotonically_increasing_id()), "sizes")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_no, source_size, weight, target, quota, words_before): one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")).withColumn("none", F.col("source").isNull())
    per = ordered_prefix(per, ["none", "source"], "source_size")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("row_no") % len(WEIGHTS) + 1).cast("int"))
    per = saved(per.select("source", "none", F.col("row_no").alias("source_no"), "source_size", F.col("before").alias("words_before"),
                           weight.cast("long").alias("weight")), "sources")
    total, weights = per.agg(F.sum("source_size"), F.sum("weight")).first()
    cut, part = 0, None
    while weights:
        # (share * total - cut) / weights, correctly rounded from whole numbers
        now = (SHARE[0] * total - SHARE[1] * cut) / (SHARE[1] * weights)
        if now == part:
            break
        part, above = now, F.col("source_size") * EPOCHS < F.col("weight") * F.lit(now)
        cut, weights = per.agg(F.sum(F.when(above, F.col("source_size") * EPOCHS).otherwise(0)), F.sum(F.when(above, 0).otherwise(F.col("weight")))).first()
    most = F.col("source_size") * EPOCHS
    target = F.least(most.cast("double"), F.col("weight") * F.lit(part or 0.0))
    per = per.withColumn("target", target)
    return per.withColumn("quota", F.least(most, F.floor(F.col("target") + 0.5)))


def schedule(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(slot, source_no, rank): the slots of the mix, and each slot's rank within its source."""
    per = sources.select("source_no", F.ceil(F.col("quota") / block_words).alias("slots"))
    per = saved(ordered_prefix(per, ["source_no"], "slots").select("source_no", "slots", F.col("before").alias("lo")), "slots_of")
    total = per.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    bits = max(1, int(total - 1).bit_length()) if total else 1
    chunks = per.where("slots > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / CHUNK))))
    first = F.col("lo") + F.col("chunk") * CHUNK
    points = (chunks.repartition("source_no", "chunk")
              .withColumn("j", F.explode(F.sequence(first, F.least(first + CHUNK, F.col("lo") + F.col("slots")) - 1))))
    slot = F.conv(F.reverse(F.lpad(F.bin("j"), bits, "0")), 2, 10).cast("long")
    slots = points.select("source_no", "lo", slot.alias("slot"), F.lit(1).cast("long").alias("one"))
    ranked = ordered_prefix(slots, ["source_no", "slot"], "one")
    return ranked.select("slot", "source_no", (F.col("before") - F.col("lo")).alias("rank"))


def mix(sizes: DataFrame, sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(slot, source_no, rank, block, uid, epoch, from, first_word, words): which words of which document each slot
    holds; ``from`` orders the pieces of a slot."""
    named = sizes.join(sources.select(F.col("source").alias("s"), "source_no", "source_size", "words_before", "quota"), F.col("source").eqNullSafe(F.col("s")))
    row_hash = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = named.where("size > 0").select("source_no", row_hash.alias("h"), "doc_id", "size", "text_hash", "uid", "source_size", "words_before", "quota")
    placed = ordered_prefix(rows, ["source_no", "h", "doc_id", "size", "text_hash", "uid"], "size")
    at = F.col("before") - F.col("words_before") + F.col("epoch") * F.col("source_size")
    passes = (placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1)))).withColumn("at", at)
              .withColumn("end", F.least(F.col("at") + F.col("size"), F.col("quota"))).where("at < end"))
    block = lambda c: F.floor(c / block_words)
    pieces = (passes.withColumn("rank", F.explode(F.sequence(block(F.col("at")), block(F.col("end") - 1))))
              .withColumn("from", F.greatest("at", F.col("rank") * block_words))
              .withColumn("to", F.least("end", (F.col("rank") + 1) * block_words)))
    pieces = pieces.select("source_no", F.col("rank").alias("block"), "uid", "epoch", "from", (F.col("from") - F.col("at")).alias("first_word"),
                           (F.col("to") - F.col("from")).alias("words"))
    return pieces.join(_slot_of_block(sources, block_words), ["source_no", "block"])


def _slot_of_block(sources: DataFrame, block_words: int) -> DataFrame:
    """(source_no, block, rank, slot): a source's blocks, shuffled by hash, meet its slots in order."""
    per = sources.select("source_no", F.ceil(F.col("quota") / block_words).alias("blocks"))
    per = saved(ordered_prefix(per, ["source_no"], "blocks").select("source_no", "blocks", F.col("before").alias("lo")), "blocks_of")
    chunks = per.where("blocks > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("blocks") - 1) / CHUNK))))
    first = F.col("chunk") * CHUNK
    blocks = (chunks.repartition("source_no", "chunk")
              .withColumn("block", F.explode(F.sequence(first, F.least(first + CHUNK, F.col("blocks")) - 1))))
    blocks = blocks.select("source_no", "lo", "block", F.xxhash64("source_no", "block").alias("h"), F.lit(1).cast("long").alias("one"))
    shuffled = ordered_prefix(blocks, ["source_no", "h", "block"], "one")
    shuffled = shuffled.select("source_no", "block", (F.col("before") - F.col("lo")).alias("rank"))
    return shuffled.join(schedule(sources, block_words), ["source_no", "rank"])


def taken(sizes: DataFrame, sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(uid, epoch, words, slot): the words that the mix takes of a document on each pass, always its first ones,
    and the first slot that holds any of them."""
    return mix(sizes, sources, block_words).groupBy("uid", "epoch").agg(F.sum("words").alias("words"), F.min("slot").alias("slot"))


def _keys(doc_id: F.Column, text_hash: F.Column) -> list[F.Column]:
    return [F.coalesce(doc_id.cast("long"), F.lit(NO_ID)).alias("_d"), text_hash.alias("_h")]


_WORDS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"


def _texts(docs: DataFrame) -> DataFrame:
    """``docs``, rows of equal id, source and text once, with the keys (_d, _h)."""
    return docs.select("*", *_keys(F.col("doc_id"), _text_hash("source", "text"))).groupBy("_d", "_h").agg(*(F.first(c).alias(c) for c in docs.columns))


def mixed_blocks(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix as it is read in training: (slot, piece, doc_id, source, epoch, words, text), in the order of the
    slots over all partitions; ``piece`` orders the parts of documents that make up a slot."""
    sizes = sized(docs)
    pieces = mix(sizes, targets(sizes), block_words).join(sizes, "uid").select(
        *_keys(F.col("doc_id"), F.col("text_hash")), "slot", F.col("from").alias("piece"), "epoch", "first_word", "words")
    taken_ = F.slice(F.regexp_extract_all("text", F.lit(_WORDS), F.lit(0)), F.col("first_word").cast("int") + 1, F.col("words").cast("int"))
    out = _texts(docs.select("doc_id", "source", "text")).join(pieces, ["_d", "_h"])
    out = out.select("slot", "piece", "doc_id", "source", "epoch", "words", F.array_join(taken_, "").alias("text"))
    return out.repartitionByRange("slot", "piece").sortWithinPartitions("slot", "piece")


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix as documents: per document and pass one row with the columns of ``docs`` (doc_id, text, source and
    any others) and as its text the words taken, ``n_chars`` following it, in the order of the first slots that
    hold them. Rows of equal id, source and text are taken one by one; their other columns are those of one of them."""
    sizes = sized(docs)
    rows = taken(sizes, targets(sizes), block_words).join(sizes, "uid")
    rows = rows.select(*_keys(F.col("doc_id"), F.col("text_hash")), F.col("words").cast("int").alias("_words"), F.col("size").alias("_size"),
                       F.col("slot").alias("_slot"))
    cols = docs.columns
    parts = F.regexp_extract_all("text", F.lit(_WORDS), F.lit(0))
    text = F.when(F.col("_words") < F.col("_size"), F.array_join(F.slice(parts, F.lit(1), F.col("_words")), "")).otherwise(F.col("text"))
    out = _texts(docs).join(rows, ["_d", "_h"]).withColumn("text", text)
    out = out.repartitionByRange("_slot", "_d", "_h").sortWithinPartitions("_slot", "_d", "_h").select(*cols)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in cols else out
