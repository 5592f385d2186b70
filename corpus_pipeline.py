"""The corpus pipeline: quality, line dedup, near-duplicates, mixing, BPE.

``STAGES`` are (name, function) in order; a function takes (spark, docs, sf_dir) and returns a DataFrame that
is written as Parquet and reread as the next stage's ``docs``. All but the last return the columns of
``docs``. ``run`` applies them to the documents of a folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pubag.llm import bpe, line_dedup, mixing, neardup, quality
from pubag.llm.common import saved, table

#: Least quality score of a document that stays.
QUALITY = 0.3

#: Shingle width and similarity of near duplicates.
SHINGLE, SIMILAR = 5, (80, 100)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores ``QUALITY`` or more. Texts pass through unchanged; the score is
    taken beside the row, without a join."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, model).where(F.col(quality.SCORE) >= QUALITY).select(*docs.columns)


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a document of smaller id holds too; ``n_chars`` follows the text.
    A document that loses all its lines stays, with an empty text."""
    index = line_dedup.LineIndex.empty(spark).insert(docs)
    return _sized(index.kept_rows(docs), docs)


def _sized(out: DataFrame, docs: DataFrame) -> DataFrame:
    out = out.select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, one of the smallest id; rows without an id, and different
    texts under one id, follow the same rule as all others."""
    return neardup.first_rows(docs, SHINGLE, SIMILAR)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often, and as far, as the mix takes them."""
    return mixing.mixed_documents(docs)


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document of the mix: doc_id, n_tokens, ids (binary, little-endian
    unsigned 32-bit), decoded."""
    import public_tokenizers

    coded = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", line_filter),
    ("near_dedup", near_duplicate_filter),
    ("mix", source_mix),
    ("bpe", bpe_round_trip),
]

#: The classifier, the hashed sketches and the encoder have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
SQL: dict = {}
