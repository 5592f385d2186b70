"""Quality classifier: similarity-weighted votes of the nearest labelled documents in a latent space.

A text becomes counts of neighbouring character classes and of repeated words. Latent semantic
analysis (idf-weighted counts, truncated SVD) is fitted on at most ``SAMPLE`` labelled documents, taken
in hash order from all labels that the caller offers; their vectors and the projection are broadcast
(``SAMPLE`` x ``DIMS`` and ``TERMS`` x ``DIMS`` floats, about 1.3 MB at any corpus size). Every document
is projected, its cosines with all labelled vectors are computed in blocks (one matrix product a block),
and the ``NEIGHBOURS`` nearest vote for their label with a power of their similarity as weight.

Cases: a null or empty text, and any text when no label can be learned from, scores the share of label 1
in the sample (0.5 without a sample). Several labels of one document count as the largest; of several texts
under one labelled id that with the smallest counts is learned. Equal cosines go to the earlier vector in the
order of the sample. Repeated rows score alike; a null id is passed on.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pubag.llm.common import batches

#: Bound of the sample of labelled documents, latent dimensions, neighbours that vote, documents a product.
SAMPLE, DIMS, NEIGHBOURS, BLOCK = 4096, 48, 9, 512

#: Weight of a repeated word or line against a pair of characters; power of the similarity in a vote.
REPEATS, POWER = 8, 8

#: Column that ``scored`` adds.
SCORE = "_quality_score"

#: Bytes taken at a time, so that a very long text needs no array of its own length several times over.
PIECE = 1 << 20


def _classes() -> np.ndarray:
    """Class of each byte: lower case, upper case, digit, beyond ASCII, control, and each other sign for itself."""
    out = np.zeros(256, dtype=np.int64)
    own = 5
    for b in range(256):
        c = chr(b)
        if b >= 128:
            out[b] = 3
        elif c.islower():
            out[b] = 0
        elif c.isupper():
            out[b] = 1
        elif c.isdigit():
            out[b] = 2
        elif b < 32 and c != "\n":
            out[b] = 4
        else:
            out[b] = own
            own += 1
    return out


_CLASS = _classes()
_N = int(_CLASS.max()) + 1

#: Pairs of classes, then (weighted) words equal to the one before and lines equal to the one before, all words.
TERMS = _N * _N + 3


def features(text: str | None) -> np.ndarray:
    """Term counts of a whole text."""
    out = np.zeros(TERMS, dtype=np.float32)
    if not text:
        return out
    codes = np.frombuffer(text.encode(), dtype=np.uint8)
    for at in range(0, len(codes), PIECE):
        c = _CLASS[codes[at:at + PIECE + 1]]
        out[:-3] += np.bincount(c[:-1] * _N + c[1:], minlength=_N * _N)
    words, lines = text.split(), text.split("\n")
    out[-3:] = REPEATS * sum(map(eq, words, words[1:])), REPEATS * sum(map(eq, lines, lines[1:])), len(words)
    return out


@dataclass(frozen=True)
class Model:
    idf: np.ndarray
    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @property
    def prior(self) -> float:
        return float(self.labels.mean()) if len(self.labels) else 0.5

    def latent(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors in the latent space; zero for texts without terms."""
        x = _weighted(counts, self.idf) @ self.project
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        near = self.latent(counts) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        least = np.partition(near, -k, axis=1)[:, -k:-k + 1 or None].min(axis=1, keepdims=True)
        # all above the k-th cosine, then equals of it in the order of the sample
        above, equal = near > least, near == least
        room = k - above.sum(axis=1, keepdims=True)
        votes = np.where(above | equal & (np.cumsum(equal, axis=1) <= room), np.maximum(near, 0) ** POWER, 0)
        total = votes.sum(axis=1)
        return np.where(total > 0, np.clip((votes @ self.labels) / np.maximum(total, 1e-30), 0, 1), self.prior).astype(float)


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    share = np.sqrt(counts / np.maximum(counts[:, -1:], 1)) * idf
    return share / np.maximum(np.linalg.norm(share, axis=1, keepdims=True), 1e-9)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
        sample: int = SAMPLE) -> Model:
    """The model from at most ``sample`` rows of ``labels`` (``id_col``, ``label_col``) and their texts in ``docs``."""
    label = F.max(F.col(label_col).cast("int")).alias("label")
    chosen = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(label)
              .orderBy(F.xxhash64(id_col), id_col).limit(sample))
    texts = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col)  # at most ``sample`` rows

    schema = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("counts", pa.binary())])

    def run(it):
        for batch in it:
            rows = ((i, y, features(t).tobytes()) for i, t, y in zip(*(c.to_pylist() for c in batch.columns)))
            yield from batches(rows, schema, most=512)

    source = texts.select(F.col(id_col).cast("long").alias("id"), text_col, "label")
    # one row a label, however many rows of ``docs`` have its id: at most ``sample`` rows reach the driver
    rows = source.mapInArrow(run, "id bigint, label bigint, counts binary").groupBy("id").agg(F.max("label").alias("label"), F.min("counts").alias("counts")).collect()
    rows.sort(key=lambda r: r.id)
    labels_of = np.array([r.label for r in rows], dtype=np.float32)
    if not rows:
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, DIMS), np.float32), np.zeros((0, DIMS), np.float32), labels_of)
    counts = np.stack([np.frombuffer(r.counts, dtype=np.float32) for r in rows])
    idf = (np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))) + 0.5).astype(np.float32)
    x = _weighted(counts, idf)
    # subspace iteration for the leading right singular vectors
    basis = np.linalg.qr(np.random.default_rng(0).normal(size=(TERMS, DIMS + 8)))[0]
    for _ in range(8):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    project = np.ascontiguousarray((basis @ np.linalg.svd(x @ basis, full_matrices=False)[2].T)[:, :DIMS], dtype=np.float32)
    model = Model(idf, project, np.zeros((0, DIMS), np.float32), labels_of)
    return Model(idf, project, model.latent(counts).astype(np.float32), labels_of)


def scored(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``SCORE`` (0 to 1, higher: label 1 likelier)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score_of(text: pa.Array) -> pa.Array:
        model, made = sent.value, []
        for at in range(0, len(text), BLOCK):
            made.append(model.score(np.stack([features(t) for t in text.slice(at, BLOCK).to_pylist()])))
        return pa.array(np.concatenate(made) if made else [], pa.float64())

    return docs.withColumn(SCORE, score_of(text_col))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``score`` of every row."""
    return scored(docs.select(id_col, text_col), model, text_col).select(id_col, F.col(SCORE).alias("score"))
