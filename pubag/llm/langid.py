"""Language identification by rank-order profiles.

The n-grams (one to three characters) of the lower-cased words of a text, words padded with one blank,
are ranked by frequency, ties by code. A language's profile is the ``PROFILE`` most frequent n-grams of
all its training texts; a document goes to the language whose profile has the smallest out-of-place
distance to the document's own ``PROFILE`` most frequent n-grams, an n-gram missing in the profile
counting ``PROFILE``. The score is one less the distance over its largest value.

Training counts every whole text: each task merges its texts' counts per language, then one aggregate
sums them, so a language with most of the rows is added up before the shuffle. The profiles (at most
``LANGUAGES`` x ``PROFILE`` rows, checked) are broadcast.

Cases: a null text, or one without a letter, is ``und`` with score 0, as is every text if nothing was
learned. Rows with a null language are never learned from. Equal distances go to the language that is
smaller by code point. Repeated rows count as often as they occur; a null id is passed on.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pubag.llm.common import batches, id_and_text

#: Ranks of a profile, most languages that are learned, characters counted at once.
PROFILE, LANGUAGES, PIECE = 400, 1000, 1 << 20

UNDETERMINED = "und"

#: Distinct n-grams after which a task hands its counts on.
FLUSH = 1 << 19


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _codes(text: str) -> np.ndarray:
    """All n-grams of the words of ``text``, 21 bits a character."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    letter = _letters()[a]
    if not letter.any():
        return a[:0]
    a = np.where(letter, a, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    a = np.concatenate([[32], a[keep], [32]])
    blank = a == 32
    pairs, triples = a[:-1] | a[1:] << 21, a[:-2] | a[1:-1] << 21 | a[2:] << 42
    return np.concatenate([a[~blank], pairs[~(blank[:-1] & blank[1:])], triples[~blank[1:-1]]])


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(codes, return_inverse=True)
    return keys, np.bincount(at, weights=counts, minlength=len(keys)).astype(np.int64)


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a whole text with their counts."""
    text = (text or "").lower()
    if len(text) <= PIECE:
        return np.unique(_codes(text), return_counts=True)
    keys, counts, at = [], [], 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and text[end].isalpha():
            end += 1  # never inside a word
        k, c = np.unique(_codes(text[at:end]), return_counts=True)
        keys.append(k)
        counts.append(c)
        at = end
    return _summed(np.concatenate(keys), np.concatenate(counts))


def profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, code, rank from 0): the profile of every language in ``docs``."""
    schema = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])

    def run(it):
        held: dict[str, list] = {}

        def flushed():
            for lang, parts in held.items():
                codes, counts = _summed(*(np.concatenate(x) for x in zip(*parts)))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], schema=schema)
            held.clear()

        size = 0
        for lang, text in id_and_text(it):
            codes, counts = ngram_counts(text)
            if len(codes):
                parts = held.setdefault(lang, [])
                parts.append((codes, counts))
                size += len(codes)
                if len(parts) >= 512 or sum(len(p[0]) for p in parts[1:]) > FLUSH:
                    before = sum(len(p[0]) for p in parts)
                    held[lang] = [_summed(*(np.concatenate(x) for x in zip(*parts)))]
                    size -= before - len(held[lang][0][0])
                if size > 4 * FLUSH:
                    yield from flushed()
                    size = 0
        yield from flushed()

    counts = (docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), text_col)
              .mapInArrow(run, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n")))
    order = W.partitionBy("lang").orderBy(F.desc("n"), "code")
    # the limit stands on the row number itself, so that tasks keep PROFILE rows a language before the shuffle
    return counts.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= PROFILE).select("lang", "code", (F.col("nth") - 1).alias("rank"))


@dataclass(frozen=True)
class Profiles:
    """Languages in order, the n-grams of any profile in order, and the rank of each in each (or ``PROFILE``)."""

    langs: list[str]
    codes: np.ndarray
    ranks: np.ndarray

    @classmethod
    def collect(cls, rows: DataFrame) -> Profiles:
        got = rows.limit(LANGUAGES * PROFILE + 1).collect()
        langs = sorted({r.lang for r in got})
        if len(got) > LANGUAGES * PROFILE or len(langs) > LANGUAGES:
            raise ValueError(f"more than {LANGUAGES} languages")
        codes = np.unique(np.array([r.code for r in got], dtype=np.int64))
        ranks = np.full((len(langs), len(codes) + 1), PROFILE, dtype=np.int64)
        if got:
            ranks[[langs.index(r.lang) for r in got], np.searchsorted(codes, [r.code for r in got])] = [r.rank for r in got]
        return cls(langs, codes, ranks)

    def best(self, text: str | None) -> tuple[str, float]:
        codes, counts = ngram_counts(text)
        if not len(codes) or not self.langs:
            return UNDETERMINED, 0.0
        mine = codes[np.lexsort((codes, -counts))[:PROFILE]]
        at = np.searchsorted(self.codes, mine)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != mine)] = len(self.codes)
        ranks = self.ranks[:, at]
        places = np.where(ranks < PROFILE, np.abs(ranks - np.arange(len(mine))), PROFILE).sum(axis=1)
        k = int(places.argmin())
        return self.langs[k], 1.0 - float(places[k]) / (PROFILE * len(mine))


def identify(docs: DataFrame, learned: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred`` and ``score`` of every row, by the profiles in ``learned``."""
    sent = docs.sparkSession.sparkContext.broadcast(Profiles.collect(learned))
    source = docs.select(id_col, text_col)
    kind = source.schema[id_col].dataType
    schema = pa.schema([(id_col, pa.string() if kind.typeName() == "string" else pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(it):
        known = sent.value
        yield from batches(((i, *known.best(t)) for i, t in id_and_text(it)), schema)

    return source.mapInArrow(run, f"`{id_col}` {kind.simpleString()}, lang_pred string, score double")
