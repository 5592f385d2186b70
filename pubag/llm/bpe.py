"""BPE encoding and decoding by forced boundaries.

A text is normalised (NFC, lower case) and split into words as the vocabulary file says. Inside a
word, two neighbouring bytes that occur side by side in no vocabulary token can never end up in one
token, since every merge makes a vocabulary token; a cut between them is certain. Merges on one side of
such a cut never depend on the other, so the fragments are encoded one by one and concatenated. Equal
words are encoded once per worker (a cache of bounded size); long fragments use a heap, so a text of
one huge word stays n log n. Decoding joins the tokens' strings with one space, as a file without a
decoder asks for.

Special tokens of the file found in the raw text are kept whole. A null text counts as empty: no ids,
empty decoded text. Rows are independent; repeated rows and missing ids pass through. The vocabulary
file is read once on the driver and broadcast (a file of fixed size, a few MB).
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from pubag.llm.common import batches, blocks, id_and_text

#: Entries of a worker's word cache beyond which it starts anew before the next texts.
CACHE_WORDS = 300_000

#: Words encoded at once, texts taken together, and the fragment length from which a heap is used.
BLOCK_WORDS, BLOCK_TEXTS, LONG_FRAGMENT = 20_000, 512, 64

_NONE = 1 << 40

# White space of Unicode, and the word pattern of the vocabulary file over it.
_SPACE = r"\t-\r \x85\xa0  -     　"
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + _SPACE + r"\p{L}\p{N}]+")
_END = "</w>"

# The same pattern over the characters below U+0250 for the standard library's faster matcher.
_LATIN = "\u0250"
_L, _N = ("".join(chr(c) for c in range(ord(_LATIN)) if unicodedata.category(chr(c))[0] == k) for k in "LN")
_LATIN_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_SPACE}{_L}{_N}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1
    bytes for themselves, the others in order from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


def words(text: str) -> list[str]:
    """The normalised words of a text without special tokens. Lower case goes one character at a time, so
    that sigma has one form."""
    text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()
    return (_LATIN_WORD if max(text, default="") < _LATIN else _WORD).findall(text)


class Codec:
    """Encoder and decoder of one vocabulary file (JSON text of the tokenizers format)."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != _END or spec["decoder"] is not None:
            raise ValueError("only byte-level BPE with word ends and without a decoder is read")
        vocab = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_of = {i: t for t, i in vocab.items()} | {i: t for t, i in self.specials.items()}
        symbols = byte_symbols()
        self.first = np.array([vocab[s] for s in symbols], dtype=np.int64)
        self.last = np.array([vocab[s + _END] for s in symbols], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        keys = sorted((a << 16 | b, rank, made) for (a, b), (rank, made) in self.merges.items())
        self.pair_keys, self.pair_ranks, self.pair_made = (np.array(c, dtype=np.int64) for c in zip(*keys))
        self.made_of = np.zeros(len(pairs), dtype=np.int64)
        self.made_of[self.pair_ranks] = self.pair_made
        self.inner, self.final = self._joined_pairs(vocab, symbols)
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.ids_of: dict[str, bytes] = {}
        self.text_of: dict[str, str] = {}

    @staticmethod
    def _joined_pairs(vocab, symbols) -> tuple[np.ndarray, np.ndarray]:
        """Byte pairs (first * 256 + second) that some token holds side by side: within it, and with its word end."""
        byte_of = {s: b for b, s in enumerate(symbols)}
        inner, final = np.zeros(65536, dtype=bool), np.zeros(65536, dtype=bool)
        for token in vocab:
            ends = token.endswith(_END) and len(token) > len(_END)
            b = [byte_of[c] for c in (token[:-len(_END)] if ends else token)]
            p = [x << 8 | y for x, y in zip(b, b[1:])]
            if ends:
                final[p[-1:]] = True
                p = p[:-1]
            inner[p] = True
        return inner, final

    def fragments(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The joined bytes of the words, the offset at which each fragment starts and whether it starts a word."""
        data = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        ends = np.cumsum([len(w) for w in words])
        starts_word, ends_word = np.zeros(len(data) + 1, dtype=bool), np.zeros(len(data) + 1, dtype=bool)
        starts_word[0], starts_word[ends], ends_word[ends - 1] = True, True, True
        pair = data[:-1] << 8 | data[1:]
        cut = starts_word[:-1].copy()
        cut[1:] |= ~np.where(ends_word[1:-1], self.final[pair], self.inner[pair])
        at = np.flatnonzero(cut)
        return data, at, starts_word[at]

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; ``_NONE`` where there is no merge."""
        key = np.where((left < 0) | (right < 0), -1, left << 16 | right)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)

    def _merged(self, ids: np.ndarray) -> np.ndarray:
        """All rows of a matrix of symbols (-1: none) merged at once: in each round every row merges its
        leftmost pair of lowest rank."""
        out = np.full_like(ids, -1)
        row, rank = np.arange(len(ids)), self._lookup(ids[:, :-1], ids[:, 1:])
        cols = np.arange(ids.shape[1])
        while ids.shape[1] > 1 and len(ids):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(ids)), at]
            if not (live := best < _NONE).all():
                out[row[~live]] = ids[~live]
                row, ids, rank, at, best = row[live], ids[live], rank[live], at[live], best[live]
                if not len(ids):
                    return out
            k = np.arange(len(ids))
            shift = cols[None, :] + (cols[None, :] > at[:, None])
            ids = np.take_along_axis(np.pad(ids, ((0, 0), (0, 1)), constant_values=-1), shift, axis=1)
            rank = np.take_along_axis(np.pad(rank, ((0, 0), (0, 1)), constant_values=_NONE), shift[:, :-1], axis=1)
            ids[k, at] = self.made_of[best]
            after = np.where(at + 1 < ids.shape[1], ids[k, np.minimum(at + 1, ids.shape[1] - 1)], -1)
            has = at < rank.shape[1]
            rank[k[has], at[has]] = self._lookup(ids[k, at], after)[has]
            has = at > 0
            rank[k[has], at[has] - 1] = self._lookup(ids[k, np.maximum(at - 1, 0)], ids[k, at])[has]
        out[row] = ids
        return out

    def _by_heap(self, ids: list[int]) -> list[int]:
        """The same for one long fragment, in n log n."""
        n, merges = len(ids), self.merges
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, left, right, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = made, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (m := merges.get((ids[a], ids[b]))):
                    heapq.heappush(heap, (m[0], a, ids[a], ids[b], m[1]))
        return [x for x in ids if x >= 0]

    def _ids_of(self, words: list[bytes]) -> list[list[int]]:
        data, at, opens = self.fragments(words)
        size = np.diff(np.append(at, len(data)))
        closes = np.append(opens[1:], True)
        symbol = self.first[data]
        ends = (at + size - 1)[closes]
        symbol[ends] = self.last[data[ends]]
        made: list = [None] * len(at)
        for n in np.unique(size).tolist():
            mine = np.flatnonzero(size == n)
            rows = symbol[at[mine, None] + np.arange(n)[None, :]]
            if n > LONG_FRAGMENT:
                done = [self._by_heap(r) for r in rows.tolist()]
            else:
                done = [[x for x in r if x >= 0] for r in self._merged(rows).tolist()]
            for k, ids in zip(mine.tolist(), done):
                made[k] = ids
        out: list[list[int]] = []
        for ids, new in zip(made, opens.tolist()):
            if new:
                out.append(ids)
            else:
                out[-1] = out[-1] + ids
        return out

    def _learn(self, words: set[str]) -> None:
        """Encodes the words that the cache lacks; afterwards it holds all of ``words``."""
        if len(self.ids_of) > CACHE_WORDS:
            self.ids_of.clear()
            self.text_of.clear()
        fresh, token = [w for w in words if w not in self.ids_of], self.token_of
        for k in range(0, len(fresh), BLOCK_WORDS):
            block = fresh[k:k + BLOCK_WORDS]
            made = self._ids_of([w.encode() for w in block])
            flat, at = np.array([i for ids in made for i in ids], dtype="<u4").tobytes(), 0
            for w, ids in zip(block, made):
                end = at + 4 * len(ids)
                self.ids_of[w], self.text_of[w], at = flat[at:end], " ".join([token[i] for i in ids]), end

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """Per text the ids as little-endian unsigned 32-bit integers, and the text decoded from them."""
        parts: list[list[list[str]]] = []
        for text in texts:
            split = self.special.split(text or "") if self.special else [text or ""]
            split[1::2] = [[s] for s in split[1::2]]
            split[0::2] = [words(s) for s in split[0::2]]
            parts.append(split)
        self._learn(set().union(*(w for mine in parts for w in mine[0::2])))
        out = []
        for mine in parts:
            ids, text = [], []
            for k, w in enumerate(mine):
                ids += [np.array([self.specials[w[0]]], dtype="<u4").tobytes()] if k % 2 else map(self.ids_of.__getitem__, w)
                text += w if k % 2 else map(self.text_of.__getitem__, w)
            out.append((b"".join(ids), " ".join(text)))
        return out

    def decode(self, ids: bytes) -> str:
        return " ".join(self.token_of[i] for i in np.frombuffer(ids, dtype="<u4").tolist())


@functools.lru_cache(maxsize=1)
def _codec(spec: str) -> Codec:
    """One codec a worker process, so that its cache serves all its tasks."""
    return Codec(spec)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``id_col``, ``ids`` (binary, little-endian unsigned 32-bit) and ``decoded``.
    ``vocabulary`` is the path of the vocabulary file on the driver."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    source = docs.select(id_col, text_col)
    kind = source.schema[id_col].dataType
    schema = pa.schema([(id_col, pa.string() if kind.typeName() == "string" else pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(it):
        codec = _codec(spec.value)
        rows = ((i, *made) for ids, texts in blocks(id_and_text(it), BLOCK_TEXTS) for i, made in zip(ids, codec.encode(texts)))
        yield from batches(rows, schema, weight=lambda r: len(r[1]) + len(r[2]))

    return source.mapInArrow(run, f"`{id_col}` {kind.simpleString()}, ids binary, decoded string")
