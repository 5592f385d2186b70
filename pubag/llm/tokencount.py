"""Token counts under a unigram model, by dynamic programming shared over a trie of the distinct words.

The best segmentation of a word into vocabulary pieces maximises the sum of their log-probabilities; the
best score of each prefix (the forward scores) depends on the prefix alone. The distinct words of a block
of texts are put into a trie, walked depth first in their sorted order: the forward scores of a shared
prefix are computed once, and each word's token count is stored where it ends. A text counts the sum over
its words. Counts of words are kept across blocks in a cache of bounded size.

A word is a run of characters other than ``[\\x20\\x09-\\x0D]``, prefixed with the vocabulary's word mark.
Pieces have log-probabilities by Zipf's law over their rank, as the vocabulary files order pieces by
frequency and give no probabilities. A character that no piece covers counts one token for each of its
UTF-8 bytes. Equal scores go to fewer tokens.

Cases: null, empty and blank texts have no words and no tokens. Rows are independent; repeated rows and
missing ids pass through. A word of any length is processed whole.
"""

from __future__ import annotations

from functools import lru_cache
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame

from pubag.llm.common import batches, blocks, id_and_text

MARK = "▁"

#: Words whose counts a worker remembers, and texts taken together.
CACHE_WORDS, BLOCK_TEXTS = 300_000, 512


def pieces(model_file: str) -> list[str]:
    """The ordinary pieces of a sentencepiece model in the order of their ids."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    return [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]


class Unigram:
    """Log-probabilities of the pieces: rank r (from 0) has weight 1 / (r + 2)."""

    def __init__(self, vocabulary: list[str]):
        total = log(sum(1 / (r + 2) for r in range(len(vocabulary))))
        self.score = {p: -log(r + 2) - total for r, p in enumerate(vocabulary)}
        self.byte = -log(len(vocabulary) + 2) - total - 1
        self.root: dict = {}  # trie of the pieces: a node maps characters to nodes, and "" to its piece's score
        for p, s in self.score.items():
            node = self.root
            for c in p:
                node = node.setdefault(c, {})
            node[""] = s

    def step(self, state: tuple, c: str) -> tuple:
        """Forward state (score, minus tokens, open pieces) one character on. An open piece is a node of the
        trie with the state in which the piece began."""
        before, used, pieces = state
        n = len(c.encode())
        score, tokens, now = before + n * self.byte, used - n, []
        child = self.root.get(c)
        if child is not None:
            pieces = [*pieces, (self.root, before, used)]
        for node, s, t in pieces:
            child = node.get(c)
            if child is not None:
                now.append((child, s, t))
                p = child.get("")
                if p is not None and (s + p > score or s + p == score and t - 1 > tokens):
                    score, tokens = s + p, t - 1
        return score, tokens, now

    def counts(self, words: set[str]) -> dict[str, int]:
        """Tokens of each word, its mark included: depth first over the trie of the words, one stack of
        forward states, so the states of a shared prefix are computed once."""
        out, before, stack = {}, "", [self.step((0.0, 0, []), MARK)]
        for word in sorted(words):
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del stack[shared + 1:]
            state = stack[-1]
            for c in word[shared:]:
                state = self.step(state, c)
                stack.append(state)
            out[word] = -state[1]
            before = word
        return out


@lru_cache(maxsize=1)
def _model(vocabulary: tuple[str, ...]) -> tuple[Unigram, dict[bytes, int]]:
    """One model and one cache of word counts a worker process."""
    return Unigram(list(vocabulary)), {}


def count_tokens(docs: DataFrame, vocabulary: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_words`` and ``n_tokens`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(vocabulary))  # the pieces of one file
    source = docs.select(id_col, text_col)
    kind = source.schema[id_col].dataType
    schema = pa.schema([(id_col, pa.string() if kind.typeName() == "string" else pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])

    def run(it):
        model, known = _model(sent.value)

        def rows():
            for ids, texts in blocks(id_and_text(it), BLOCK_TEXTS):
                words = [(t or "").encode().split() for t in texts]
                if len(known) > CACHE_WORDS:
                    known.clear()
                fresh = {w.decode() for w in set().union(*words) if w not in known}
                known.update((w.encode(), n) for w, n in model.counts(fresh).items())
                for i, ws in zip(ids, words):
                    yield i, len(ws), sum(map(known.__getitem__, ws))

        yield from batches(rows(), schema)

    return source.mapInArrow(run, f"`{id_col}` {kind.simpleString()}, n_words bigint, n_tokens bigint")
