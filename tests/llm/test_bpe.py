import hashlib
import random

import cases
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pubag.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "aábcdeéßΣςİıǅﬁＡ１२ ½ \t\n\x85\xa0​ '’s'll're\U0001F600́̇漢字かなहिन्दी_-+=#@!0123ABZ\x00\x1c\x1f﻿᠎"


@pytest.fixture(scope="module")
def codec():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Codec(f.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _same(codec, library, texts):
    for text, (ids, decoded) in zip(texts, codec.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text[:200]
        assert decoded == library.decode(want, skip_special_tokens=False) == codec.decode(ids)


def test_random_texts_match_the_library(codec, library):
    rng = random.Random(4)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(2500)]
    texts += [t + "<|endoftext|>" + t + " <|startoftext|>" for t in texts[:200]]
    texts += ["abc" * 20_000 + "é" * 2000, "", " ", "<|endoftext|>", cases.LONG]
    _same(codec, library, texts)


def test_cuts_are_forced(codec):
    """No vocabulary token holds a byte pair at which a word is cut."""
    joined = set()  # within a token; a pair with the word end is another pair
    for t in codec.token_of.values():
        whole = t.removesuffix("</w>")
        joined |= {whole[i:i + 2] for i in range(len(whole) - 1 - (whole != t))}
    symbols = bpe.byte_symbols()
    words = ["zqxjkvw", "éàü", "naïveté", "日本", "12é!"]
    raw = [w.encode() for w in words]
    data, at, opens = codec.fragments(raw)
    assert opens.sum() == len(words) and len(at) > len(words)
    last = np.cumsum([len(w) for w in raw]) - 1
    for k in at[~opens].tolist():
        pair = symbols[data[k - 1]] + symbols[data[k]]
        assert k in last or pair not in joined


def test_edge_rows_and_query(spark, codec, library):
    docs = cases.documents(spark)
    rows = bpe.encode(docs, PATH).collect()
    want = sorted(((i, *codec.encode([t])[0]) for i, t, _, _ in cases.TEXTS), key=str)
    assert sorted(((r.doc_id, bytes(r.ids), r.decoded) for r in rows), key=str) == want
    assert bpe.encode(cases.empty(spark), PATH).count() == 0
    from pubag.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op6_bpe_encode_decode"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
