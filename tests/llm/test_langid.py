import re
from collections import Counter

import cases

from pubag.llm import langid


def _ngrams(text):
    """Counts of the 1- to 3-grams of the padded lower-case words."""
    out = Counter()
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        padded = f" {word} "
        out.update(word)
        out.update(padded[i:i + n] for n in (2, 3) for i in range(len(padded) - n + 1))
    return out


def _code(gram):
    return sum(ord(c) << 21 * k for k, c in enumerate(gram))


def _profile(counts):
    return sorted(counts, key=lambda g: (-counts[g], _code(g)))[: langid.PROFILE]


def test_counts_match_brute_force(monkeypatch):
    for text in ["Hello, world! été  Été x1y", "", "  12 34", "a", cases.LONG]:
        for piece in (1 << 20, 1000):
            monkeypatch.setattr(langid, "PIECE", piece)
            codes, counts = langid.ngram_counts(text)
            assert dict(zip(codes.tolist(), counts.tolist())) == {_code(g): n for g, n in _ngrams(text).items()}


def test_prediction_matches_brute_force_and_truth(spark):
    import zlib

    from pubag.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    totals = {}
    for i, r in docs.items():
        if r.lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            totals.setdefault(r.lang, Counter()).update(_ngrams(r.text))
    known = {g: {x: k for k, x in enumerate(_profile(c))} for g, c in sorted(totals.items())}
    got = QUERIES["op4_language_id"](spark, sf).collect()
    assert len(got) == len(docs)
    right = [r.lang_pred == docs[r.doc_id].lang for r in got if r.held_out]
    assert len(right) > 100 and sum(right) >= 0.98 * len(right)
    for r in sorted(got, key=lambda r: r.doc_id)[:60]:
        mine = _profile(_ngrams(docs[r.doc_id].text))
        far = {g: sum(abs(k - p[x]) if x in p else langid.PROFILE for k, x in enumerate(mine)) for g, p in known.items()}
        best = min(far, key=lambda g: (far[g], g))
        assert r.lang_pred == best and abs(r.score - (1 - far[best] / langid.PROFILE / len(mine))) < 1e-12


def test_edge_rows(spark):
    docs = cases.documents(spark)
    learned = langid.profiles(docs)
    assert {r.lang for r in learned.collect()} == {"en", "de", "fr"}
    rows = langid.identify(docs, learned).collect()
    assert len(rows) == len(cases.TEXTS)
    assert {r.doc_id: (r.lang_pred, r.score) for r in rows if r.doc_id in (4, 5, 6)} == dict.fromkeys((4, 5, 6), ("und", 0.0))
    assert {r.lang_pred for r in langid.identify(docs, learned.limit(0)).collect()} == {"und"}
    assert langid.identify(cases.empty(spark), learned).count() == 0 and langid.profiles(cases.empty(spark)).count() == 0
