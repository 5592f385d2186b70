import cases
import public_tokenizers
import pytest

from pubag.llm import tokencount as T


@pytest.fixture(scope="module")
def vocabulary():
    return T.pieces(public_tokenizers.path("piece_bpe_32k.model"))


def _brute(model, word):
    """Tokens of the best segmentation of one word, without sharing; ties to fewer tokens."""
    best = [(0.0, 0)]
    for at in range(1, len(word) + 1):
        n = len(word[at - 1].encode())
        ways = [(best[at - 1][0] + n * model.byte, best[at - 1][1] - n)]
        for start in range(max(0, at - 40), at):
            if word[start:at] in model.score:
                ways.append((best[start][0] + model.score[word[start:at]], best[start][1] - 1))
        best.append(max(ways))
    return -best[-1][1]


def test_shared_prefixes_change_nothing(vocabulary):
    model = T.Unigram(vocabulary)
    words = {w for t in cases.TEXTS for w in (t[1] or "").split()} | {"", T.MARK, "\U0001F600\U0001F600", "the", "then", "thence", "thenceforth"}
    assert model.counts(words) == {w: _brute(model, T.MARK + w) for w in words}


def test_likelier_pieces_win():
    model = T.Unigram([T.MARK, "ab", "a", "b", "abc"])
    assert model.counts({"ab", "abab", "abc", "é", "abé"}) == {"ab": 2, "abab": 3, "abc": 2, "é": 3, "abé": 4}


def test_edge_rows_and_query(spark, vocabulary, monkeypatch):
    from pubag.llm.queries import QUERIES

    model = T.Unigram(vocabulary)
    count = lambda t: (len((t or "").encode().split()), sum(_brute(model, T.MARK + w.decode()) for w in (t or "").encode().split()))
    rows = T.count_tokens(cases.documents(spark), vocabulary).collect()
    memo = {t: count(t) for _, t, _, _ in cases.TEXTS}
    assert sorted(map(str, rows)) == sorted(f"Row(doc_id={i}, n_words={memo[t][0]}, n_tokens={memo[t][1]})" for i, t, _, _ in cases.TEXTS)
    assert T.count_tokens(cases.empty(spark), vocabulary).count() == 0
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op9_token_counts"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in sorted(got, key=lambda r: r.doc_id)[:25]:
        assert (r.n_words, r.n_tokens) == count(texts[r.doc_id])
