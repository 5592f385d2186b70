import cases
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P

SF = "/root/testdata/sf0.01"


def test_stages_match_brute_force(spark):
    """Each stage against a plain version over its own input; the last against the library."""
    from test_line_dedup import _brute as lines
    from test_neardup import _brute as groups

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns = docs.columns
    stage = dict(P.STAGES)
    assert [n for n, _ in P.STAGES] == ["quality", "line_dedup", "near_dedup", "mix", "bpe"]

    first = stage["quality"](spark, docs, SF).cache()
    assert first.columns == columns and first.exceptAll(docs).count() == 0
    stayed = {r.doc_id for r in first.collect()}
    junk, clean = ([i in stayed for i, q in labels.items() if q == y] for y in (0, 1))
    assert sum(junk) <= 0.05 * len(junk) and sum(clean) >= 0.99 * len(clean)

    second = stage["line_dedup"](spark, first, SF).cache()
    want = lines([(r.doc_id, r.text) for r in first.collect()])
    assert sorted((r.doc_id, r.text) for r in second.collect()) == sorted((i, t) for i, _, _, t in want)
    assert all(r.n_chars == len(r.text) for r in second.collect()) and second.columns == columns

    third = stage["near_dedup"](spark, second, SF).cache()
    want = groups([(r.doc_id, r.text) for r in second.collect()], 5, 80, 100)
    assert sorted(r.doc_id for r in third.collect()) == sorted(i for i, _, _, kept in want if kept)
    assert third.columns == columns

    fourth = stage["mix"](spark, third, SF).cache()
    words = lambda rows: sum(len(r.text.split()) for r in rows)
    had, out = third.collect(), fourth.collect()
    assert abs(words(out) - 1.5 * words(had)) < 20 and fourth.columns == columns
    texts = {r.doc_id: r.text for r in had}
    assert all(texts[r.doc_id].startswith(r.text) for r in out)

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    coded = stage["bpe"](spark, fourth, SF).collect()
    key = lambda x: (x[0], x[1])
    want = sorted(((r.doc_id, library.encode(r.text, add_special_tokens=False).ids) for r in out), key=key)
    assert sorted(((r.doc_id, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in coded), key=key) == want
    assert all(r.n_tokens * 4 == len(r.ids) for r in coded)


def test_edge_rows_and_empty_table(spark):
    docs = cases.documents(spark)
    rows = docs
    for name, f in P.STAGES:
        rows = P.saved(f(spark, rows, SF), name)
        none = f(spark, cases.empty(spark), SF)
        assert none.count() == 0
        if name != "bpe":
            assert rows.columns == none.columns == docs.columns
    assert rows.count() > 0


def test_near_dedup_keeps_one_row_a_group_whatever_the_ids(spark):
    from test_neardup import _by_row, _shared_ids

    rows = [*_shared_ids(), (None, ""), (None, " "), (5, None), (5, "")]
    root, _ = _by_row(rows, P.SHINGLE, *P.SIMILAR, False)
    big = 1 << 70
    groups = {}
    for r, (i, t) in zip(root, rows):
        groups.setdefault(("of", i) if i is not None and not (t or "").strip() else r, []).append((big if i is None else i, t))
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id bigint, text string, n_chars bigint")
    got = [(big if r.doc_id is None else r.doc_id, r.text) for r in dict(P.STAGES)["near_dedup"](spark, docs, SF).collect()]
    at = {row: g for g, members in groups.items() for row in members}
    two = lambda x: x[1] is not None and not x[1].strip() and x[0] == big
    assert sorted(i for i, _ in got) == sorted(min(i for i, _ in m) for m in groups.values())
    assert len({at[x] for x in got if not two(x)}) == len([x for x in got if not two(x)])
    assert sum(map(two, got)) == 2
