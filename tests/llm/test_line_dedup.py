import hashlib
import random

import cases
import numpy as np

from pubag.llm.line_dedup import LINES, CuckooFilter, LineIndex, dedup_lines

SPACES = " \t\n\x0b\x0c\r"


def _key(line):
    k = "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACES))
    return k if len(k) >= 10 else None


def _brute(rows, place=hash):
    """(id, text) rows to (id, lines, dropped, text); texts without an id are documents after all ids, in the order
    of ``place``."""
    name = lambda i, text: (1 << 70, place(text)) if i is None else (i, 0)
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if _key(line):
                holders.setdefault(_key(line), set()).add(name(i, text))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if not (_key(x) and len(holders[_key(x)]) > 1 and min(holders[_key(x)]) != name(i, text))]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def _rows(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect()), key=str)


def test_cuckoo_filter_has_no_false_negatives_and_forgets():
    rng = np.random.default_rng(1)
    keys = rng.integers(-(1 << 62), 1 << 62, (5000, 2))
    f = CuckooFilter(1000)  # far too small: most go to the stash
    g = CuckooFilter(8000)
    for c in (f, g):
        c.update(keys[:, 0], keys[:, 1], True)
        c = CuckooFilter.from_bytes(c.to_bytes())
        assert c.holds(keys[:, 0], keys[:, 1]).all()
        c.update(keys[:2500, 0], keys[:2500, 1], False)
        assert c.holds(keys[2500:, 0], keys[2500:, 1]).all()
        assert c.holds(keys[:2500, 0], keys[:2500, 1]).mean() < 0.01
    other = rng.integers(-(1 << 62), 1 << 62, (20000, 2))
    assert g.holds(other[:, 0], other[:, 1]).mean() < 0.002


def test_edge_rows_match_brute_force(spark):
    got = _rows(dedup_lines(cases.documents(spark)))
    assert got == _brute([(i, t) for i, t, _, _ in cases.TEXTS])
    assert dedup_lines(cases.empty(spark)).count() == 0


def test_insertions_and_deletions_are_reversible(spark):
    rng = random.Random(3)
    lines = [f"a line of some length {k}" for k in range(40)]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(0, 6)))) for i in range(60)]
    df = lambda r: spark.createDataFrame(r, "doc_id bigint, text string")
    index = LineIndex.empty(spark).insert(df(rows[:40]))
    kept = lambda ix, r: sorted((x.doc_id, x[LINES]["total"], x[LINES]["dropped"], x.text) for x in ix.kept_rows(df(r)).collect())
    assert kept(index, rows[:40]) == sorted(_brute(rows[:40]))
    both = index.insert(df(rows[40:]))
    assert kept(both, rows) == sorted(_brute(rows))
    back = both.delete(df(rows[40:]).union(df([(999, "unknown")])))
    assert kept(back, rows[:40]) == sorted(_brute(rows[:40]))
    assert sorted(map(tuple, back.counts.collect())) == sorted(map(tuple, index.counts.collect()))
    no_first = both.delete(df([r for r in rows if r[0] < 10]))
    assert kept(no_first, rows[10:]) == sorted(_brute(rows[10:]))


def test_query_hashes_the_kept_text(spark):
    from pubag.llm.queries import QUERIES

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = sorted((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in _brute([tuple(r) for r in rows]))
    got = QUERIES["op1_line_dedup"](spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == want


def test_many_rows_without_an_id(spark):
    """Lines that only texts without an id share are dropped from all but one of them; equal texts are one document."""
    lines = [f"a shared line of some length {k}" for k in range(6)]
    rng = random.Random(4)
    texts = ["\n".join([f"own line of text number {t}", *rng.sample(lines, 3)]) for t in range(40)]
    rows = [(None, t) for t in texts] + [(None, texts[0])] * 5 + [(i, "\n".join(rng.sample(lines[:3], 2))) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    from pyspark.sql import functions as F
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    assert _rows(dedup_lines(df)) == _brute(rows, hashes.__getitem__)


def test_changes_write_their_own_keys_only(spark, monkeypatch):
    from pubag.llm import line_dedup as L

    rng = random.Random(6)
    lines = [f"a line of some length {k}" for k in range(30)]
    rows = [(None if i % 7 == 0 else i, "\n".join(rng.choices(lines, k=4))) for i in range(48)]
    df = lambda r: spark.createDataFrame(r, "doc_id bigint, text string")
    monkeypatch.setattr(L, "SEGMENTS", 3)
    index, held = LineIndex.empty(spark).insert(df(rows[:30])), rows[:30]
    counted = lambda ix: sorted((r.k1, r.k2, r.n_docs, r.first_doc, r.first_part) for r in ix.counts.collect())
    for k, (add, drop) in enumerate([(rows[30:33], []), (rows[33:40], []), ([], [31, 33, 500]), (rows[40:], []), ([], [None, 2])]):
        if add:
            index, held = index.insert(df(add)), held + add
        else:
            index, held = index.delete(df([(i, "") for i in drop])), [r for r in held if r[0] not in drop]
        fresh = LineIndex.empty(spark).insert(df(held))
        assert counted(index) == counted(fresh) and index.changes == (k + 1) % 3
        kept = lambda ix: sorted((x.doc_id or -1, x.text) for x in ix.kept_rows(df(held)).collect())  # noqa: E731, B023
        assert kept(index) == kept(fresh)
