import hashlib

import numpy as np
import pytest

from pubag.llm import codes as C

NAN, INF = float("nan"), float("inf")
DDL = "vec_id bigint, embedding array<float>, label int, code string, dist int, vec string, slot int"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, "v", 2) for r in rows], DDL)


def _rows(n=700, dims=32, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.normal(size=dims).astype(np.float32)], None if i % 9 == 0 else int(i % 4)) for i in rng.permutation(n)]
    rows += [(n + i, rows[3][1], 7) for i in range(n // 2)]  # a third of all rows: one vector, one label
    rows += [rows[20], rows[20], (40, rows[41][1], 1), (None, rows[5][1], 1), (5000, [0.25, -0.5], 2), (5001, [], 2)]
    return rows


BAD = [(1000, None, None), (1020, [1.0, None], 1), (1040, [NAN] * 4, 1), (1060, [INF] * 4, 1), (1061, [-INF] * 4, 1)]


def _brute(rows, parts=C.PARTS, entries=C.ENTRIES, rounds=2):
    """(vec_id, code, error, label_error) and the digest, by complete scans in Python integers."""
    width = max(len(v) for _, v, _ in rows)
    w = max(1, -(-width // parts))
    whole = [[max(-C.LIMIT, min(C.LIMIT, int(np.floor(np.float64(x) * 256)))) for x in v] + [0] * (parts * w - len(v)) for _, v, _ in rows]
    cut = [[v[p * w:(p + 1) * w] for p in range(parts)] for v in whole]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, whole[k][:len(rows[k][1])]))[:entries]
    books = [[list(cut[k][p]) for k in order] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for r in range(rounds + 1):
        found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
        if r < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    mine = [cut[k][p] for k in range(len(rows)) if found[k][p][1] == e]
                    if mine:
                        books[p][e] = [sum(col) // len(mine) for col in zip(*mine)]
    errors = [sum(d for d, _ in f) for f in found]
    of = {}
    for (_, _, label), e in zip(rows, errors):
        of[label] = of.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, of[label]) for (i, _, label), f, e in zip(rows, found, errors)), key=str), digest


def _got(spark, rows, **kw):
    coded = C.compress(_frame(spark, rows), "vec_id", "embedding", "label", **kw)
    return sorted(((r.id, bytes(r.code).hex(), r.error, r.label_error) for r in C.with_label_error(coded).collect()), key=str), coded


def test_matches_complete_scans(spark):
    rows = _rows()
    got, coded = _got(spark, rows + BAD)
    want, digest = _brute(rows)
    assert got == want and coded.digest() == digest


@pytest.mark.parametrize("parts, entries, rounds", [(4, 5, 3), (16, 1, 2), (3, 64, 0)])
def test_other_settings(spark, parts, entries, rounds):
    rows = _rows(150, 10, 1)
    got, coded = _got(spark, rows, parts=parts, entries=entries, rounds=rounds)
    want, digest = _brute(rows, parts, entries, rounds)
    assert got == want and coded.digest() == digest


def test_active_entries_give_what_complete_scans_give():
    rng = np.random.default_rng(4)
    saved = 0
    for trial in range(200):
        w, k = int(rng.integers(1, 5)), int(rng.integers(1, 12))
        x, book = rng.integers(-4, 5, (60, w)), rng.integers(-4, 5, (k, w))  # small numbers: many ties
        code, dist = C.assign(x, book)
        new = book.copy()
        change = rng.random(k) < rng.random()
        new[change] += rng.integers(-2, 3, (int(change.sum()), w))
        moved = (new != book).any(axis=1)
        got, d, compared = C.reassign(x, new, moved, code, dist)
        want, wd = C.assign(x, new)
        assert (got == want).all() and (d == wd).all() and compared <= len(x) * k
        saved += len(x) * k - compared
    assert saved > 0


def test_distances_are_exact_for_large_integers():
    rng = np.random.default_rng(5)
    for top in (300, C.LIMIT):
        x, book = rng.integers(-top, top + 1, (20, 64)), rng.integers(-top, top + 1, (7, 64))
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, e)) for e in book] for r in x]
        assert C.distances(x, book).tolist() == want


def test_huge_components_stop_at_the_limit(spark):
    rows = [(1, [3e38, -3e38], 1), (2, [1.0, 2.0], 1), (3, [-3e38, 3e38], 2)]
    got, coded = _got(spark, rows, entries=2)
    want, digest = _brute(rows, entries=2)
    assert got == want and coded.digest() == digest


def test_empty_small_and_decoded(spark):
    for rows in ([], BAD):
        got, coded = _got(spark, rows)
        assert got == [] and C.decoded(coded).count() == 0
        assert coded.digest() == hashlib.sha256(b"").hexdigest()
    rows = [(2, [0.5] * 16, 1), (1, [-0.5] * 16, None)]
    got, coded = _got(spark, rows)
    assert got == [(1, "00" * 16, 0, 0), (2, "01" * 16, 0, 0)]
    assert sorted((r.id, r.vec) for r in C.decoded(coded).collect()) == [(1, [-128] * 16), (2, [128] * 16)]


def test_partitioning_changes_nothing(spark):
    rows = _rows(200, 16, 2)
    df = _frame(spark, rows)
    found = set()
    for n in (1, 3, 40):
        coded = C.compress(df.repartition(n), "vec_id", "embedding", "label")
        found.add(str(sorted(map(str, C.with_label_error(coded).collect()))) + coded.digest())
    assert len(found) == 1
