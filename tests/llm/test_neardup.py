import itertools
import random

import cases
import numpy as np
import pytest

from pubag.llm import neardup as N
from pubag.llm.components import components


def _sets(rows, width):
    """Shingle sets by row, of tuples of words."""
    out = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        out.append(frozenset(zip(*(w[k:] for k in range(width)))) if len(w) >= width else frozenset([tuple(w)] if w else []))
    return out


def _brute(rows, width, num, den):
    """(id, size of the set, smallest id reachable) per row; a null id is the largest."""
    big = 1 << 70
    sets, ids = _sets(rows, width), [big if i is None else i for i, _ in rows]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(ids[a]), find(ids[b])))
            root[y] = x
    none = lambda x: None if x == big else x
    return sorted(((none(i), len(s), none(find(i)), find(i) == i) for i, s in zip(ids, sets)), key=str)


def _rows(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def _near_copies(rng, n, base, edits, start):
    out = []
    for k in range(n):
        words = base.split()
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(10**6)}"
        out.append((start + k, " ".join(words)))
    return out


def test_plan_and_pruning_bounds():
    assert N.band_plan(0.85) == (25, 5) and N.band_plan(0.8) == (32, 4)
    for t in (0.8, 0.85, 0.95):
        bands, rows = N.band_plan(t)
        assert (1 - t**rows) ** bands <= N.BAND_MISS
        assert all(0 < need < n for n, need in N.needed_matches(t, bands * rows))
    rng = np.random.default_rng(0)
    for j in (0.3, 0.85):
        hits = rng.random((20000, 125)) < j
        alive, _ = N._passes(hits, np.ones_like(hits), N.needed_matches(0.85, 125))
        assert len(alive) == 20000 if j == 0.85 else len(alive) == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = np.unique(x[:2000]), np.unique(x[500:2500])
    same = (N.signature(a, 128) == N.signature(b, 128)).mean()
    assert abs(same - 0.6) < 0.15 and (N.signature(a, 128) == N.signature(a, 128)).all()


@pytest.mark.parametrize("blocks", [(2048, 1 << 20), (4, 200)])
def test_groups_of_copies_match_brute_force(spark, monkeypatch, blocks):
    """Copies, near copies around the threshold, and chains; also in blocks far smaller than the groups."""
    monkeypatch.setattr(N, "BUCKET_BLOCK", blocks[0])
    monkeypatch.setattr(N, "CLUSTER_BLOCK", blocks[1])
    rng = random.Random(6)
    text = lambda n: " ".join(rng.choice("abcdefghij") + str(rng.randrange(400)) for _ in range(n))
    rows = _near_copies(rng, 45, text(120), 9, 100) + _near_copies(rng, 20, text(60), 4, 300) + [(400 + k, text(40)) for k in range(30)]
    base = text(80).split()
    for k in range(14):  # a chain: each differs a little from the one before
        base[5 * k] = f"new{k}"
        rows.append((500 + k, " ".join(base)))
    rows += [(600 + k, rows[0][1].upper()) for k in range(25)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert _rows(N.near_duplicates(df, 3, (85, 100))) == _brute(rows, 3, 85, 100)


def test_edge_rows(spark):
    got = _rows(N.near_duplicates(cases.documents(spark)))
    assert got == _brute([(i, t) for i, t, _, _ in cases.TEXTS], 5, 80, 100)
    assert N.near_duplicates(cases.empty(spark)).count() == 0


def test_query_matches_brute_force(spark):
    from pubag.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert _rows(QUERIES["op8_minhash_near_dedup"](spark, sf)) == _brute(rows, 3, 85, 100)


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(300, 200), (201, 300), (7, 7)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(41)} | {100 + k: 100 for k in range(30)} | {200: 200, 201: 200, 300: 200}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def _by_row(rows, width, num, den, same_id):
    """Per row the root of its component of rows: linked by similarity, and by non-null ids if ``same_id``."""
    sets, root = _sets(rows, width), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if (same_id and rows[a][0] is not None and rows[a][0] == rows[b][0]
                or sets[a] and sets[b] and den * both >= num * (len(sets[a]) + len(sets[b]) - both)):
            root[find(b)] = find(a)
    return [find(x) for x in range(len(rows))], sets


def _shared_ids(seed=11):
    """Different texts under null and repeated ids, each with near copies under other ids or none."""
    rng = random.Random(seed)
    rows = []
    for k in range(24):
        base = " ".join(rng.choice("abcdefghij") + str(rng.randrange(400)) for _ in range(100))
        rows += [(i, t) for i, (_, t) in zip([None, 7 if k % 2 else 8, None if k % 3 else 100 + k, 200 + k // 2], _near_copies(rng, 4, base, 1, 0))]
        rows += [(None, base)] * 2 + [(300 + k, base.upper())] * (k % 4 == 0)
    for k in range(10):  # groups of rows without an id, or alone under one
        base = " ".join(rng.choice("abcdefghij") + str(rng.randrange(400)) for _ in range(100))
        rows += [(None, t) for _, t in _near_copies(rng, 3, base, 2, 0)] + [(9, " ".join(rng.choice("klmnop") + str(rng.randrange(400)) for _ in range(60)))]
    rng.shuffle(rows)
    return rows


def test_texts_that_share_an_id_keep_their_own_links(spark):
    rows = _shared_ids()
    root, sets = _by_row(rows, 3, 85, 100, True)
    big = 1 << 70
    least = {}
    for r, (i, _) in zip(root, rows):
        least[r] = min(least.get(r, big), big if i is None else i)
    want = [(i, len(s), None if least[r] == big else least[r], least[r] == (big if i is None else i)) for (i, _), s, r in zip(rows, sets, root)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert _rows(N.near_duplicates(df, 3, (85, 100))) == sorted(want, key=str)
