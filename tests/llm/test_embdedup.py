import numpy as np
import pytest

from pubag.llm import embdedup as E

NAN, INF = float("nan"), float("inf")
DDL = "vec_id bigint, embedding array<float>, node string, copies string, h1 int, a int, links int, comp int, vec string"


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, "n", "c", 1, 2, 3, 4, "v") for i, v in rows], DDL)


def _hard(n=600, dims=24, seed=0):
    """A third one vector, a cluster of near copies, a chain of links at the threshold, the rest spread."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    x = rng.normal(size=(n, dims))
    hot, centre = rng.normal(size=(2, dims))
    kind = rng.permutation(n) % 12
    x[kind < 4] = hot
    near = np.flatnonzero((kind >= 4) & (kind < 7))
    x[near] = unit(centre) + 0.04 * rng.normal(size=(len(near), dims))  # cosines spread around the threshold
    for k, i in enumerate(np.flatnonzero(kind == 7)):  # a ring walked in steps of about 25 degrees: cosine 0.906
        x[i] = 0
        x[i, :2] = np.cos(0.44 * k), np.sin(0.44 * k)
    x *= np.exp(rng.normal(size=(n, 1)) * 5)
    x[kind < 4] = hot
    rows = [(int(i), [float(v) for v in r.astype(np.float32)]) for i, r in enumerate(x)]
    a, b = rows[int(near[0])][1], rows[int(near[1])][1]
    rows += [rows[30], rows[30], (50, rows[31][1]), (None, a), (None, b), (None, [0.0] * (dims - 1) + [1e30]), (n + 7, [2.0, 1.0])]
    return rows + [(n, None), (n + 1, [1.0, None]), (n + 2, [NAN] * dims), (n + 3, [0.0] * dims), (n + 4, []), (n + 5, [INF]), (None, None)]


def _brute(rows, threshold):
    width = max((len(v) for _, v in rows if v), default=0)
    good = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    m = np.array([rows[k][1] + [0.0] * (width - len(rows[k][1])) for k in good], dtype=float).reshape(len(good), width)
    m /= np.abs(m).max(axis=1, keepdims=True)
    norm = np.sqrt((m * m).sum(axis=1))
    cos = np.array([(m * r).sum(axis=1) / (norm * s) for r, s in zip(m, norm)]).reshape(len(good), len(good))
    link = cos >= threshold
    np.fill_diagonal(link, False)
    comp = list(range(len(rows)))
    n_links = [0] * len(rows)
    for g, k in enumerate(good):
        n_links[k] = int(link[g].sum())
    seen = set()
    for g in range(len(good)):
        if g in seen:
            continue
        todo, mine = [g], {g}
        while todo:
            for o in np.flatnonzero(link[todo.pop()]):
                if o not in mine:
                    mine.add(int(o))
                    todo.append(int(o))
        seen |= mine
        for o in mine:
            comp[good[o]] = good[g]
    ids = {}
    for k, c in enumerate(comp):
        if rows[k][0] is not None:
            ids[c] = min(ids.get(c, rows[k][0]), rows[k][0])
    return sorted(((i, n_links[k], ids.get(comp[k]), i == ids.get(comp[k])) for k, (i, _) in enumerate(rows)), key=str)


def _got(spark, rows, threshold=0.9):
    out = E.near_duplicates(_frame(spark, rows), "vec_id", "embedding", threshold)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("block, tile, threshold", [(4 << 20, 1024, 0.9), (1, 16, 0.9), (1, 64, 0.99)])
def test_matches_brute_force(spark, monkeypatch, block, tile, threshold):
    monkeypatch.setattr(E, "BLOCK_BYTES", block)
    monkeypatch.setattr(E, "TILE", tile)
    rows = _hard()
    assert _got(spark, rows, threshold) == _brute(rows, threshold)


def test_many_blocks_of_one_cluster(spark, monkeypatch):
    monkeypatch.setattr(E, "LEAST_BLOCKS", 9)
    rng = np.random.default_rng(1)
    x = rng.normal(size=16) + 0.05 * rng.normal(size=(300, 16))
    rows = [(int(i), [float(v) for v in r.astype(np.float32)]) for i, r in enumerate(x)]
    assert _got(spark, rows) == [(i, 299, 0, i == 0) for i in sorted(range(300), key=str)]


def test_bounds_hold_and_spare_work():
    rng = np.random.default_rng(2)
    for dims in (1, 3, 64, 1500):
        x = rng.normal(size=(400, dims)) * rng.choice([1.0, 1e-30, 1e25], (400, 1)) + 0.0
        x[200:] = x[:200] * rng.uniform(0.5, 2, (200, 1)) + np.abs(x[:200]).max(axis=1, keepdims=True) * 0.2 * rng.normal(size=(200, dims))
        a = E.Block(x, np.arange(400), np.ones(400, dtype=np.int64))
        exact = (a.x / a.norm[:, None]) @ (a.x / a.norm[:, None]).T
        near = (a.steps.astype(float) * a.scale[:, None]) @ (a.steps.astype(float) * a.scale[:, None]).T
        bound = a.length[:, None] * a.error + a.error[:, None] + E.SLACK
        assert (np.abs(exact - near) <= bound).all()
        work = {}
        got = {(i, j) for p, q in E.linked(a, a, 0.9, work) for i, j in zip(p.tolist(), q.tolist())}
        want = {(i, j) for i, j in np.argwhere(np.triu(exact >= 0.9, 1)).tolist()}
        assert got == want
        if dims == 64:
            assert work["exact"] < 0.01 * work["pairs"]


def test_groups_of_links():
    rng = np.random.default_rng(3)
    for n in (2, 10, 200):
        i, j = rng.integers(0, n, (2, n // 2))
        group = E.join_groups(np.arange(n), i, j)
        want = np.arange(n)
        for _ in range(n):
            for a, b in zip(i, j):
                want[a] = want[b] = min(want[a], want[b])
        assert (group == want).all()


def test_empty_and_small_tables(spark):
    assert _got(spark, []) == []
    assert _got(spark, [(3, None), (None, [])]) == [(3, 0, 3, True), (None, 0, None, True)]
    assert _got(spark, [(2, [1.0]), (1, [5.0]), (0, [-1.0])]) == [(0, 0, 0, True), (1, 1, 1, True), (2, 1, 1, False)]
