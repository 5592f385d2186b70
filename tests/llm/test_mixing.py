import random

import cases
from pyspark.sql import functions as F

from pubag.llm import mixing


def _targets(sizes):
    """{source: words} in code-point order, null last, to exact targets as fractions."""
    from fractions import Fraction

    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    total, cut = Fraction(3, 2) * sum(sizes.values()), set()
    while True:
        rest = [s for s in order if s not in cut]
        part = (total - sum(2 * sizes[s] for s in cut)) / sum(weight[s] for s in rest) if rest else 0
        above = {s for s in rest if weight[s] * part > 2 * sizes[s]}
        if not above:
            return {s: float(2 * sizes[s] if s in cut else weight[s] * part) for s in order}
        cut |= above


def test_first_words_and_edge_rows(spark):
    docs = cases.documents(spark)
    sizes = mixing.sized(docs)
    want = {}
    for _, t, _, s in cases.TEXTS:
        want[s] = want.get(s, 0) + len((t or "").encode().split())
    sources = mixing.targets(sizes)
    got = {r.source: r for r in sources.collect()}
    exact = _targets(want)
    assert {s: r.source_size for s, r in got.items()} == want
    assert all(abs(got[s].target - exact[s]) < 1e-6 * max(1, exact[s]) for s in want)
    out = mixing.mixed_documents(docs, block_words=100).collect()
    assert out[0].__fields__ == docs.columns
    words = {}
    for r in out:
        n = len(r.text.encode().split())
        words[r.source] = words.get(r.source, 0) + n
        assert r.n_chars == len(r.text) and n
        full = [t for i, t, _, s in cases.TEXTS if i == r.doc_id]
        assert any(t and t.startswith(r.text) for t in full)
    assert all(words.get(s, 0) == min(2 * want[s], int(exact[s] + 0.5)) for s in want)
    assert mixing.mixed_documents(cases.empty(spark)).count() == 0


def test_schedule_is_van_der_corput_and_slots_meet_blocks(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 90))), rng.choice(["a", "b", "c", "d", None])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    sizes = mixing.sized(docs)
    sources = mixing.targets(sizes)
    quota = {r.source_no: r.quota for r in sources.collect()}
    plan = sorted(map(tuple, mixing.schedule(sources, 64).collect()))
    need = {s: -(-q // 64) for s, q in quota.items()}
    assert len(plan) == sum(need.values()) and len({p[0] for p in plan}) == len(plan)
    bits = (len(plan) - 1).bit_length()
    lo = {s: sum(need[x] for x in need if x < s) for s in need}
    seen = dict.fromkeys(need, 0)
    for slot, source, rank in plan:
        point = int(format(slot, f"0{bits}b")[::-1], 2)
        assert lo[source] <= point < lo[source] + need[source] and rank == seen[source]
        seen[source] += 1
    # every stretch of the schedule is close to the weights
    half = [s for slot, s, _ in plan if slot < 2 ** (bits - 1)]
    assert all(abs(half.count(s) - need[s] / 2) <= 2 for s in need)
    pieces = mixing.mix(sizes, sources, 64).groupBy("slot").agg(F.sum("words").alias("w")).collect()
    assert all(r.w <= 64 for r in pieces) and sum(r.w for r in pieces) == sum(quota.values())


def test_query_reruns_agree(spark):
    from pubag.llm.queries import QUERIES

    a, b = (sorted(map(tuple, QUERIES["op5_source_mix"](spark, "/root/testdata/sf0.001").collect())) for _ in range(2))
    assert a == b and all(0 <= t <= 2 * s for _, s, _, _, t in a)
    by = {}
    for _, s, whole, target, t in a:
        by.setdefault((whole, target), []).append(t)
    assert all(abs(sum(t) - target) <= 1 or len(t) > 10 for (_, target), t in by.items())


def test_blocks_come_in_slot_order_close_to_the_weights(spark):
    """Any stretch of the emitted mix has the targets' shares, blocks of a source are shuffled, and the pieces of a
    document add up to its first words."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{i}.{k}" for k in range(rng.randint(0, 120))), rng.choices(["a", "b", "c", None], [6, 1, 2, 1])[0]) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mixed_blocks(docs, 32).collect()
    assert [(r.slot, r.piece) for r in got] == sorted((r.slot, r.piece) for r in got)
    assert all(len(r.text.split()) == r.words for r in got)
    total = sum(r.words for r in got)
    share = {s: sum(r.words for r in got if r.source == s) / total for s in ("a", "b", "c", None)}
    for at in range(0, total - total // 4, total // 8):  # stretches of a quarter of the mix
        seen, words = dict.fromkeys(share, 0), 0
        for r in got:
            if at <= words < at + total // 4:
                seen[r.source] += r.words
            words += r.words
        assert all(abs(seen[s] / sum(seen.values()) - share[s]) < 0.03 for s in share)
    texts = {i: t.split() for i, t, _ in rows}
    parts = {}
    for r in got:
        parts.setdefault((r.doc_id, r.epoch), []).append((r.piece, r.text.split()))
    for (i, _), p in parts.items():
        words = [w for _, ws in sorted(p) for w in ws]
        assert words == texts[i][:len(words)]
    first = [r.piece // 32 for r in got if r.source == "a"]
    assert sum(b < a for a, b in zip(first, first[1:])) > len(first) / 4  # not in the order of the documents
    # whole documents follow the same order
    order = {}
    for r in got:
        order.setdefault((r.doc_id, r.epoch), r.slot)
    want = [slot for slot in sorted(order.values())]
    n, words = 0, {}
    for r in mixing.mixed_documents(docs, 32).collect():
        e = words.setdefault(r.doc_id, 0)
        words[r.doc_id] += 1
        candidates = [order[k] for k in order if k[0] == r.doc_id]
        assert want[n] in candidates
        n += 1
    assert n == len(order)
