import hashlib
import re
import zlib
from itertools import product

import pytest

from pubag.llm import convrepair as R

DDL = "conv_id bigint, turn bigint, role string, text string, conv string, gone int, kind string, cost int, audit string, head int, t1 int, signature int"
SPACE = re.compile(r"[^\x20\x09-\x0D]")


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, "k", 2, "a", 3, 4, 5) for r in rows], DDL)


def _damage(rows):
    """Conversations {conv_id: turns after damage}, in order, by the definition."""
    said = lambda v: " " if v is None else str(v)
    out = {}
    for conv, turn, role, text in rows:
        mine, role, text = out.setdefault(conv, []), said(role), said(text)
        f = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        if f == 0:
            continue
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        mine += [(turn, "user" if f == 4 else role, text)] * (2 if f == 3 else 1)
    return {c: sorted(m, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, m in out.items()}


def _cheapest(turns, faults):
    """(cost, audit, repaired): every sequence of edits with up to three insertions between two turns."""
    ends = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def rest(k, state, room):
        best = None
        if k == len(turns) and state in ("", "a"):
            best = (0, "", ())
        ways = []
        if room:
            ways += [(2, "I", "user", "", k, room - 1), (2, "I", "assistant", "", k, room - 1)]
        if k < len(turns):
            (_, role, text), more = turns[k], 1 if faults[k] == "t" else 0
            ways.append((3, "D", None, None, k + 1, 3))
            if faults[k] not in "bd":
                ways += [(more, "K", role, text, k + 1, 3), (2 + more, "R", "user", text, k + 1, 3), (2 + more, "R", "assistant", text, k + 1, 3)]
        for cost, letter, role, text, at, left in ways:
            to = state if role is None else ends[state].get(role[:1])
            if to is None:
                continue
            after = rest(at, to, left)
            if after is not None:
                way = (cost + after[0], letter + after[1], (() if role is None else ((role, text),)) + after[2])
                best = way if best is None or way[:2] < best[:2] else best
        return best

    return rest(0, "", 3)


def _faults(turns):
    out, seen = [], set()
    for _, role, text in turns:
        body = SPACE.findall(text)
        out.append("b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else "-")
        seen.add((role, text))
    return out


def _brute(rows):
    out = []
    for conv, turns in _damage(rows).items():
        faults = _faults(turns)
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:])]
        cost, audit, repaired = _cheapest(turns, faults)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out.append((conv, gaps, *(faults.count(f) for f in "bdt"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest))
    return sorted(out, key=str)


def _got(spark, rows):
    d = R.damaged(_frame(spark, rows))
    return sorted((tuple(r) for r in R.report(d, R.plans(d)).collect()), key=str)


TEXTS = ["Yes.", "no", "", None, " \t\r\n\x0b\x0c", "Why?\n ", "é…", "1. x!", "x" * 3000 + ".", "Yes."]
ROLES = ["user", "assistant", "user", "assistant", "system", None, "tool", "", "User"]


def _rows():
    rows = []
    for conv in range(60):
        rows += [(conv, t + (5 if t > 2 else 0), ROLES[(conv * 7 + t * t) % len(ROLES)] if conv % 3 else ROLES[t % 2], TEXTS[(conv + 3 * t) % len(TEXTS)]) for t in range(conv % 6)]
    rows += [(None, None, None, None), (None, 1, "assistant", "Fine."), (100, None, "user", "Hi."), (100, None, "assistant", "Well."), (100, 3, None, None)]
    rows += [(101, -5, "system", "Be kind."), (101, 7, "user", "Hi."), (101, 7, "user", "Hi."), (101, 9, "assistant", "Hi.")]
    rows += [(102, 0, "usher", "Odd."), (102, 1, "agent", "Odd!"), (103, 1 << 62, "user", "Late."), (103, -(1 << 62), "assistant", "Early.")]
    return rows + [(c, t, "user", f"Turn {t}.") for c in range(200, 230) for t in range(c % 4)]


def test_matches_brute_force(spark):
    rows = _rows()
    got = _got(spark, rows)
    assert got == _brute(rows)
    assert {"D", "I", "K", "R"} <= set("".join(r[7] for r in got)) and any(not r[7] for r in got)


def test_conversations_without_rows(spark):
    gone = [(c, t) for c in range(60) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:3]
    rows = [(c, t, "user", "Hi.") for c, t in gone]
    assert _got(spark, rows) == sorted([(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in {c for c, _ in gone}], key=str)
    assert _got(spark, []) == []


def test_every_short_signature():
    fault = {"x": ("user", "b"), "s": ("system", "-"), "u": ("user", "-"), "a": ("assistant", "-"), "o": ("tool", "-"),
             "S": ("system", "t"), "U": ("user", "t"), "A": ("assistant", "t"), "O": ("tool", "t")}
    path = R.Suffixes()
    for n in range(4):
        for signature in sorted("".join(p)[::-1] for p in product(fault if n < 3 else "xsuaUo", repeat=n)):
            back = signature
            turns = [(k, fault[c][0], "t") for k, c in enumerate(back[::-1])]
            assert path.solve(back) == _cheapest(turns, [fault[c][1] for c in back[::-1]])[:2], back[::-1]


def test_suffixes_are_computed_once():
    path, rest = R.Suffixes(), "uauaSxoua"
    words = sorted((head + rest)[::-1] for head in ("u", "a", "uu", "sua", "", "xx"))
    fresh = [R.Suffixes().solve(w) for w in words]
    assert [path.solve(w) for w in words] == fresh
    assert path.made == 1 + len({w[:n] for w in words for n in range(1, len(w) + 1)})
    long = "uau" * 40_000  # a node is 40 bytes, an audit is read off iteratively
    cost, audit = path.solve(long[::-1])
    assert len(audit) >= len(long) and cost > 0


def test_repaired_turns_and_undamaged_rows(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "So"), (1, 2, "user", "So"), (2, 0, "system", "S."), (2, 1, "user", "U."), (2, 2, "assistant", "A."), (3, 0, None, "x.")]
    plain = R.plain(_frame(spark, rows))
    plan = R.plans(plain)
    told = {r.conv: (r.cost, r.audit) for r in plan.collect()}
    turns = {}
    for r in sorted(R.repaired_turns(plain, plan).collect()):
        turns.setdefault(r.conv, []).append((r.position, r.role, r.text, r.edit))
    for conv in (1, 2, 3):
        mine = [(t, r or " ", x) for c, t, r, x in rows if c == conv]
        cost, audit, repaired = _cheapest(mine, _faults(mine))
        assert told[conv] == (cost, audit)
        assert [(r, x) for _, r, x, _ in turns.get(conv, [])] == list(repaired)
        assert [p for p, *_ in turns.get(conv, [])] == list(range(len(repaired)))


@pytest.mark.parametrize("partitions", [1, 13])
def test_one_large_conversation_among_small_ones(spark, partitions):
    """A third of all rows in one conversation, a third of it one message."""
    rows = [(7, t, ("user", "assistant")[t % 2] if t % 3 else "user", "again." if t % 3 == 0 else f"turn {t}" + "." * (t % 2)) for t in range(900)]
    rows += [(c, t, ("user", "assistant")[t], f"{t}!") for c in range(1000, 1900) for t in range(2)]
    d = R.damaged(_frame(spark, rows).repartition(partitions))
    got = {r.conv: r for r in R.report(d, R.plans(d)).collect()}
    assert len(got) == 901
    turns = _damage(rows)[7]
    faults = _faults(turns)
    big = got[7]
    assert (big.blank, big.duplicate, big.truncated) == tuple(faults.count(f) for f in "bdt")
    # the audit is a valid set of edits of the stated cost
    state, at, cost, out = R.START, 0, 0, []
    for edit in big.audit:
        if edit == "I":
            state, cost = R.NEXT[state], cost + 2
            out.append(f"{R.ROLE[state]}:")
            continue
        (_, role, text), fault = turns[at], faults[at]
        at += 1
        if edit == "D":
            cost += 3
            continue
        assert fault not in "bd"
        cost += (fault == "t") + 2 * (edit == "R")
        if edit == "R":
            state = R.NEXT[state]
            role = R.ROLE[state]
        else:
            state = R.AFTER[role[0]][state]
        out.append(f"{role}:{text}")
    assert at == len(turns) and state in R.END and cost == big.cost
    assert hashlib.sha256("\n".join(out).encode()).hexdigest() == big.repaired_sha256
