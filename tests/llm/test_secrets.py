import hashlib
import random
import re

import cases

from pubag.llm import secrets as S

_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def _base(text):
    """The base spans by plain scans of the whole text."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_base_spans_match_plain_scans():
    rng, automaton = random.Random(5), S._automaton()
    parts = ["password", "PassWd", "secret", "token", "api_key", "ApiKey", "=", ":", " ", '"', "'", "é", "ß\n", "AKIA", "ABCDEFGH12345678", "0123456789abcdef",
             "abcdef", "f", "x", "value", "😀", "0" * 23, "1" * 24, "tokentoken", "_", "/+="]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert [s for s in S.spans(text, automaton) if s[1] < 3] == _base(text), text


def test_checksums_decide_on_added_spans():
    a, body = S._automaton(), "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    good = "ghp_" + body + S.crc62(body.encode()).decode()
    found = lambda t: [(S.KINDS[k], t[x:y]) for x, k, y in S.spans(t, a) if k > 2]
    assert found(f"é {good} end") == [("github", good)]
    assert found(good[:-1] + ("0" if good[-1] != "0" else "1")) == []
    assert found("npm_" + good[4:]) == [("npm", "npm_" + good[4:])]
    assert found("Card number: 4111 1111 1111 1111.") == [("card", "4111 1111 1111 1111")]
    assert found("card 4111 1111 1111 1112") == []
    assert found("IBAN: DE89 3704 0044 0532 0130 00") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert found("IBAN: DE88 3704 0044 0532 0130 00") == []


def test_edge_rows_and_query(spark):
    rows = S.scan(cases.documents(spark)).collect()
    assert len(rows) == len(cases.TEXTS)
    want = {i: _base(t or "") for i, t, _, _ in cases.TEXTS}
    for r in rows:
        assert [(f.start, S.KINDS.index(f.kind), f.end) for f in r.findings if f.kind in S.KINDS[:3]] == want[r.doc_id]
    assert S.scan(cases.empty(spark)).count() == 0
    from pubag.llm.queries import QUERIES

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = QUERIES["op3_secret_scan"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(texts) and sum(r.n_assign + r.n_access + r.n_hex for r in got) > 0
    for r in got:
        base = _base(texts[r.doc_id])
        line = ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in base) for n in range(3))
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))


def test_numbers_followed_by_more_groups():
    automaton = S._automaton()
    found = lambda t: [(S.KINDS[k], t[a:b]) for a, k, b in S.spans(t, automaton)]
    for iban in ("ES9121000418450200051332", "ES91 2100 0418 4502 0005 1332", "BE68539007547034", "AT611904300234573201", "DE89370400440532013000", "NO9386011117947"):
        for tail in ("", ".", " is mine", " word from here", " 1234 5678", ", ok"):
            assert found(f"my iban {iban}{tail}") == [("iban", iban)]
    for card in ("4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111"):
        for tail in ("", " 12/27", " 12 27", " 123", "."):
            assert found(f"card {card}{tail}") == [("card", card)]
    assert found("iban ES9121000418450200051333 is mine, card 4111 1111 1111 1112 12/27") == []
    assert found("iban ES00 1111 1111 iban BE68539007547034 is it") == [("iban", "BE68539007547034")]
