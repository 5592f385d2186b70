"""Secret scan: Aho-Corasick keyword prefilter, anchored patterns only at hits, checksum validation.

One pass over each text. An Aho-Corasick automaton finds the keywords in the ASCII-lowered UTF-8
bytes; a pattern is tried only anchored at a hit, from left to right, never inside the previous match
of its kind, which is exactly the leftmost non-overlapping scan. Hexadecimal runs have no keyword:
every run of 24 or more covers six neighbouring multiples of four, so probing each fourth byte finds
all of them, and the run is then matched in place. Tokens with an embedded checksum (GitHub and npm:
CRC-32 in base 62; cards: Luhn; IBAN: mod 97) are reported only if it holds. A card or an IBAN may be
followed by more digits or words in groups: a card is the longest run of 13 to 19 digits that ends at a group
border and holds, an IBAN has its country's length (any that holds, longest first, for unknown countries).
What fails its checksum does not hide later hits.

Null and empty texts have no spans. Positions are code points, ends exclusive. Rows are independent:
repeated rows and missing ids pass through, no row is shuffled.
"""

from __future__ import annotations

import re
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pubag.llm.common import batches, id_and_text

#: Kinds in the order in which spans of equal start are listed; the first three are the base kinds.
KINDS = ["assign", "access", "hex", "github", "npm", "card", "iban"]

#: Least length of an assigned value, an access key and a hexadecimal run.
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24

_ASSIGN = re.compile(rb"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]+")
_GITHUB = re.compile(rb"gh[pousr]_([0-9A-Za-z]{36})(?![0-9A-Za-z])")
_NPM = re.compile(rb"npm_([0-9A-Za-z]{36})(?![0-9A-Za-z])")
_CARD = re.compile(rb"card(?:\x20(?:number|no\.?))?\x20*[:=#]?\x20*([0-9](?:[ -]?[0-9]){12,18})(?![0-9])")
_IBAN = re.compile(rb"iban\x20*[:=]?\x20*([a-z]{2}[0-9]{2}(?:\x20?[a-z0-9]{4}){2,7}(?:\x20?[a-z0-9]{1,3})?)(?![a-z0-9])")

_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_IS_HEX = np.zeros(256, dtype=bool)
_IS_HEX[list(b"0123456789abcdef")] = True


def crc62(body: bytes) -> bytes:
    """CRC-32 of ``body`` as six base-62 digits."""
    n, out = zlib.crc32(body), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = _BASE62[r] + out
    return out.encode()


def _crc_end(m: re.Match) -> int:
    return m.end() if crc62(m[1][:30]) == m[1][30:] else 0


def luhn(digits: bytes) -> bool:
    d = [c - 48 for c in digits if 48 <= c <= 57][::-1]
    return sum(d[0::2]) % 10 == -sum(x * 2 - 9 * (x > 4) for x in d[1::2]) % 10


def _cuts(run: bytes, borders: bytes) -> list[int]:
    """Lengths of ``run`` and of its starts that end ahead of a border, longest first."""
    return [len(run), *(k for k in range(len(run) - 1, 0, -1) if run[k] in borders)]


def _card_end(m: re.Match) -> int:
    for k in _cuts(m[1], b" -"):
        if sum(48 <= c <= 57 for c in m[1][:k]) < 13:
            break
        if luhn(m[1][:k]):
            return m.start(1) + k
    return 0


#: Length of an IBAN by country.
_IBAN_LENGTHS = {c: int(n) for n, codes in {
    "15": "no", "16": "be", "18": "dk fi fk fo gl nl sd", "19": "mk si", "20": "at ba ee kz lt lu mn xk", "21": "ch hr li lv",
    "22": "bg bh cr de gb ge ie me rs va", "23": "ae gi il iq om so tl", "24": "ad cz es md pk ro sa se sk tn vg", "25": "ly pt st",
    "26": "is tr", "27": "bi dj fr gr it mc mr sm", "28": "al az by cy do gt hn hu lb ni pl sv", "29": "br eg ps qa ua", "30": "jo kw mu ye",
    "31": "mt sc", "32": "lc", "33": "ru"}.items() for c in codes.split()}


def _iban_end(m: re.Match) -> int:
    length = _IBAN_LENGTHS.get(m[1][:2].decode())
    for k in _cuts(m[1], b" "):
        s = m[1][:k].replace(b" ", b"").decode()
        if (len(s) == length if length else 15 <= len(s) <= 34) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1:
            return m.start(1) + k
    return 0


#: keyword -> (kind, pattern, whether it reads the lowered bytes, end of the finding in a match or 0, group that is the span)
_RULES = {
    **dict.fromkeys(["password", "passwd", "secret", "token", "apikey", "api_key"],
                    ("assign", _ASSIGN, True, lambda m: m.end() * (len(m[1]) >= MIN_VALUE), 0)),
    "akia": ("access", _ACCESS, False, lambda m: m.end() * (len(m[0]) >= MIN_ACCESS), 0),
    **dict.fromkeys(["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], ("github", _GITHUB, False, _crc_end, 0)),
    "npm_": ("npm", _NPM, False, _crc_end, 0),
    "card": ("card", _CARD, True, _card_end, 1),
    "iban": ("iban", _IBAN, True, _iban_end, 1),
}


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word in _RULES:
        a.add_word(word, word)
    a.make_automaton()
    return a


def _hex_runs(data: bytes, codes: np.ndarray) -> list[tuple[int, int]]:
    probes = _IS_HEX[codes[::4]]
    if len(probes) < 6:
        return []
    hit = probes[:-5] & probes[1:-4] & probes[2:-3] & probes[3:-2] & probes[4:-1] & probes[5:]
    out, last = [], 0
    for at in (np.flatnonzero(hit) * 4).tolist():
        if at < last:
            continue
        while at > last and _IS_HEX[codes[at - 1]]:
            at -= 1
        last = _HEX.match(data, at).end()
        if last - at >= MIN_HEX:
            out.append((at, last))
    return out


def spans(text: str | None, automaton: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of every finding in ``text``, in code points, sorted."""
    if not text:
        return []
    data = text.encode()
    low = data.lower()
    hits = sorted((end - len(word) + 1, word) for end, word in automaton.iter(low.decode("latin-1")))
    found, last = [], dict.fromkeys(KINDS, 0)
    for at, word in hits:
        kind, pattern, lowered, ends, group = _RULES[word]
        if at >= last[kind] and (m := pattern.match(low if lowered else data, at)):
            if end := ends(m):
                found.append((m.start(group), KINDS.index(kind), end))
            if end or kind in KINDS[:3]:
                last[kind] = end or m.end()
    codes = np.frombuffer(data, dtype=np.uint8)
    found += [(a, KINDS.index("hex"), b) for a, b in _hex_runs(data, codes)]
    if found and len(text) != len(data):
        points = np.concatenate([[0], np.cumsum((codes & 0xC0) != 0x80)])  # code points before each byte
        found = [(int(points[a]), k, int(points[b])) for a, k, b in found]
    return sorted(found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Findings of every document: ``id_col`` and ``findings``, an array of (kind, start, end) sorted by
    start and then by the order of ``KINDS``."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    source = docs.select(id_col, text_col)
    kind = source.schema[id_col].dataType
    schema = pa.schema([(id_col, pa.string() if kind.typeName() == "string" else pa.int64()), ("findings", pa.list_(span))])

    def run(it):
        automaton = _automaton()
        rows = ((i, [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans(t, automaton)]) for i, t in id_and_text(it))
        yield from batches(rows, schema)

    ddl = f"`{id_col}` {kind.simpleString()}, findings array<struct<kind:string,start:bigint,end:bigint>>"
    return source.mapInArrow(run, ddl)
