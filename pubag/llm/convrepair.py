"""Repair of the structure of conversations: the cheapest edits that make the roles ``(s?(ua)+)?``.

A turn is blank, a duplicate (role and text seen earlier in the conversation), truncated (no end mark) or sound;
the first of these counts. Edits: Keep (0), Rerole to user or assistant (2), Delete (3, required for blank and
duplicate turns), Insert an empty user or assistant turn (2); a truncated turn that is not deleted adds 1. Among
the cheapest edits those win whose initials, in order, are least in ASCII.

Role and fault of a turn are one symbol, a conversation is a string of symbols, and what its rest costs depends
on that rest and on the state of the grammar only. So the distinct signatures are read from the end as a
suffix-shared automaton: a node is a distinct suffix, and for each of the four grammar states it holds the
cost-to-go, the best first edit and the state after it, computed once from the node of the shorter suffix. The
options at a node start with different letters, so a tie between them is decided by the letter, and the best
audit of a node is its letter before the best audit of the next. Signatures are range-partitioned by their
reversed text and come sorted, so suffixes are shared between neighbours and a task holds the nodes of one
signature only (40 bytes a turn); a suffix is computed again only where a partition begins.

Texts are shuffled once. The signatures come from narrow rows (a hash instead of the text); in the last pass the
plan of a conversation travels ahead of its turns, which are edited as they stream by. Duplicates are found per
(conversation, role, text), so a large conversation is spread there; its audit is one string, so its symbols are
in one task, its texts never.

Cases: null roles and texts are one space. Turns are in the order of ``turn``, nulls first; turns of one number
by role, the first 32 characters, then a hash of the text. Rows without a conv_id are one conversation. A role
that starts with none of s, u, a must be reroled or deleted. Repeated rows are duplicates. A conversation without
any row left has zeros, an empty audit and no turns. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pubag.llm.common import SPACES, batches, saved

#: What the edits cost.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

#: States of the grammar, what each expects next (state after it), and where a conversation may end.
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
NEXT = (USER, USER, ASSISTANT, USER)
END = (START, ASSISTANT)
ROLE = {USER: "user", ASSISTANT: "assistant"}

#: Symbols of turns: x must be deleted; s, u, a, o (other) by role, upper case if truncated.
GONE = "x"

COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]


class Suffixes:
    """The automaton's path of one signature, from its end: per node and state cost, letter and state after."""

    def __init__(self):
        self.text = ""  # the signature read from its end
        self.cost, self.letter, self.to = array("q"), bytearray(), bytearray()
        self.made = 0
        self._node([(0, "", q) if q in END else None for q in range(4)])

    def _node(self, ways: list) -> None:
        """Adds a node: per state the best way without an insertion (None: none), then insertions relaxed."""
        best = list(ways)
        changed = True
        while changed:
            changed = False
            for q in range(4):
                on = best[NEXT[q]]
                if on is not None:
                    way = (on[0] + INSERT, "I", NEXT[q])
                    if best[q] is None or way[:2] < best[q][:2]:
                        best[q], changed = way, True
        for cost, letter, to in best:
            self.cost.append(cost)
            self.letter.append(ord(letter or " "))
            self.to.append(to)
        self.made += 1

    def _push(self, symbol: str) -> None:
        ahead = self.cost[-4:]
        kind, extra = symbol.lower(), TRUNCATED if symbol.isupper() else 0
        ways = []
        for q in range(4):
            options = [(DELETE + ahead[q], "D", q)]
            if kind != GONE:
                options.append((REROLE + extra + ahead[NEXT[q]], "R", NEXT[q]))
                if q in AFTER[kind]:
                    options.append((KEEP + extra + ahead[AFTER[kind][q]], "K", AFTER[kind][q]))
            ways.append(min(options, key=lambda o: o[:2]))
        self._node(ways)

    def solve(self, backwards: str) -> tuple[int, str]:
        """(cost, audit) of the signature that reads ``backwards`` from its end; nodes of the suffix that it
        shares with the one before are kept."""
        n, most = 0, min(len(backwards), len(self.text))
        while n < most and backwards[n] == self.text[n]:
            n += 1
        keep = 4 * (n + 1)
        del self.cost[keep:], self.letter[keep:], self.to[keep:]
        for symbol in backwards[n:]:
            self._push(symbol)
        self.text = backwards
        node, q, audit = len(backwards), START, bytearray()
        while node or q not in END:
            at = 4 * node + q
            audit.append(self.letter[at])
            node, q = node - (self.letter[at] != ord("I")), self.to[at]
        return self.cost[4 * len(backwards) + START], audit.decode()


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, gone): ``rows`` with faults chosen by crc32("conv:turn") % 20: 0 drops the row
    (it stays as ``gone``), 1 empties the text, 2 removes its end marks, 3 repeats the row, 4 makes it user."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), said(role).alias("role"), said(text).alias("text"))
    fault = F.crc32(F.concat(said("conv"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = rows.withColumn("fault", fault)
    return rows.select(
        "conv", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("fault") == 0).alias("gone"), F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("_")).drop("_")


def plain(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text, gone) of rows as they are."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return rows.select(F.col(conv).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), said(role).alias("role"), said(text).alias("text"),
                       F.lit(False).alias("gone"))


def _order(rows: DataFrame) -> DataFrame:
    """Adds what orders the turns of one number: head, t1, t2."""
    return rows.withColumns({"head": F.substring("text", 1, 32), "t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})


def _initial(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise(F.lit("o"))


def signatures(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, signature): one row per conversation of ``rows``
    (conv, turn, role, text, gone)."""
    end = F.rtrim("text", F.lit(SPACES))
    narrow = _order(rows).select("conv", "gone", "turn", "role", "head", "t1", "t2", (end == "").alias("blank"),
                                 (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    seen = F.row_number().over(W.partitionBy("conv", "gone", "role", "t1", "t2").orderBy("turn")) > 1
    fault = F.when(F.col("blank"), "b").when(F.col("again"), "d").when(F.col("cut"), "t").otherwise("-")
    narrow = narrow.withColumn("again", seen).select("conv", "gone", "turn", "role", "head", "t1", "t2", "again", fault.alias("fault"), _initial(F.col("role")).alias("initial"))
    stream = narrow.repartition("conv").sortWithinPartitions("conv", "turn", "role", "head", "t1", "t2", "again").select("conv", "gone", "turn", "fault", "initial")
    schema = pa.schema([("conv", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("signature", pa.string())])

    def run(it):
        def told():
            conv, first, last, turns, faults, illegal, signature = None, None, None, 0, {}, 0, None
            before = ""

            def row():
                gaps = last - first + 1 - turns if turns else 0
                return (conv, min(gaps, (1 << 63) - 1), *(faults.get(f, 0) for f in "bdt"), illegal, signature.decode())

            for batch in it:
                for c, gone, turn, fault, initial in zip(*(batch.column(k).to_pylist() for k in range(5))):
                    if signature is None or c != conv:
                        if signature is not None:
                            yield row()
                        conv, first, last, turns, faults, illegal, signature, before = c, None, None, 0, {}, 0, bytearray(), ""
                    if gone:
                        continue
                    if turn is not None and turn != last:
                        first, last, turns = turn if first is None else first, turn, turns + 1
                    faults[fault] = faults.get(fault, 0) + 1
                    illegal += bool(before) and before + initial not in ("su", "ua", "au")
                    before = initial
                    signature += (GONE if fault in "bd" else initial.upper() if fault == "t" else initial).encode()
            if signature is not None:
                yield row()

        yield from batches(told(), schema, lambda r: len(r[-1]))

    return stream.mapInArrow(run, ", ".join(f"{f.name} {'string' if f.name == 'signature' else 'bigint'}" for f in schema))


def solved(found: DataFrame) -> DataFrame:
    """(signature, cost, audit) of the distinct signatures of ``found``."""
    once = found.select("signature").distinct().select(F.reverse("signature").alias("back"))
    schema = pa.schema([("signature", pa.string()), ("cost", pa.int64()), ("audit", pa.string())])

    def run(it):
        def told():
            path = Suffixes()
            for batch in it:
                for back in batch.column(0).to_pylist():
                    yield (back[::-1], *path.solve(back))

        yield from batches(told(), schema, lambda r: 2 * len(r[0]))

    return once.repartitionByRange("back").sortWithinPartitions("back").mapInArrow(run, "signature string, cost bigint, audit string")


def plans(rows: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit): one row per conversation."""
    found = saved(signatures(rows), "signatures")
    return saved(found.join(solved(found), "signature").drop("signature"), "plans")


class _Edits:
    """The edits of one conversation applied to its turns as they come; ``out`` gets (edit, role, text)."""

    def __init__(self, audit: str, out):
        self.audit, self.at, self.state, self.out = audit, 0, START, out

    def inserts(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            self.state = NEXT[self.state]
            self.out("I", ROLE[self.state].encode(), b"")

    def turn(self, role: bytes, text: bytes) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = AFTER[chr(role[0])][self.state]
        elif edit == "R":
            self.state = NEXT[self.state]
            role = ROLE[self.state].encode()
        if edit != "D":
            self.out(edit, role, text)


def _streamed(rows: DataFrame, plan: DataFrame, make, schema: pa.Schema, ddl: str) -> DataFrame:
    """Each conversation's turns after its plan, in order. ``make(counts)`` gives for a conversation its sink
    (edit, role, text) and a function of the rows that the conversation adds at its end."""
    turns = _order(rows.where("NOT gone")).select("conv", F.lit(1).alias("kind"), "turn", "role", "head", "t1", "t2", "text", *[F.lit(None).cast("long").alias(c) for c in (*COUNTS, "cost")],
                                                  F.lit(None).cast("string").alias("audit"))
    none = {"kind": F.lit(0), "turn": F.lit(None).cast("long"), "role": F.lit(""), "head": F.lit(""), "t1": F.lit(0).cast("long"), "t2": F.lit(0).cast("long"), "text": F.lit("")}
    both = turns.unionByName(plan.withColumns(none))
    stream = both.repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "head", "t1", "t2")
    stream = stream.select("kind", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"), "conv", *COUNTS, "cost", "audit")

    def run(it):
        def told():
            edits = ready = None
            for whole in it:
                for at in range(0, whole.num_rows, 256):
                    batch = whole.slice(at, 256)
                    facts = zip(*(batch.column(k).to_pylist() for k in range(3, batch.num_columns)))
                    for kind, role, text, fact in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), facts):
                        if kind:
                            edits.turn(role, text)
                        else:
                            if edits is not None:
                                edits.inserts()
                                yield from ready(True)
                            sink, ready = make(fact)
                            edits = _Edits(fact[-1], sink)
                        yield from ready(False)
            if edits is not None:
                edits.inserts()
                yield from ready(True)

        yield from batches(told(), schema, lambda r: sum(len(v) for v in r if isinstance(v, (bytes, str))))

    return stream.mapInArrow(run, ddl)


def repaired_turns(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """(conv, position from 0, role, text, edit): the turns of the repaired conversations."""
    schema = pa.schema([("conv", pa.int64()), ("position", pa.int64()), ("role", pa.binary()), ("text", pa.binary()), ("edit", pa.string())])

    def make(fact):
        done, count = [], [0]

        def sink(edit, role, text):
            done.append((fact[0], count[0], role, text, edit))
            count[0] += 1

        def ready(_):
            out = done[:]
            done.clear()
            return out

        return sink, ready

    out = _streamed(rows, plan, make, schema, "conv bigint, position bigint, role binary, text binary, edit string")
    return out.withColumns({"role": F.col("role").cast("string"), "text": F.col("text").cast("string")})


def report(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``plan`` and repaired_sha256: the digest of the repaired ``role:text``, joined by newlines."""
    names = ["conv", *COUNTS, "cost", "audit", "repaired_sha256"]
    schema = pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in names])

    def make(fact):
        digest, some = hashlib.sha256(), []

        def sink(_, role, text):
            if some:
                digest.update(b"\n")
            some[:] = [True]
            digest.update(role + b":" + text)

        return sink, lambda last: [(*fact, digest.hexdigest())] if last else ()

    return _streamed(rows, plan, make, schema, ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'bigint'}" for f in schema))
