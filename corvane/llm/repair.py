"""Repair of conversation structure by Hirschberg's divide and conquer.

A conversation is a row of turns; an edit keeps a turn (0), gives it the other role (1), deletes it (2) or inserts an
empty turn (5), and a truncated turn that stays costs 5 more; blank and repeated turns must go.  Afterwards the initials
of the roles must read ``(s?(ua)+)?``, which four states follow: nothing yet, after s, after u, after a.  Between turns
only the cost of being in each state matters.  :func:`repair` takes the cheapest row of edits, of equal ones the least in ASCII (the audit):

* :func:`forward` carries four costs from the left, and for each state the rank of its least audit among the four;
* :func:`backward` carries four costs from the right;
* where they meet in the middle, the state of least sum is the crossing, of equal ones that of the least rank; both
  halves are solved alike, so nothing but the turns, four numbers and the audit is ever held.

An insertion belongs to the turn after it, so audits up to a place all hold as many turns and end with one: none
begins another, and ranks decide without the texts of the audits.  State and letter fix the next state, so an audit says all.

In Spark, a first pass works on rows without their texts: faults are columns, repeats are found by windows over hashes
of role and text (which part large conversations), and a sorted stream of one byte for each turn gives the audits.  A second pass sorts the texts
behind the audit of their conversation and streams them into the digest, so no conversation's texts are held.

Defined cases: nulls in role, text and the key of the damage are one space; a null conv_id is a conversation of its own;
turns of equal number are put in order of role and text (by 64 characters, then by hash); repeated rows are turns of
their own; a conversation all of whose rows are dropped has zeros, an empty audit and the digest of the empty text; an
empty table gives an empty result; further columns are ignored.  Roles of other initials fit nowhere and can only be changed or deleted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import WHITE, bounded_batches, partitions, saved

#: Costs of the edits and of a truncated turn that stays.
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: Initials that have states of their own; the next state by a turn of that initial (-1: not allowed).
INITIALS = "sua"
NONE, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {"s": (SYSTEM, -1, -1, -1), "u": (USER, USER, -1, USER), "a": (-1, -1, ASSISTANT, -1)}
#: The state and role that an inserted or changed turn leads to.
WANTED = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: Insertions that end a conversation in each state.
TAILS = ("", "II", "I", "")
#: A turn's code is 3 * (place of its initial in INITIALS, else 3) + its fault.
SOUND, MUST_GO, TRUNCATED = range(3)
#: Turns that are solved by themselves.
LEAF = 64
FAR = 1 << 60
Step = tuple[int, int, int, str]


def _steps(code: int) -> list[Step]:
    """from, to, cost, letters: the best way between each two states across one turn, insertions first."""
    role, fault = divmod(code, 3)
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for state, many in product(range(4), range(3)):
        at = state
        for _ in range(many):
            at = WANTED[at]
        ways = [(at, DELETE, "D")]
        if fault != MUST_GO:
            more = CUT if fault == TRUNCATED else 0
            ways.append((WANTED[at], REROLE + more, "R"))
            if role < 3 and NEXT[INITIALS[role]][at] >= 0:
                ways.append((NEXT[INITIALS[role]][at], KEEP + more, "K"))
        for to, cost, letter in ways:
            way = (many * INSERT + cost, "I" * many + letter)
            best[state, to] = min(best.get((state, to), way), way)
    return [(a, b, c, t) for (a, b), (c, t) in sorted(best.items())]


STEPS = [_steps(code) for code in range(12)]


def forward(codes: bytes, state: int) -> tuple[list[int], list[int]]:
    """The least cost of each state after the turns, and the rank of its least audit among those of the states."""
    cost, rank = [FAR] * 4, [0, 1, 2, 3]
    cost[state] = 0
    for code in codes:
        ways: list = [None] * 4
        for a, b, c, letters in STEPS[code]:
            if cost[a] < FAR:
                way = (cost[a] + c, rank[a], letters)
                if ways[b] is None or way < ways[b]:
                    ways[b] = way
        cost = [w[0] if w else FAR for w in ways]
        order = sorted((w[1], w[2], b) for b, w in enumerate(ways) if w)
        rank = [4] * 4
        for k, (_, _, b) in enumerate(order):
            rank[b] = k
    return cost, rank


def backward(codes: bytes, state: int) -> list[int]:
    """The least cost from each state across the turns to ``state``."""
    cost = [FAR] * 4
    cost[state] = 0
    for code in reversed(codes):
        now = [FAR] * 4
        for a, b, c, _ in STEPS[code]:
            if cost[b] + c < now[a]:
                now[a] = cost[b] + c
        cost = now
    return cost


@lru_cache(1 << 14)
def _leaf(codes: bytes, state: int) -> list[tuple[int, str] | None]:
    """The least cost and audit of each state after a few turns."""
    own: list[tuple[int, str] | None] = [None] * 4
    own[state] = (0, "")
    for code in codes:
        now: list[tuple[int, str] | None] = [None] * 4
        for a, b, c, letters in STEPS[code]:
            if own[a]:
                way = (own[a][0] + c, own[a][1] + letters)
                if now[b] is None or way < now[b]:
                    now[b] = way
        own = now
    return own


def _between(codes: memoryview, a: int, b: int, out: list[str]) -> None:
    """Adds the least audit across the turns from state a to state b, in order."""
    if len(codes) <= LEAF:
        out.append(_leaf(bytes(codes), a)[b][1])
        return
    half = len(codes) // 2
    cost, rank = forward(codes[:half], a)
    rest = backward(codes[half:], b)
    crossing = min(range(4), key=lambda q: (cost[q] + rest[q], rank[q]))
    _between(codes[:half], a, crossing, out)
    _between(codes[half:], crossing, b, out)


def repair(codes: bytes) -> tuple[int, str]:
    """Cost and audit of the cheapest repair."""
    if len(codes) <= LEAF:
        return min((w[0] + INSERT * len(t), w[1] + t) for w, t in zip(_leaf(bytes(codes), NONE), TAILS, strict=True) if w)
    cost, rank = forward(codes, NONE)
    end = min(range(4), key=lambda q: (cost[q] + INSERT * len(TAILS[q]), rank[q]))
    out: list[str] = []
    _between(memoryview(codes), NONE, end, out)
    return cost[end] + INSERT * len(TAILS[end]), "".join(out) + TAILS[end]


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, copy, role, text after the damage; a dropped row stays, without its text, as copy -1."""
    filled = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    what = F.pmod(F.crc32(F.concat(filled["conv_id"], F.lit(":"), filled["turn"]).cast("binary")), F.lit(20))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), filled["role"].alias("role"), filled["text"].alias("text"), what.alias("what"))
    w = F.col("what")
    text = F.when(w.isin(0, 1), "").when(w == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(w == 0, F.array(F.lit(-1))).when(w == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.explode(copies).alias("copy"), F.when(w == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


ORDER = ["turn", "role", "head", "hash", "copy"]


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("head", F.substring("text", 1, 64)).withColumn("hash", F.unhex(F.md5(F.col("text").cast("binary"))))


def _sorted(rows: DataFrame, *first: str) -> DataFrame:
    """The rows of each conversation next to each other and in order, streamed."""
    return rows.repartition(partitions(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", *first, *ORDER)


def coded(rows: DataFrame) -> DataFrame:
    """Adds fault: blank, duplicate, truncated or none, whichever comes first; the texts are dropped."""
    end: Column = F.rtrim(F.col("text"), F.lit(WHITE))
    rows = _keyed(rows).select("conv_id", *ORDER, (end == "").alias("blank"), (~F.substring(end, -1, 1).isin(".", "!", "?")).alias("open"))
    earlier = Window.partitionBy("conv_id", F.col("copy") < 0, "role", "hash").orderBy(*ORDER)
    rows = rows.withColumn("again", F.row_number().over(earlier) > 1)
    fault = F.when(F.col("blank"), "blank").when(F.col("again"), "duplicate").when(F.col("open"), "truncated")
    return rows.select("conv_id", *ORDER, fault.alias("fault"))


AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
FAULTS = {None: SOUND, "blank": MUST_GO, "duplicate": MUST_GO, "truncated": TRUNCATED}
LEGAL = {(0, 1), (1, 2), (2, 1)}


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds, strict=True)], _names(schema))


class _Audit:
    """What is kept of a conversation while its coded turns go by: one byte for each, and counts."""

    def __init__(self, conv: int | None) -> None:
        self.conv, self.codes, self.faults = conv, bytearray(), dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.first = self.last = self.role = None
        self.distinct = self.illegal = 0

    def add(self, turn: int | None, role: int, fault: str | None) -> None:
        self.codes.append(3 * role + FAULTS[fault])
        if fault:
            self.faults[fault] += 1
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.distinct += 1
        if self.role is not None and (self.role, role) not in LEGAL:
            self.illegal += 1
        self.role = role

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return self.conv, gaps, *self.faults.values(), self.illegal, *repair(bytes(self.codes))


def audits(rows: DataFrame) -> DataFrame:
    """For each conversation of damaged rows the counts of faults, and cost and audit of its repair."""
    bounded_batches(rows.sparkSession)
    place = F.instr(F.lit(INITIALS), F.substring("role", 1, 1))
    role = F.when(F.substring("role", 1, 1) == "", 3).when(place > 0, place - 1).otherwise(3)
    turns = _sorted(coded(rows)).select("conv_id", "turn", "copy", role.alias("role"), "fault")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for b in batches:
            for conv, turn, copy, role, fault in zip(*(b.column(c).to_pylist() for c in ("conv_id", "turn", "copy", "role", "fault")), strict=True):
                if now is None or now.conv != conv:
                    out += [now.row()] if now else []
                    now = _Audit(conv)
                if copy >= 0:
                    now.add(turn, role, fault)
            if len(out) >= 1000:
                yield _batch(out, AUDIT)
                out = []
        out += [now.row()] if now else []
        yield _batch(out, AUDIT)

    return turns.mapInArrow(run, AUDIT)


class _Repaired:
    """The digest of a repaired conversation while its turns go by behind its audit."""

    def __init__(self, row: tuple) -> None:
        self.row, self.letters, self.at, self.state, self.lines, self.digest = row, row[-1], 0, NONE, 0, hashlib.sha256()

    def line(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.lines else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.lines += 1

    def insertions(self) -> None:
        while self.at < len(self.letters) and self.letters[self.at] == "I":
            self.state = WANTED[self.state]
            self.line(ROLE[self.state], "")
            self.at += 1

    def turn(self, role: str, text: str) -> None:
        self.insertions()
        letter = self.letters[self.at]
        self.at += 1
        if letter == "R":
            self.state = WANTED[self.state]
            self.line(ROLE[self.state], text)
        elif letter == "K":
            self.state = NEXT[role[0]][self.state]
            self.line(role, text)

    def done(self) -> tuple:
        self.insertions()
        return *self.row, self.digest.hexdigest()


def report(conversations: DataFrame) -> DataFrame:
    """Faults, repair and digest of the repaired text of every conversation, after the damage."""
    bounded_batches(conversations.sparkSession)
    rows = damaged(conversations)
    solved = saved(audits(rows), "audits").withColumn("kind", F.lit(0))
    texts = _keyed(rows.filter("copy >= 0")).withColumn("kind", F.lit(1))
    both = _sorted(solved.unionByName(texts, allowMissingColumns=True), "kind").select(*_names(AUDIT), "kind", "role", "text")
    schema = AUDIT + ", repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for b in batches:
            columns = [b.column(c).to_pylist() for c in (*_names(AUDIT), "kind", "role", "text")]
            for row in zip(*columns, strict=True):
                if row[-3] == 0:
                    out += [now.done()] if now else []
                    now = _Repaired(row[:-3])
                else:
                    now.turn(*row[-2:])
            if len(out) >= 1000:
                yield _batch(out, schema)
                out = []
        out += [now.done()] if now else []
        yield _batch(out, schema)

    return both.mapInArrow(run, schema)
