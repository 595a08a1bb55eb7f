"""Conversation repair against a search over all rows of edits, and against a plain version of the query."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

pytest.importorskip("corvane.llm")

from corvane.llm import repair  # noqa: E402

SCHEMA = "conv_id long, turn long, role string, text string, own string"
WHITE = " \t\n\x0b\x0c\r"
FULL = re.compile(r"(s?(ua)+)?")


def cheapest(turns):
    """turns: (initial, fault). The least (cost, audit) by best-first search over unrestricted role strings."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, k, roles = heapq.heappop(heap)
        if k == len(turns) and FULL.fullmatch(roles):
            return cost, audit
        key = (k, roles[-1:] or "-")
        if (key, "full") in done or not re.fullmatch(r"s?(ua)*u?", roles):
            continue
        done.add((key, "full"))
        for r in "ua":
            heapq.heappush(heap, (cost + 5, audit + "I", k, roles + r))
        if k < len(turns):
            initial, fault = turns[k]
            heapq.heappush(heap, (cost + 2, audit + "D", k + 1, roles))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                heapq.heappush(heap, (cost + more, audit + "K", k + 1, roles + (initial or "?")))
                for r in "ua":
                    heapq.heappush(heap, (cost + 1 + more, audit + "R", k + 1, roles + r))
    raise AssertionError


def code(turns):
    return bytes(3 * ("sua".index(i) if i and i in "sua" else 3) + {None: 0, "blank": 1, "duplicate": 1, "truncated": 2}[f] for i, f in turns)


def random_turns(rng, n):
    return [(rng.choice("suauaxua"), rng.choice([None, None, None, "blank", "duplicate", "truncated"])) for _ in range(n)]


def test_least_audit_of_the_cheapest_repairs():
    rng = random.Random(3)
    for n in [*range(12)] * 60:
        turns = random_turns(rng, n)
        assert repair.repair(code(turns)) == cheapest(turns), turns


def test_halves_meet_as_the_whole(monkeypatch):
    rng = random.Random(4)
    cases = [random_turns(rng, n) for n in range(2, 60)]
    whole = [repair.repair(code(t)) for t in cases]
    monkeypatch.setattr(repair, "LEAF", 1)
    assert [repair.repair(code(t)) for t in cases] == whole
    assert whole[-1] == cheapest(cases[-1])
    long = code(random_turns(rng, 20_000))
    monkeypatch.setattr(repair, "LEAF", 64)
    cost, audit = repair.repair(long)
    assert len(audit.replace("I", "")) == 20_000 and cost == sum({"K": 0, "R": 1, "D": 2, "I": 5}[x] for x in audit) + 5 * sum(1 for c, x in zip(long, audit.replace("I", ""), strict=True) if c % 3 == 2 and x != "D")


def plain(rows):
    """The query row by row."""
    convs, out = {}, {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = convs.setdefault(conv, [])
        if what == 0:
            continue
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        own += [(turn, "user" if what == 4 else role, text)] * (2 if what == 3 else 1)
    for conv, own in convs.items():
        own.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        turns, seen, faults = [], set(), dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in own:
            end = text.rstrip(WHITE)
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            turns.append((role[:1], fault))
        cost, audit = cheapest(turns)
        numbers = [t for t, _, _ in own if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(turns, turns[1:]))
        lines, roles, k = [], "", 0
        for x in audit:
            wanted = "assistant" if roles.endswith("u") else "user"
            if x == "I":
                lines.append(f"{wanted}:")
                roles += wanted[0]
                continue
            _, role, text = own[k]
            k += 1
            if x != "D":
                role = wanted if x == "R" else role
                lines.append(f"{role}:{text}")
                roles += role[0]
        assert FULL.fullmatch(roles)
        out[conv] = (gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def check(spark, rows):
    got = repair.report(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == plain(rows) and len(got) == len(plain(rows))


def test_edges_equal_the_plain_version(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(["Yes.", "No!", "open", " \n", "", None, "end. \x0b", "é?"])) for c in range(60) for t in range(rng.randrange(9))]
    rows += [(None, 0, "user", "hi."), (None, None, "assistant", "ho."), (200, None, None, None), (200, None, None, None), (201, 5, "user", "a b c. " * 40_000), (202, 3, "user", "x"), (202, 3, "user", "x"), (202, 9, "assistant", "y.")]
    rows += [(300, t, ("user", "assistant")[t % 2], f"t {t // 3}.") for t in range(700)]
    check(spark, rows)
    dropped = next(k for k in range(1000, 2000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    check(spark, [(dropped, 0, "user", "gone.")])
    assert repair.report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_whole_table_equals_the_plain_version(spark):
    from corvane.llm import queries

    d = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {r["conv_id"]: tuple(r)[1:] for r in queries.queries()["op12_conversation_repair"](spark, d).collect()} == plain(rows)
