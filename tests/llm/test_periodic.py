"""Runs, Lyndon arrays and the query's digests against brute force."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

pytest.importorskip("corvane.llm")

from corvane.llm import periodic, queries  # noqa: E402

SCHEMA = "doc_id long, text string, start string"


def brute(w):
    out = []
    for p in range(1, len(w) // 4 + 1):
        s = 0
        while s + p < len(w):
            e = s
            while e + p < len(w) and w[e] == w[e + p]:
                e += 1
            n = e - s + p
            if e > s and n >= max(6, 4 * p) and not any(p % d == 0 and all(w[k] == w[k + d] for k in range(s, s + n - d)) for d in range(1, p)):
                out.append((s, n, p))
            s = e + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def lyndon(w):
    return [max(n for n in range(1, len(w) - i + 1) if n == 1 or all(w[i : i + n] < w[i + k : i + n] for k in range(1, n))) for i in range(len(w))]


def random_word(rng, most):
    k, w = rng.randint(1, 5), []
    while len(w) < most:
        w += [rng.randrange(k) for _ in range(rng.randint(1, 7))] * rng.randint(1, 7)
    return w[: rng.randint(1, most)]


def test_groups_are_the_lyndon_array():
    rng = random.Random(1)
    for _ in range(400):
        w = random_word(rng, 30)
        group, length = periodic.groups(np.array(w))
        assert [length[g] for g in group] == lyndon(w), w
        assert all((group[i] == group[j]) == (w[i : i + length[group[i]]] == w[j : j + length[group[j]]]) for i in range(len(w)) for j in range(i)), w


def test_runs_of_single_and_joined_texts():
    rng = random.Random(2)
    for _ in range(1500):
        texts = [random_word(rng, 120), random_word(rng, 40), [], random_word(rng, 9)]
        assert periodic.runs(np.array(texts[0])) == brute(texts[0])
        assert periodic.found(np.array([x for t in texts for x in t]), np.cumsum([len(t) for t in texts])) == [brute(t) for t in texts]


def test_long_periods_and_one_word_take_linear_time():
    rng = random.Random(3)
    root = [rng.randrange(500) for _ in range(30_000)]
    assert periodic.runs(np.array(root * 5)) == [(0, 150_000, 30_000)]
    assert periodic.runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]


def plain(doc, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc is not None and n:
        h = zlib.crc32(str(doc).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    own = brute(w)
    best = min(own, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if own else None
    gone = {k for s, m, p in own for k in range(s + p, s + m)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    digests = sha("".join(f"{s},{m},{p}\n" for s, m, p in own)), sha(" ".join(x for k, x in enumerate(w) if k not in gone))
    return (doc, len(own), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, *digests)


def test_edges(spark):
    damaged = [k for k in range(400) if zlib.crc32(str(k).encode()) % 10 == 0]
    rows = [(1, None), (2, ""), (3, " \t\x0b\n"), (None, "a b " * 9), (None, None), (4, "x " * 5), (5, "x\x0bx\nx  x x\tx"), (5, "x\x0bx\nx  x x\tx"), (6, "tie tie tie tie tie tie gap one two one two one two one two one two one two"), (7, ("é \U0001f600   ") * 4)]
    rows += [(d, " ".join(f"w{k}" for k in range(d % 57 + d))) for d in damaged] + [(8, "lorem ipsum dolor " * 30_000)]
    got = periodic.report(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    assert sorted(repr(tuple(r)) for r in got if r["doc_id"] != 8) == sorted(repr(plain(*r)) for r in rows[:-1])
    assert next(tuple(r)[1:6] for r in got if r["doc_id"] == 8) == (1, 0, 90_000, 3, 30_000_000)
    assert len(got) == len(rows)
    assert periodic.report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r) for r in queries.queries()["op11_periodic_runs"](spark, d).collect()}
    short = [r for r in rows if len(r["text"] or "") < 12_000]
    assert len(got) == len(rows) and len(short) > 150
    assert all(got[r["doc_id"]] == plain(*r) for r in short)
