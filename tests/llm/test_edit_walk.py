"""The embedding walked a second time, naively, and classes against all pairs."""

import numpy as np
import pytest

pytest.importorskip("corvane.llm")

from corvane.llm import editembed as E  # noqa: E402

MASK = (1 << 64) - 1


def naive(text):
    """One character after the other; every slot keeps the hash of what stands at the last of its steps."""
    out, pos, j = [0] * E.SLOTS, 0, 0
    steps = {}
    for step, slot in zip(E._steps.tolist(), E._slots.tolist()):
        if step <= len(text) * 400:
            steps.setdefault(step, []).append(slot)
    while pos < len(text):
        gram = 0
        for k in range(E.GRAM):
            gram = (gram * 0x100000001B3 + (ord(text[pos + k]) + 1 if pos + k < len(text) else 0)) & MASK
        for slot in steps.get(j, ()):
            h = ((gram ^ (slot * 0x9E3779B97F4A7C15 & MASK)) * 0xD6E8FEB86659FD93) & MASK
            h = ((h ^ (h >> 32)) * 0xD6E8FEB86659FD93) & MASK
            out[slot] = (h >> 33) % 255 + 1
        bit = (ord(text[pos]) * 0x9E3779B1 & 0xFFFFFFFF) >> 26
        pos += int(E._words[j % E.PERIOD]) >> bit & 1
        j += 1
    return bytes(out)


def test_walk_equals_a_naive_one(spark):
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    texts = sorted(texts, key=len)[:90] + ["", "a", "é😀" * 70]
    assert [p.tobytes() for p in E.fingerprints(texts)] == [naive(t) for t in texts]


@pytest.mark.parametrize("small, block", [(32, 512), (4, 8)])
def test_classes_equal_all_pairs_that_share_a_band(spark, monkeypatch, small, block):
    monkeypatch.setattr(E, "SMALL", small)
    monkeypatch.setattr(E, "BLOCK", block)
    r = np.random.default_rng(1)
    prints = []
    for _ in range(6):
        base = r.integers(1, 255, E.SLOTS)
        for k in range(8):
            p = base.copy()
            p[r.choice(E.SLOTS, 3 * k, replace=False)] = r.integers(1, 255, 3 * k)
            prints.append(p.astype(np.uint8))
    hot = r.integers(1, 255, E.BAND)
    for _ in range(40):  # one band in common, nothing else
        p = r.integers(1, 255, E.SLOTS)
        p[: E.BAND] = hot
        prints.append(p.astype(np.uint8))
    prints += prints[:5]
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            b = prints[j]
            meet = any((a[k : k + E.BAND] == b[k : k + E.BAND]).all() for k in range(0, E.SLOTS, E.BAND))
            if meet and (a == b).mean() >= E.LEAST:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(i, p.tobytes()) for i, p in enumerate(prints)], "doc_id long, fingerprint binary")
    assert {x["doc_id"]: x["class_id"] for x in E.classes(df).collect()} == {i: find(i) for i in range(len(prints))}


def distance(a, b, most):
    """The edit distance of two texts if it is at most ``most``, else more: only cells near the diagonal are filled."""
    n, far = len(b), most + 1
    row = {j: j for j in range(min(n, most) + 1)}
    for i, x in enumerate(a, 1):
        now = {}
        for j in range(max(0, i - most), min(n, i + most) + 1):
            best = min(row.get(j, far) + 1, now.get(j - 1, far) + 1)
            if j:
                best = min(best, row.get(j - 1, far) + (x != b[j - 1]))
            now[j] = best if j else i
        row = now
    return row.get(n, far)


def test_classes_hold_nine_in_ten_texts_of_small_edit_distance(spark):
    """Texts with up to 0.2 % of their characters edited, against true edit distances; and unlike texts stay apart."""
    import random

    rng = random.Random(12)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if r["text"] and 100 < len(r["text"]) < 4000]
    texts = sorted(set(texts))[::3][:250]
    rows, pairs = [], 0
    for k, t in enumerate(texts):
        edits, new = max(1, len(t) // 500), list(t)
        for _ in range(edits):
            at, kind = rng.randrange(len(new)), rng.random()
            if kind < 0.34:
                new[at] = rng.choice("abcdefgh ")
            elif kind < 0.67:
                new.insert(at, rng.choice("abcdefgh "))
            else:
                del new[at]
        new = "".join(new)
        assert distance(t, new, edits) <= edits
        rows += [(2 * k, t), (2 * k + 1, new)]
        pairs += 1
    prints = E.fingerprints([t for _, t in rows])
    df = spark.createDataFrame([(i, p.tobytes()) for (i, _), p in zip(rows, prints, strict=True)], "doc_id long, fingerprint binary")
    got = {r["doc_id"]: r["class_id"] for r in E.classes(df).collect()}
    assert sum(got[2 * k] == got[2 * k + 1] for k in range(pairs)) >= 0.9 * pairs
