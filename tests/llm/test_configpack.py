"""Configuration packing: ids and pieces against the library's plain call, windows against best fit and the area bound."""

import random
import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("corvane.llm")

import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from corvane.llm import bytewords, configpack, queries  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, number string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_plain_call(tokenizer):
    own, rng = bytewords.ByteWords(PATH), random.Random(2)
    assert own.quick is not None
    parts = ["a", "b", " ", "\n", "  ", "\n\n", "é", " ", "　", "\x85", "1", "22", "'s", "'", "don't", ".", "!?", "<|endoftext|>", "İ", "日本", "\U0001f600", "\t", "\x1c", "\x00", "ſ", "'Ll", "word.", " Word;"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(10_000)] + [" " * 3000, "a" * 3000, "x y " * 2000, "\n" * 50]
    ids, ends = own.batch(pa.array([*texts, None]))
    got = np.split(ids, ends[:-1])
    assert [g.tolist() for g in got] == [*(tokenizer.encode(t, add_special_tokens=False).ids for t in texts), []]


def best_fit(histogram, window):
    rooms, full = [], 0
    for n in sorted(histogram, reverse=True):
        for _ in range(histogram[n]):
            at = bisect_left(rooms, n)
            room = (rooms.pop(at) if at < len(rooms) else window) - n
            if room:
                insort(rooms, room)
            else:
                full += 1
    return len(rooms) + full


def laid(histogram, plan, window):
    """The windows of a plan, checked to hold every rest once and no more than fits."""
    load = Counter()
    for n, table in plan.arrays().items():
        first = 0
        for start, many, at, each in table.tolist():
            assert start == first and many % each == 0
            first += many
            for w in range(many // each):
                load[at + w] += n * each
        assert first == histogram[n]
    assert set(load) == set(range(plan.windows)) and max(load.values(), default=0) <= window
    return plan.windows


def test_few_windows():
    rng = random.Random(4)
    draws = {
        "even": lambda: rng.randint(1, 1023), "short": lambda: rng.randint(1, 80), "long": lambda: rng.randint(520, 1023), "half": lambda: rng.choice([512, 513, 511, 342, 341]), "one": lambda: 600,
        "skew": lambda: min(1023, int(rng.expovariate(1 / 300)) + 1),
    }
    for name, draw in draws.items():
        for n in (1, 50, 4000):
            histogram = Counter(draw() for _ in range(n))
            got = laid(histogram, configpack.plan(histogram), 1024)
            assert got <= best_fit(histogram, 1024) * 1.005 + 1, (name, n)
    assert configpack.plan({}).windows == 0 and configpack.plan({1024: 9}).windows == 0
    many = {n: 10**9 for n in range(1, 1024)}
    assert configpack.plan(many).windows <= 1.01 * sum(n * c for n, c in many.items()) / 1024


def test_price_equals_trying_all():
    lengths, weights = np.array([2, 3, 5]), np.array([2.0, 3.7, 5.5])
    best, choice = configpack.price(lengths, weights, 11)
    for room in range(12):
        assert best[room] == max(a * 2.0 + b * 3.7 + c * 5.5 for a in range(6) for b in range(4) for c in range(3) if 2 * a + 3 * b + 5 * c <= room)
    way, free = configpack.filling(2, [2, 3, 5], choice, 11)
    assert way == {2: 1, 1: 2} and free == 0


def check(rows, got, tokenizer):
    whole = sorted(tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for _, t in rows)
    by_doc = Counter()
    for r in got:
        assert r["length"] == 1024 or r["piece"] == 0 and 0 < r["length"] < 1024
        assert r["piece"] == -(-r["start"] // 1024)
        by_doc[r["doc_id"]] += r["length"]
    want = Counter()
    for d, t in rows:
        want[d] += len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    assert by_doc == want and sum(map(len, whole)) == sum(by_doc.values())
    windows = {}
    for r in got:
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in windows.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 1024
    return len(windows)


def test_edges(spark, tokenizer):
    rows = [(1, None), (2, ""), (None, "no id"), (None, None), (3, "same"), (3, "same"), (3, "other"), (4, "word " * 5000), (5, "a" * 20_000), (6, " " * 9000), (7, "x <|endoftext|> y"), (8, " ".join(["end"] * 1023)), (9, " ".join(["end"] * 1024))]
    got = configpack.pack(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), PATH).collect()
    check(rows, got, tokenizer)
    assert [(r["length"], r["piece"]) for r in got if r["doc_id"] == 8] == [(1024, 0)]
    assert sorted((r["piece"], r["start"], r["length"]) for r in got if r["doc_id"] == 9) == [(0, 0, 1), (1, 1, 1024)]
    assert configpack.pack(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_whole_table(spark, tokenizer):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.queries()["op13_config_packing"](spark, d).collect()
    windows = check(rows, got, tokenizer)
    total = sum(r["length"] for r in got)
    assert windows <= 1.05 * total / 1024 + 1
    ids = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t in rows}
    assert all(r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) for r in got)
