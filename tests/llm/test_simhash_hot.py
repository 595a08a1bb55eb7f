"""Fingerprints shared by very many rows, and how many blocks must agree as fingerprints grow in number."""

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("corvane.llm")

from corvane.llm import simhash  # noqa: E402
from tests.llm.test_ops import brute_components, brute_simhash  # noqa: E402


@pytest.mark.parametrize("prints", [0, 1_000_000])
def test_hot_fingerprints_are_named_alike(spark, monkeypatch, prints):
    monkeypatch.setattr(simhash, "HOT_ROWS", 5)
    monkeypatch.setattr(simhash, "HOT_PRINTS", prints)
    words = [f"w{i}" for i in range(400)]
    texts = {k: " ".join(words) for k in range(100, 140)} | {200: " ".join([*words[:200], "other", *words[201:]]), 3: "", 4: None, 5: " ", 300: "one"}
    texts |= {k: " " for k in range(400, 410)}
    got = {r["doc_id"]: r["component_id"] for r in simhash.report(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute_components({k: brute_simhash(t or "") for k, t in texts.items()})


def test_keys_grow_with_the_number_of_fingerprints():
    bits = [simhash.BITS * a // (r + a) for n in (10, 10**6, 10**9, 10**11) for r in (4, 8) for a in [simhash.agreeing_blocks(n, r)]]
    assert all(b >= w for b, w in zip(bits, (17, 17, 18, 18, 28, 28, 35, 35)))


def test_components_of_chains_hubs_and_repeated_edges(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 7)  # so that little is joined within a task
    rng = np.random.default_rng(2)
    at = rng.permutation(300) - 150
    edges = [(at[i], at[i + 1]) for i in range(60)] + [(at[70], at[i]) for i in range(71, 130)] + [(x, y) for x, y in rng.choice(at[140:], (90, 2))]
    edges = [(int(a), int(b)) for a, b in edges + edges[::3] + [(b, a) for a, b in edges[::5]]]
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(edges, "u long, v long").repartition(9)
    got = [tuple(r) for r in simhash.components(df).collect()]
    assert sorted(got) == sorted((n, r) for n, r in root.items() if n != r)
    assert simhash.components(df.limit(0)).collect() == []


def test_a_forest_of_stars_takes_no_round(spark, monkeypatch):
    """The driver holds records of every task and plan: six tables for one star were two rounds too many."""
    made, plain = [], simhash.saved
    monkeypatch.setattr(simhash, "saved", lambda df, name: made.append(name) or plain(df, name))
    got = simhash.components(spark.createDataFrame([(k, 1) for k in range(2, 50)], "u long, v long"))
    assert len(made) <= 2
    assert sorted(map(tuple, got.collect())) == [(k, 1) for k in range(2, 50)]


@pytest.mark.parametrize("size", [1, 3, 50])
def test_contracting_reads_all_batches(monkeypatch, size):
    monkeypatch.setattr(simhash, "CHUNK", 4)
    edges = [(k + 1, k) for k in range(10)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*edges[i : i + size])], ["u", "v"]) for i in range(0, 10, size)]
    got = [tuple(r.values()) for b in simhash._contract(iter(batches)) for r in b.to_pylist()]
    assert got == [(1, 0), (2, 0), (3, 0), (4, 0), (5, 4), (6, 4), (7, 4), (8, 4), (9, 8), (10, 8)]
