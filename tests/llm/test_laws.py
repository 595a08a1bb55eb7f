"""The key law of shards for every count that is taken, and marks in the names of masked addresses."""

import pytest

pytest.importorskip("corvane.llm")

from corvane.llm import pii, sharding  # noqa: E402


def test_one_more_shard_takes_rows_only_into_itself(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "cast(id as string) as text")
    for n in (4, 8, 12):
        rows = sharding.assign(docs, n).collect()
        assert all(r["grown_shard"] in (r["shard"], n) for r in rows) and {r["shard"] for r in rows} == set(range(n))
    for n in (0, 3, 6, 9):
        with pytest.raises(ValueError):
            sharding.assign(docs, n)


def test_masked_addresses_are_found_from_their_beginning():
    text = "write to jo.smith+tag (at) host.org now"
    assert [text[a:b] for a, b, _ in pii.find(text, *pii.model())[1]] == ["jo.smith+tag (at) host.org"]


def test_a_directory_of_numbers_takes_time_in_proportion():
    import time

    trees, limits = pii.model()
    took = []
    for n in (4000, 16000):
        text = " ".join(f"name {k} 212-555-{k % 10000:04d}" for k in range(n))
        start = time.perf_counter()
        found = pii.find(text, trees, limits)[1]
        took.append(time.perf_counter() - start)
        assert len(found) > 0.9 * n
    assert took[1] < 10 * took[0]
