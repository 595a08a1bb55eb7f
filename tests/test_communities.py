"""Label propagation runs to its end."""

import pytest

from corvane.operators import graph


def test_long_chains_are_one_community_each(spark):
    chain = lambda ids: list(zip(ids, ids[1:]))
    rows = chain(range(0, 600)) + chain(range(1000, 1012))
    got = {r["node"]: (r["community"], r["size"]) for r in graph.communities(spark.createDataFrame(rows, "src long, dst long")).collect()}
    assert got == {i: (0, 600) for i in range(600)} | {i: (1000, 12) for i in range(1000, 1012)}


def test_labels_that_still_change_are_an_error(spark):
    with pytest.raises(ValueError):
        graph.communities(spark.createDataFrame([(i, i + 1) for i in range(40)], "src long, dst long"), rounds=2)
