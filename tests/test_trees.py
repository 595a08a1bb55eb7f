"""The tree against one grown in plain Python, and its edge cases."""

from collections import Counter

import numpy as np
import pytest

from corvane.operators import trees


def slow(at, y, depth, least, node=1, out=None):
    """Splits and leaves by trying every cut of every node."""
    out = {} if out is None else out
    best, n = None, len(y)
    whole = round(sum(v * v for v in Counter(y.tolist()).values()) / n, 6)
    if depth:
        for d in range(at.shape[1]):
            for b in range(int(at.max()) + 1):
                left = at[:, d] <= b
                if left.sum() < least or n - left.sum() < least:
                    continue
                p = round(sum(sum(v * v for v in Counter(y[s].tolist()).values()) / s.sum() for s in (left, ~left)), 6)
                if p > whole and (best is None or p > best[0]):
                    best = (p, d, b)
    if best is None:
        c = Counter(y.tolist())
        out[node] = (min(k for k in c if c[k] == max(c.values())), n)
    else:
        out[node] = best[1:]
        left = at[:, best[1]] <= best[2]
        slow(at[left], y[left], depth - 1, least, 2 * node, out)
        slow(at[~left], y[~left], depth - 1, least, 2 * node + 1, out)
    return out


@pytest.mark.parametrize("depth, bins, least, labels", [(3, 8, 1, 3), (2, 4, 5, 2), (4, 5, 2, 4)])
def test_tree_equals_one_grown_by_hand(spark, depth, bins, least, labels):
    r = np.random.default_rng(depth)
    x = r.integers(0, bins, (150, 4)).astype(float)
    x[0], x[1] = 0, bins  # the whole width, so that bins are the values themselves
    y = ((x[:, 0] + 2 * x[:, 2] + r.integers(0, 3, 150)) % labels).astype(int)
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x))], "id long, label int, v array<double>")
    t = trees.grow(df, "label", "v", depth, bins, least)
    got = {r["node"]: (r["dim"], r["bin"]) for r in t.splits.collect()} | {r["node"]: (r["guess"], r["n"]) for r in t.leaves.collect()}
    assert got == slow(np.minimum(x, bins - 1).astype(int), y, depth, least)
    told = {r["id"]: (r["node"], r["guess"]) for r in trees.predict(t, df, "v").collect()}
    assert Counter(n for n, _ in told.values()) == {n: v for n, (_, v) in got.items() if n in {a for a, _ in told.values()}}


def test_nulls_ties_constant_values_and_empty_tables(spark):
    schema = "id long, label int, v array<double>"
    same = spark.createDataFrame([(1, 2, [0.0]), (2, 1, [0.0]), (3, None, [1.0]), (4, 1, None), (None, 2, [0.0])], schema)
    t = trees.grow(same, "label", "v")
    assert t.splits.isEmpty() and [tuple(r) for r in t.leaves.collect()] == [(1, 2, 3)]
    guesses = {r["id"]: r["guess"] for r in trees.predict(t, same, "v").collect()}
    assert guesses == {1: 2, 2: 2, 3: 2, 4: None, None: 2}
    empty = spark.createDataFrame([], schema)
    none = trees.grow(empty, "label", "v")
    assert none.leaves.isEmpty() and trees.predict(none, empty, "v").isEmpty()
    with pytest.raises(ValueError):
        trees.grow(same, "label", "v", depth=13)
    far = trees.grow(spark.createDataFrame([(i, i // 5, [float(i)]) for i in range(10)], schema), "label", "v", 1, 10)
    outside = spark.createDataFrame([(1, 0, [-99.0]), (2, 1, [99.0])], schema)
    assert {r["id"]: r["guess"] for r in trees.predict(far, outside, "v").collect()} == {1: 0, 2: 1}
