"""Transitive closure meets a pair of a chain once, and is right on cycles and short cuts."""

import random

from corvane.operators import graph


def reached(edges):
    out, step = set(), {}
    for a, b in edges:
        step.setdefault(a, set()).add(b)
    for a in step:
        todo = [a]
        while todo:
            for y in step.get(todo.pop(), ()):
                if (a, y) not in out:
                    out.add((a, y))
                    todo.append(y)
    return {p for p in out if p[0] != p[1]}


def test_closure_meets_pairs_once(spark, monkeypatch):
    rng, written, real = random.Random(2), [], graph.saved
    monkeypatch.setattr(graph, "saved", lambda df, name: written.append(real(df, name)) or written[-1])
    wild = [(rng.randrange(40), rng.randrange(40)) for _ in range(45)] + [(50, 51), (51, 52), (52, 50), (50, 52), (7, 7)]
    for edges in (wild, [(k, k + 1) for k in range(40)], [(1, 1)], []):
        written.clear()
        got = [tuple(r) for r in graph.closure(spark.createDataFrame([*edges, (None, 1), (3, None)], "src long, dst long")).collect()]
        assert len(got) == len(set(got)) and set(got) == reached(edges)
        assert sum(w.count() for w in written) == len(got)  # no round writes again what others found
