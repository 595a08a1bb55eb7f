"""Merging of graphs, ordered entity context and assembled contexts on worked examples."""

from corvane.operators import knowledge as K
from corvane.operators.numbering import gapless, running

NODE, EDGE = "id string, kind string, name string, type string, description string, sources array<string>", "src string, dst string, kind string, label string"


def graph(spark, nodes, edges):
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE)


def plain(g):
    return {tuple(map(repr, r)) for r in g[0].collect()}, {tuple(r) for r in g[1].collect()}


def test_merge_in_any_grouping(spark):
    a = graph(spark, [("s1", "section", "One", None, None, None), ("e1", "entity", "NB", "model", "short", ["b", "a"])], [("s1", "e1", "menciona", None)])
    b = graph(spark, [("s1", "section", "Other", None, "x", None), ("e1", "entity", "nb", "other", "longer", ["a", "c"]), ("e2", "entity", "LR", "model", "", ["c"])], [("s1", "e1", "menciona", "late"), ("e1", "e2", "relacion", "r")])
    c = graph(spark, [("e1", "entity", "x", "y", "equals", ["d"]), ("e2", "entity", "z", "t", "described", [])], [("e2", "e1", "relacion", "q"), ("e1", "e2", "relacion", "other")])
    left, right = K.merge(K.merge(a, b), c), K.merge(a, K.merge(b, c))
    assert plain(left) == plain(right)
    nodes = {r["id"]: r for r in left[0].collect()}
    assert nodes["e1"][2:] == ("NB", "model", "longer", ["a", "b", "c", "d"]) and nodes["e2"][2:] == ("LR", "model", "described", ["c"])
    assert nodes["s1"][2:] == ("One", None, None, None)
    assert {tuple(r) for r in left[1].collect()} == {("s1", "e1", "menciona", None), ("e1", "e2", "relacion", "r"), ("e2", "e1", "relacion", "q")}
    twice = K.merge(left, left)
    assert plain(twice) == plain(left)
    empty = graph(spark, [], [])
    assert plain(K.merge(empty, c))[1] == plain(c)[1] and plain(K.merge(c, empty))[0] == plain(c)[0]


def test_entities_in_order(spark):
    mentioned = spark.createDataFrame([("s", "b", 1), ("s", "a", 2), ("s", "b", 3), ("t", "a", 1)], "section string, entity string, seq long")
    relations = spark.createDataFrame([("a", "x", 1), ("y", "b", 2), ("b", "z", 3), ("z", "a", 4), ("b", "a", 5)], "src string, dst string, seq long")
    got = K.ranked_entities(mentioned, relations).orderBy("section", "place").collect()
    assert [(r[0], r[1]) for r in got] == [("s", "b"), ("s", "a"), ("s", "z"), ("s", "y"), ("s", "x"), ("t", "a"), ("t", "x"), ("t", "z"), ("t", "b")]
    assert K.ranked_entities(mentioned, relations, 2).count() == 4
    edges = spark.createDataFrame([("a", "com:2", "pertenece_a", None), ("x", "com:10", "pertenece_a", None), ("b", "com:2", "pertenece_a", None), ("b", "q", "relacion", None)], EDGE)
    order = K.context_communities(K.ranked_entities(mentioned, relations), edges).filter("section = 's'").orderBy("place").collect()
    assert [r["community"] for r in order] == ["com:10", "com:2"]  # as strings


def test_budget_cuts_at_the_first_block_that_does_not_fit(spark):
    schema = "subject long, place long, role string, citation string, text string"
    streams = {
        "similar": spark.createDataFrame([(1, 2, "similar", "c2", "z" * 3), (1, 1, "similar", "c1", "y" * 20)], schema),
        "closure": spark.createDataFrame([(1, 7, "section", "c7", "b" * 5), (1, 0, "dependency", "c0", "a" * 4), (2, 0, "section", None, "q" * 99)], schema),
    }
    got = K.assemble(streams, 13)
    assert [tuple(r)[:5] for r in got.orderBy("subject", "position").collect()] == [(1, 1, "closure", "dependency", "c0"), (1, 2, "closure", "section", "c7")]
    assert [tuple(r) for r in K.context_text(got).collect()] == [(1, "aaaa\n\nbbbbb", ["c0", "c7"])]
    assert [r["position"] for r in K.assemble(streams, 1000).filter("subject = 1").orderBy("position").collect()] == [1, 2, 3, 4]


def test_community_keys_depend_on_members_alone(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y"), ("a", "y"), ("c", "z")], "node string, community string")
    keys = dict(map(tuple, K.community_key(df).collect()))
    assert keys["x"] == keys["y"] != keys["z"] and len(keys["x"]) == 16


def test_numbers_and_running_sums(spark):
    df = spark.range(5000).selectExpr("id % 3 AS g", "id", "id % 7 AS v")
    n = gapless(df, ["g"], ["id"], "n", 100).collect()
    for g in range(3):
        own = sorted(r["n"] for r in n if r["g"] == g)
        assert own == list(range(len(own)))
    sums = {r["id"]: r["s"] for r in running(df, ["g"], ["id"], "id", "v", "s", 100).collect()}
    assert all(sums[i] == sum(k % 7 for k in range(i % 3, i, 3)) for i in range(0, 5000, 111))
