"""Ranks over all items, cycles by peeling, dealt replicas, subsamples, grids of boxes, deep documents, failing items, streamed repetition."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import checks, graph, joins, parallel, planning, retrieval, stats, trace
from corvane.streaming import trace as streams


def test_first_rank_is_among_all_items(spark):
    scored = [(1, k, 1.0 - k / 1000) for k in range(200)] + [(2, 5, 0.5), (2, 4, 0.5), (3, 1, 0.1)]
    relevant = [(1, 150), (1, 170), (2, 5), (3, 9)]
    got = retrieval.first_ranks(spark.createDataFrame(scored, "q long, d long, score double"), spark.createDataFrame(relevant, "q long, d long"), "q", "d")
    assert sorted(map(tuple, got.collect())) == [(1, 151), (2, 2), (3, None)]


def test_nodes_on_cycles(spark):
    chain = [(k, k + 1) for k in range(300)]
    rings = [(1000, 1001), (1001, 1002), (1002, 1000), (1002, 1003), (1003, 2000), (2000, 2001), (2001, 2000), (5, 1000), (2001, 7000), (42, 42)]
    got = planning.on_cycles(spark.createDataFrame(chain + rings, "src long, dst long"), rounds=6)
    assert sorted(r[0] for r in got.collect()) == [1000, 1001, 1002, 2000, 2001]
    assert planning.on_cycles(spark.createDataFrame(chain[:20], "src long, dst long"), rounds=30).collect() == []
    assert planning.on_cycles(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_replicas_in_turn(spark):
    placed = spark.range(30_000).selectExpr("id * 7 AS task", "id % 2 AS wave")
    got = planning.replicas(placed, 3).collect()
    for wave in (0, 1):
        own = sorted((r["task"], r["replica"]) for r in got if r["wave"] == wave)
        assert [x for _, x in own] == [k % 3 for k in range(len(own))]


def test_subsamples_floor_the_total(spark):
    df = spark.range(398).selectExpr("id", "IF(id < 148, 'm', 'b') AS label")
    sizes = [stats.subsample(df, "id", "label", s).count() for s in (0.05, 0.1, 0.25, 0.5, 1.0)]
    assert sizes == [19, 39, 99, 199, 398]
    small, large = ({r["id"] for r in stats.subsample(df, "id", "label", s).collect()} for s in (0.1, 0.5))
    assert small < large
    split = stats.stratified(df, "id", "label", 0.7).groupBy("label").agg(F.sum(F.col("train").cast("int"))).collect()
    assert dict(map(tuple, split)) == {"m": 103, "b": 175}


def test_boxes_meet_by_cell(spark):
    rng = random.Random(6)
    rect = lambda most: (x := rng.uniform(-50, 600), y := rng.uniform(-50, 800), x + rng.choice([0, 1, 5, rng.uniform(0, most)]), y + rng.uniform(0, 20))
    lines = [(p, n, *rect(500)) for p in (1, 2) for n in range(150)] + [(3, 0, 0.0, 0.0, 8.0, 8.0), (4, 0, 0.0, 0.0, 5.0, 5.0)]
    boxes = [(p, *rect(300)) for p in (1, 2) for _ in range(40)] + [(3, 8.0, 0.0, 16.0, 8.0), (2, -1000.0, 790.0, 5000.0, 800.0)]
    got = joins.outside_boxes(spark.createDataFrame(lines, "p long, n long, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(boxes, "p long, x0 double, y0 double, x1 double, y1 double"), ["p"])
    meet = lambda a, b: a[0] == b[0] and a[2] < b[3] and b[1] < a[4] and a[3] < b[4] and b[2] < a[5]
    assert sorted((r["p"], r["n"]) for r in got.collect()) == sorted((a[0], a[1]) for a in lines if not any(meet(a, b) for b in boxes))


def test_a_document_forty_levels_deep(spark):
    doc, path = {"leaf": 1, "l": [1, [2, {"x": None}]]}, ""
    for k in range(20):
        doc = {"k": [doc]} if k % 2 else {"m": doc}

    def walk(v, path):
        if isinstance(v, dict):
            return [y for k, x in v.items() for y in walk(x, f"{path}.{k}" if path else k)]
        if isinstance(v, list):
            return [y for k, x in enumerate(v) for y in walk(x, f"{path}[{k}]")]
        return [(path, None if v is None else str(v))]

    got = checks.flatten(spark.createDataFrame([(1, json.dumps(doc)), (2, '{"a": 3}'), (3, "no json"), (4, None)], "id long, doc string"), ["id"], "doc")
    rows = [(r["id"], r["path"], r["value"]) for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, [(1, *x) for x in walk(doc, "")] + [(2, "a", "3")]))


def test_items_fail_for_themselves(spark, tmp_path):
    def work(text):
        if text == "stop":
            raise parallel.Exhausted("budget")
        return {"n": 10 // int(text)}

    df = spark.createDataFrame([(k, t) for k, t in enumerate(["5", "0", "x", None, "2"])], "id long, item string")
    got = {r["id"]: r for r in parallel.finished(parallel.attempted(df, "id", "item", work), f"{tmp_path}/a").collect()}
    assert json.loads(got[0]["result"]) == {"n": 2} and got[0]["error"] is None
    assert got[1]["error"].startswith("ZeroDivisionError") and got[2]["error"].startswith("ValueError") and got[3]["error"].startswith("TypeError")
    late = spark.createDataFrame([(1, "stop"), (2, "5"), (3, "5")], "id long, item string")
    with pytest.raises(parallel.Exhausted, match="1 of 3 items"):
        parallel.finished(parallel.attempted(late, "id", "item", work), f"{tmp_path}/b")
    assert spark.read.parquet(f"{tmp_path}/b").count() == 3  # the others were done


def test_streamed_repetition_equals_the_batch_rule(spark, tmp_path):
    rng, seq, rows = random.Random(7), 0, []
    schema = "run long, digest string, seq long, ts timestamp, rejected boolean"
    out = []

    def keep(batch, n):
        out.extend(tuple(r) for r in batch.collect())

    for step in range(3):  # a new query each time, from the same checkpoint
        new = []
        for _ in range(40):
            seq += 1
            new.append((rng.randrange(3), rng.choice("abcde"), seq, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=seq), rng.random() < 0.4))
        rows += new
        spark.createDataFrame(new, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        q = streams.repetition_stream(stream).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/c").foreachBatch(keep).trigger(availableNow=True).start()
        q.awaitTermination()
    batch = trace.repetitions(spark.createDataFrame(rows, schema), "run", ["seq"], "digest", F.col("rejected"))
    assert sorted(out) == sorted((r["run"], r["digest"], r["seq"], r["repeated"]) for r in batch.collect())


def test_mentions_without_a_name_are_left_out(spark):
    rows = [("NB", "m", "d", "a", 1), ("", "m", "d", "a", 2), ("  ", "m", "d", "a", 3), (None, "m", "d", "a", 4)]
    assert [r["name"] for r in graph.merge_entities(spark.createDataFrame(rows, "name string, type string, description string, source string, seq long")).collect()] == ["NB"]
