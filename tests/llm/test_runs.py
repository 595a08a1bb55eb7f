"""Runs of line keys that outlive a call, and plans that do not move them."""

import pytest

pytest.importorskip("corvane.llm")

from corvane.llm import linededup  # noqa: E402


def batch(spark, first, keys):
    return spark.createDataFrame([(first + i, k, 0) for i, k in enumerate(keys)], "doc_id long, k1 long, k2 long")


def test_a_later_call_goes_on_with_the_runs_of_an_earlier_one(spark, tmp_path):
    folder = str(tmp_path / "runs")
    runs = linededup.Runs(fan=3, folder=folder)
    runs.add(batch(spark, 0, [1, 1, 2]))
    runs.add(batch(spark, 10, [2, 3]))
    runs.closed()
    later = linededup.Runs.opened(spark, folder, fan=3)
    assert [len(x) for x in later.levels] == [2] and len(later.increments) == 1
    later.add(batch(spark, 20, [1, 3, 4, 5]))
    assert [len(x) for x in later.levels] == [0, 1]
    assert {(r["k1"], r["n"], r["last"]) for r in later.merged().collect()} == {(1, 3, 20), (2, 2, 10), (3, 2, 21), (4, 1, 22), (5, 1, 23)}
    later.closed()


def test_every_key_stands_in_one_run(spark):
    runs = linededup.Runs(fan=10)
    for b in range(4):
        runs.add(batch(spark, 100 * b, [b, b + 1, 50, 50]))
    held = [{r["k1"] for r in run.collect()} for run in runs.runs()]
    assert held == [{0, 1, 50}, {2}, {3}, {4}]
    runs.closed()


def test_a_batch_meets_the_runs_without_moving_them(spark):
    runs = linededup.Runs(fan=10)
    runs.add(batch(spark, 0, list(range(100))))
    runs.add(batch(spark, 200, list(range(50, 150))))
    own = runs._written(batch(spark, 300, list(range(200))).selectExpr("k1", "k2", "1L as n", "doc_id as last"), "batch")
    plan = runs.unseen(own)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2
    assert runs.unseen(own).count() == 50
    runs.closed()


def test_helper_names_do_not_clash(spark):
    line = "a line that is long enough to be dropped, in many documents"
    rows = [(k, f"{line}\nown {k}", "x", "x", "x", "x", "x", "x") for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id string, __x string, __y string, __split string, __of string, ___of string")
    got = linededup.dedup(df)
    assert got.columns == [*df.columns, "n_lines", "n_dropped"]
    assert {r["doc_id"]: r["n_dropped"] for r in got.collect()} == {k: int(k < 5) for k in range(6)}
    assert all(r[c] == "x" for r in got.collect() for c in df.columns[2:])
