"""Folders of deliverables, notebooks and JSON files, read and written."""

import json
import os

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import checks, planning
from corvane.sources import files


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("run"))
    nb = {
        "cells": [
            {"cell_type": "markdown", "id": "m", "source": ["# T\n", "prose 0.91"]},
            {"cell_type": "code", "id": "c", "source": "x = 7.25", "execution_count": 1, "outputs": [{"output_type": "stream", "text": ["acc 0.88\n", "f1 0.77"]}, {"output_type": "display_data", "data": {"text/plain": "<Figure>", "text/markdown": ["**b**"], "image/png": "iV"}}]},
            {"cell_type": "raw", "id": "r", "source": "raw", "outputs": []},
        ]
    }
    for path, text in {
        "a.md": "# Uno\nuno", "sub/b.txt": "dos", "n.ipynb": json.dumps(nb), "output/c.md": "no", "x/.venv/d.md": "no", "data.json": '{"v": 3.5}',
        "golden.json": json.dumps({"tareas": [{"id": "A", "checks": [{"tipo": "archivo", "patron": "*.png"}, {"tipo": "palabras_max", "valor": 300}]}, {"id": "B", "checks": [{"tipo": "cifra"}]}]}), "bad.json": "{",
    }.items():
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        with open(f"{root}/{path}", "w") as f:
            f.write(text)
    return root


def by_name(df):
    return {r["path"].rsplit("/", 1)[1]: r["text"] for r in df.collect()}


def test_deliverable_texts(spark, folder):
    assert by_name(files.deliverables(spark, folder))["n.ipynb"] == "# T\nprose 0.91"
    assert by_name(files.deliverables(spark, folder, outputs=True))["n.ipynb"] == "# T\nprose 0.91\nacc 0.88\nf1 0.77\n\n\n<Figure>"
    assert by_name(files.deliverables(spark, folder, outputs=True, evaluator=True))["n.ipynb"] == "# T\nprose 0.91\nacc 0.88\nf1 0.77\n<Figure>\n**b**"
    given = by_name(files.input_texts(spark, folder))
    assert given == {"a.md": "# Uno\nuno", "b.txt": "dos", "n.ipynb": "# T\nprose 0.91\nx = 7.25\nraw"}


def test_numbers_of_artifacts_and_notebooks(spark, folder):
    cells = files.notebook_cells(spark, folder)
    got = {r["value"] for r in files.artifact_numbers(files.artifacts(spark, folder).filter(F.endswith("path", F.lit("data.json"))), cells).collect()}
    assert {3.5, 0.88, 0.77} <= got and not {0.91, 7.25} & got
    assert [(r["cell_id"], r["pictures"]) for r in cells.orderBy("pos").collect()] == [("m", 0), ("c", 1), ("r", 0)]


def test_golden_sets(spark, folder):
    docs = files.documents_of(spark, folder)
    assert {r["name"] for r in docs.filter("doc IS NULL").collect()} == {"bad.json"}
    rows = files.golden(docs.filter("name = 'golden.json'")).select("task", "check", "kind", F.try_variant_get("spec", "$.valor", "int").alias("v")).collect()
    assert [tuple(r) for r in rows] == [("A", 0, "archivo", None), ("A", 1, "palabras_max", 300), ("B", 0, "cifra", None)]


def test_main_file_and_archives(spark):
    paths = spark.createDataFrame([(1, "z/informe.md"), (1, "b.md"), (1, "c.md"), (2, "y/q.md"), (2, "a/q.md"), (3, "x.pdf")], "run long, path string")
    assert {tuple(r) for r in files.main_file(paths, "*.md").collect()} == {(1, "b.md"), (2, "a/q.md"), (3, None)} - {(3, None)}
    shown = spark.createDataFrame([(3, 2), (2, 0), (9, 1)], "run long, pictures int")
    assert {tuple(r) for r in checks.archived(paths, r"\.md$", 3, shown).collect()} == {(1, 3, True), (2, 2, False), (3, 0, True), (9, 0, True)}


def test_pending_cells(spark):
    cells = spark.createDataFrame([(1, k, s) for k, s in enumerate(["# A\n\nESCRIBE AQUÍ", "# B\n\nshort", "# C\n\nlong enough text", "# D\n\nx", "# E\n\nx"])], "nb long, pos int, source string")
    rules = spark.createDataFrame([(1, 0, "a", None, ["prosa"]), (1, 1, "b", None, None), (1, 2, "c", None, []), (1, 3, "d", "hash", []), (1, 4, "e", None, ["anexo"])], "nb long, pos int, cell_id string, sha256 string, tags array<string>")
    assert sorted(r["cell_id"] for r in checks.pending_cells(cells, rules, "nb", ["anexo"]).collect()) == ["a", "b"]


def test_sections_filled_forward(spark):
    rows = [(1, 0, None, "before", 1), (1, 1, 1, " One\n two ", 1), (1, 2, None, "a", 1), (1, 3, None, "b", 2), (1, 4, 2, "Three", 3), (2, 0, 1, "Only", 1)]
    got = X.filled_sections(spark.createDataFrame(rows, "doc long, pos long, level int, text string, page int"), "doc").orderBy("doc", "section").collect()
    assert [tuple(r) for r in got] == [(1, 0, "", 0, 1, "before"), (1, 1, "One two", 1, 1, "a\n\nb"), (1, 2, "Three", 2, 3, ""), (2, 1, "Only", 1, 1, "")]


def test_first_ready_task(spark):
    tasks = spark.createDataFrame([(1, "s2", 1, "pending"), (1, "s1", 0, "failed"), (1, "s0", 2, "pending"), (2, "s1", 0, "pending"), (2, "s2", 1, "running")], "plan long, task string, ord long, status string")
    deps = spark.createDataFrame([(1, "s2", "s1"), (2, "s1", "s2")], "plan long, task string, dep string")
    assert [tuple(r) for r in planning.first_ready(tasks, deps, "plan").collect()] == [(1, "s2")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "id long, v string")
    files.append_jsonl(df, f"{tmp_path}/j")
    files.append_jsonl(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2
    files.write_graph(df, df, f"{tmp_path}/g")
    assert spark.read.json(f"{tmp_path}/g/edges").count() == 1
