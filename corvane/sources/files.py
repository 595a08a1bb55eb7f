"""Files as tables: traces, notebooks, artifacts, Markdown and text, graphs; and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.config import SETTINGS
from corvane.functions.numbers import UNSIGNED, mentions
from corvane.functions.text import markdown_row
from corvane.operators.checks import NOT_ARTIFACTS

NOTEBOOK = "cells array<struct<cell_type:string, id:string, source:variant, execution_count:int, outputs:array<struct<output_type:string, text:variant, data:variant>>>>"
EVENT = "ts double, kind string, node string, agent string, model string, subtask string, attempt bigint, tokens_in bigint, tokens_out bigint, max_tokens bigint, replica bigint, latency_s double, duration_s double, returncode int, timed_out boolean, error string"


def trace(spark: SparkSession, path: str) -> DataFrame:
    """Events of JSON lines under a superset schema; the whole line stays as a variant in ``payload``."""
    lines = spark.read.text(path, pathGlobFilter="*.jsonl", recursiveFileLookup=True).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", EVENT).alias("e"), F.try_parse_json("value").alias("payload"), F.col("_metadata.file_path").alias("file")).select("e.*", "payload", "file")


def trace_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENT).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").json(path)


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """path, stem, text of every Markdown or text file."""
    df = spark.read.text(path, wholetext=True, pathGlobFilter="*.{md,txt}").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))
    return df.select("path", F.regexp_replace("name", r"\.\w+$", "").alias("stem"), "text")


def texts(spark: SparkSession, path: str, suffixes: str = "md,txt,py,json,csv") -> DataFrame:
    """path, text of the readable files below a folder, but for environments, outputs and caches."""
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=f"*.{{{suffixes}}}")
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).filter(~F.col("path").rlike(r"/(\.venv|output|__pycache__)/"))


def _joined(v: Column) -> Column:
    """A text that a notebook stores as a string or as a list of lines."""
    lines = F.try_variant_get(v, "$", "array<string>")
    return F.coalesce(F.when(lines.isNotNull(), F.array_join(lines, "")), F.try_variant_get(v, "$", "string"), F.lit(""))


def cells_of(raw: DataFrame) -> DataFrame:
    """path, pos, cell_type, cell_id, source, execution_count, outputs, output, errors, pictures of every cell of the notebooks ``raw`` (path, text).

    outputs holds the parts of each output that are text, in the order text, text/plain, text/markdown; output joins the first two of each.
    """
    c = raw.select("path", F.from_json("text", NOTEBOOK).alias("nb")).select("path", F.posexplode("nb.cells").alias("pos", "c"))
    made = F.coalesce("c.outputs", F.array())
    data = lambda o, kind: _joined(F.try_variant_get(o["data"], f"$['{kind}']", "variant"))
    outputs = F.transform(made, lambda o: F.struct(_joined(o["text"]).alias("text"), data(o, "text/plain").alias("plain"), data(o, "text/markdown").alias("markdown")))
    errors = F.size(F.filter(made, lambda o: o["output_type"] == "error"))
    pictures = F.size(F.filter(made, lambda o: F.try_variant_get(o["data"], "$['image/png']", "variant").isNotNull()))
    joined = F.array_join(F.transform(outputs, lambda o: F.concat(o["text"], o["plain"])), "\n")
    return c.select("path", "pos", "c.cell_type", F.col("c.id").alias("cell_id"), _joined(F.col("c.source")).alias("source"), "c.execution_count", outputs.alias("outputs"), joined.alias("output"), errors.alias("errors"), pictures.alias("pictures"))


def notebooks(spark: SparkSession, path: str) -> DataFrame:
    """path, text of the notebooks below a folder."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.ipynb").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def notebook_cells(spark: SparkSession, path: str) -> DataFrame:
    """The cells of the notebooks below a folder, as of :func:`cells_of`."""
    return cells_of(notebooks(spark, path))


def notebook_text(cells: DataFrame, outputs: bool = False, evaluator: bool = False) -> DataFrame:
    """path, text: the Markdown cells of each notebook, a line each, with the text of what the others put out if asked.

    The evaluator takes only what code cells put out, Markdown among it, and only parts that are there; the solver takes two parts of
    each output, empty ones too.
    """
    o = F.transform("outputs", lambda x: F.filter(F.array(x["text"], x["plain"], x["markdown"]), lambda t: t != "") if evaluator else F.array(x["text"], x["plain"]))
    others = F.flatten(o) if outputs else F.array().cast("array<string>")
    if evaluator:
        others = F.when(F.col("cell_type") == "code", others).otherwise(F.array().cast("array<string>"))
    parts = F.when(F.col("cell_type") == "markdown", F.array("source")).otherwise(others)
    own = cells.select("path", "pos", parts.alias("parts")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", "parts"))).alias("p"))  # one notebook's cells
    return own.select("path", F.array_join(F.flatten(F.transform("p", lambda x: x["parts"])), "\n").alias("text"))


def deliverables(spark: SparkSession, path: str, outputs: bool = False, evaluator: bool = False) -> DataFrame:
    """path, name, text of the Markdown and text files and notebooks below a folder; a notebook's text is that of :func:`notebook_text`."""
    plain = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{md,txt}").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return plain.unionByName(notebook_text(notebook_cells(spark, path), outputs, evaluator)).withColumn("name", F.element_at(F.split("path", "/"), -1))


def input_texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of what a solver was given: Markdown, text, and the sources of all cells of notebooks, but for environments, outputs and caches."""
    sources = notebook_cells(spark, path).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("pos", "source"))).alias("p")).select("path", F.array_join(F.transform("p", lambda x: x["source"]), "\n").alias("text"))
    plain = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{md,txt}").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    root = F.lit(path.rstrip("/") + "/")
    below = F.when(F.instr("path", root) > 0, F.substring("path", F.instr("path", root) + F.length(root), F.length("path"))).otherwise(F.col("path"))
    return plain.unionByName(sources).filter(~below.rlike(r"(^|/)(\.venv|output|__pycache__)/"))


def main_file(files: DataFrame, name: str) -> DataFrame:
    """run, path: the deliverable of each run (run, path below its folder): the first of that name pattern at the top, else the first anywhere.

    ``name`` is a pattern of file names in which * stands for anything.
    """
    pattern = "^" + name.replace(".", r"\.").replace("*", "[^/]*") + "$"
    hit = files.filter(F.element_at(F.split("path", "/"), -1).rlike(pattern))
    return hit.groupBy("run").agg(F.coalesce(F.min(F.when(~F.contains("path", F.lit("/")), F.col("path"))), F.min("path")).alias("path"))


def documents_of(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """path, name, doc (variant) of the JSON files below a folder: golden sets, plans, contracts, caches; doc is null where a file is no JSON."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), F.try_parse_json("value").alias("doc"))


def golden(docs: DataFrame) -> DataFrame:
    """task, check, kind, spec (variant) of the golden sets ``docs`` (doc): a row for each check of each task, in order."""
    tasks = docs.select(F.posexplode(F.try_variant_get("doc", "$.tareas", "array<variant>")).alias("n", "t"))
    checks = tasks.select(F.try_variant_get("t", "$.id", "string").alias("task"), F.posexplode(F.try_variant_get("t", "$.checks", "array<variant>")).alias("check", "spec"))
    return checks.select("task", "check", F.try_variant_get("spec", "$.tipo", "string").alias("kind"), "spec")


def notebooks_run(cells: DataFrame) -> DataFrame:
    """path, cells, cells_run, cell_errors over code cells."""
    code = F.col("cell_type") == "code"
    return cells.groupBy("path").agg(F.sum(code.cast("long")).alias("cells"), F.sum((code & F.col("execution_count").isNotNull()).cast("long")).alias("cells_run"), F.sum(F.when(code, F.col("errors")).otherwise(0)).alias("cell_errors"))


def artifacts(spark: SparkSession, path: str, exclude: DataFrame | None = None, skip: str = NOT_ARTIFACTS) -> DataFrame:
    """path, text of what executions wrote: json, csv, txt, log and out files of at most 5 MB."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{json,csv,txt,log,out}").load(path)
    root = F.lit(path.rstrip("/") + "/")
    rel = F.when(F.instr(F.col("path"), root) > 0, F.substring("path", F.instr(F.col("path"), root) + F.length(root), F.lit(1 << 20))).otherwise(F.col("path"))
    files = files.filter((F.col("length") <= SETTINGS.artifact_max_bytes) & ~rel.rlike(skip))
    if exclude is not None:
        files = files.join(exclude.select("path"), "path", "left_anti")
    return files.select("path", F.decode("content", "UTF-8").alias("text"))


def artifact_numbers(texts_: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """The distinct values that stand in the texts, and in what the cells of notebooks put out."""
    own = texts_.select("text")
    if cells is not None:
        own = own.unionByName(cells.select(F.explode("outputs").alias("o")).select(F.concat("o.text", "o.plain").alias("text")))
    return own.select(F.explode(mentions("text", UNSIGNED)).alias("m")).select(F.col("m.value").alias("value")).filter("value is not null").distinct()


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges of a node-link JSON document, attributes as variants."""
    doc = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("g"))
    nodes = doc.select(F.explode(F.try_variant_get("g", "$.nodes", "array<variant>")).alias("n")).select(F.try_variant_get("n", "$.id", "string").alias("id"), F.try_variant_get("n", "$.kind", "string").alias("kind"), F.col("n").alias("attributes"))
    links = F.coalesce(F.try_variant_get("g", "$.edges", "array<variant>"), F.try_variant_get("g", "$.links", "array<variant>"))
    edges = doc.select(F.explode(links).alias("e")).select(F.try_variant_get("e", "$.source", "string").alias("src"), F.try_variant_get("e", "$.target", "string").alias("dst"), F.try_variant_get("e", "$.kind", "string").alias("kind"), F.col("e").alias("attributes"))
    return nodes, edges


def csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, every column a string."""
    return spark.read.csv(path, header=True, inferSchema=False)


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").csv(path, header=True)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Adds the rows to a folder of JSON lines."""
    df.write.mode("append").json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """nodes and edges as folders of JSON lines, below ``path``."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def markdown_table(df: DataFrame, columns: list[str], order: str) -> DataFrame:
    """line, text: a Markdown table, one row for each line; the header and its rule come first."""
    spark = df.sparkSession
    head = spark.createDataFrame([(-2, "| " + " | ".join(columns) + " |"), (-1, "|" + "---|" * len(columns))], "line long, text string")
    return head.unionByName(df.select(F.col(order).cast("long").alias("line"), markdown_row([F.col(c) for c in columns]).alias("text")))
