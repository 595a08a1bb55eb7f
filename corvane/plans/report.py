"""Queries of reports, coverage and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import report as R
from corvane.sources.tables import table


def ordered_union(s: SparkSession, d: str) -> DataFrame:
    """Parts in the order in which line items of many pieces first name them, then the small parts never named."""
    asked = table(s, d, "lineitem").filter("l_quantity > 40").select(F.col("l_partkey").alias("item"), F.col("l_orderkey").alias("at"))
    approved = table(s, d, "part").filter("p_size < 20").select(F.col("p_partkey").alias("item"), F.col("p_partkey").alias("at"))
    return R.ordered_union(asked, approved, "item", "at")


def fallback_report(s: SparkSession, d: str) -> DataFrame:
    """Orders as reports of three sections; their line items are the results."""
    o = table(s, d, "orders")
    titles = F.array(F.lit("Intro"), F.when(F.col("o_orderkey") % 2 == 0, "Resultados").otherwise("Metodo"), F.lit("Cierre"))
    sections = o.select("o_orderkey", F.posexplode(titles).alias("ord", "title"))
    li = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("task")).agg(F.max("l_partkey").cast("string").alias("value"))
    out = R.fallback_report(sections, li.select("o_orderkey", "task", F.concat(F.lit("p"), "task").alias("path"), "value"), "o_orderkey")
    return out.select("o_orderkey", F.col("ord").cast("int").alias("ord"), "text")


def fact_coverage(s: SparkSession, d: str) -> DataFrame:
    """For each document: do the second and fifth word of the next one stand in it?"""
    docs = table(s, d, "documents").select("doc_id", "text")
    facts = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.explode(F.array(F.get(F.split("text", " "), 1), F.get(F.split("text", " "), 4))).alias("fact")).filter("fact is not null and fact <> ''")
    return R.fact_coverage(docs, facts.join(docs.select("doc_id"), "doc_id", "left_semi"), "doc_id")


def statement_fragments(s: SparkSession, d: str) -> DataFrame:
    """Statements written from the nations of each region, one part for each."""
    n = table(s, d, "nation").groupBy(F.col("n_regionkey").alias("r")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    text = F.concat(F.lit("Tarea $x$\n"), F.array_join(F.transform("n", lambda x, i: F.concat(F.lit("Parte "), (i + 1).cast("string"), F.lit(" — "), x["n_name"])), "\n"))
    return R.fragments(n.select("r", R.strip_math(text).alias("text")), "r").select(F.col("r").cast("long").alias("r"), F.col("pos").cast("int").alias("pos"), "name", "body")


def routing(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    k = F.col("event_id")
    nxt = R.route(k % 5 - 3, k % 4, k % 3, F.col("value") * 1000, k % 2 == 0, k % 7, k % 11 - 5, k % 13)
    return e.select("event_id", nxt.alias("next"), R.naive_verdict(F.col("user_id") % 3).alias("naive"))


def _cells(s: SparkSession, d: str) -> DataFrame:
    """Cells written from parts: code by its size (an ellipsis, one in a text, a syntax error, or none), and text by its name."""
    k, size, name = F.col("p_partkey"), F.col("p_size"), F.col("p_name")
    code = F.when(size % 4 == 0, F.concat(F.lit("x = "), size.cast("string"))).when(size % 4 == 1, F.lit("def f(x):\n    ...")).when(size % 4 == 2, F.concat(F.lit("s = '... "), size.cast("string"), F.lit("'"))).otherwise(F.lit("def f(:"))
    text = F.when(size % 5 == 0, F.concat(F.lit("**ESCRIBE AQUÍ** "), name)).otherwise(F.concat(F.lit("Titulo\n\n"), F.substring(name, 1, 14), F.lit("  ")))
    return table(s, d, "part").select("p_partkey", (k % 3 > 0).alias("is_code"), F.when(k % 3 > 0, code).otherwise(text).alias("source"))


def cells_complete(s: SparkSession, d: str) -> DataFrame:
    return _cells(s, d).select("p_partkey", R.cell_complete(F.col("source"), F.col("is_code")).alias("complete"))


QUERIES = {f.__name__: f for f in (ordered_union, fallback_report, fact_coverage, statement_fragments, routing, cells_complete)}

SQL = {
    "ordered_union": """WITH a AS (SELECT l_partkey AS item, min(l_orderkey) AS at_ FROM lineitem WHERE l_quantity > 40 GROUP BY 1), p AS (SELECT p_partkey AS item FROM part WHERE p_size < 20)
      SELECT item, CASE WHEN a.item IS NULL THEN 1 ELSE 0 END AS unasked, coalesce(at_, item) AS "at" FROM p LEFT JOIN a USING (item)""",
    "fallback_report": """WITH l AS (SELECT l_orderkey AS k, string_agg('- p' || l_linenumber || ': ' || v, chr(10) ORDER BY l_linenumber) AS lines FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS v FROM lineitem GROUP BY 1, 2) GROUP BY 1),
      s AS (SELECT o_orderkey, i AS ord, (['Intro', CASE WHEN o_orderkey % 2 = 0 THEN 'Resultados' ELSE 'Metodo' END, 'Cierre'])[i + 1] AS title, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 2 END AS home FROM orders, range(0, 3) r(i))
      SELECT o_orderkey, CAST(ord AS INTEGER) AS ord, '## ' || title || CASE WHEN ord = home AND lines IS NOT NULL THEN chr(10) || chr(10) || lines ELSE '' END AS text FROM s LEFT JOIN l ON l.k = o_orderkey""",
    "fact_coverage": r"""WITH f AS (SELECT doc_id - 1 AS doc_id, unnest([string_split(text, ' ')[2], string_split(text, ' ')[5]]) AS fact FROM documents),
      t AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS t FROM documents)
      SELECT doc_id, count(*) AS facts, CAST(sum(CAST(contains(t, trim(regexp_replace(fact, '\s+', ' ', 'g'), ' ')) AS BIGINT)) AS BIGINT) AS covered FROM f JOIN t USING (doc_id) WHERE fact IS NOT NULL AND fact <> '' GROUP BY doc_id""",
    "statement_fragments": """WITH n AS (SELECT n_regionkey AS r, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation)
      SELECT DISTINCT CAST(r AS BIGINT) AS r, 0 AS pos, 'Tarea x' AS name, 'Tarea x' AS body FROM n UNION ALL SELECT CAST(r AS BIGINT), CAST(i AS INTEGER), 'Parte ' || i, 'Parte ' || i || ' — ' || n_name FROM n""",
    "routing": """SELECT event_id, CASE WHEN event_id % 5 > 3 AND event_id % 4 < 3 THEN 'plan_again' WHEN event_id % 5 > 3 THEN 'finish' WHEN event_id % 3 > 0 AND value * 1000 <= 60000 THEN 'skip_pending'
      WHEN event_id % 3 > 0 AND event_id % 2 <> 0 AND event_id % 7 < 3 THEN 'code_again' WHEN event_id % 3 > 0 THEN 'next_task' WHEN event_id % 11 > 5 AND event_id % 13 < 3 THEN 'write_again' ELSE 'finish' END AS next, user_id % 3 = 0 AS naive FROM events""",
    "cells_complete": r"""WITH c AS (SELECT p_partkey, p_partkey % 3 > 0 AS is_code, p_size, CASE WHEN p_size % 5 = 0 THEN '**ESCRIBE AQUÍ** ' || p_name ELSE 'Titulo' || chr(10) || chr(10) || substr(p_name, 1, 14) || '  ' END AS text FROM part)
      SELECT p_partkey, CASE WHEN is_code THEN p_size % 4 IN (0, 2)
        ELSE NOT regexp_matches(text, 'ESCRIBE AQU[IÍ]') AND length(trim(CASE WHEN contains(text, chr(10) || chr(10)) THEN substr(text, position(chr(10) || chr(10) IN text) + 2) ELSE text END)) >= 10 END AS complete FROM c""",
}
