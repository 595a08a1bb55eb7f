"""Reports assembled from results, ordered unions, fact coverage, routing."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.config import SETTINGS


def ordered_union(asked: DataFrame, approved: DataFrame, item: str, at: str) -> DataFrame:
    """item, place: approved items in the order they were first asked for, then those never asked for, each once."""
    first = asked.groupBy(item).agg(F.min(at).alias("_at")).join(approved.select(item).distinct(), item, "left_semi").withColumn("_rest", F.lit(0))
    rest = approved.groupBy(item).agg(F.min(at).alias("_at")).join(first.select(item), item, "left_anti").withColumn("_rest", F.lit(1))
    both = first.unionByName(rest)
    return both.select(item, F.col("_rest").alias("unasked"), F.col("_at").alias("at"))


def fallback_report(sections: DataFrame, results: DataFrame, report: str) -> DataFrame:
    """report, ord, text: every required heading in order, the results listed under the first that mentions them.

    sections (report, ord, title); results (report, task, path, value).  Without a heading on results the last one takes
    them.
    """
    own = Window.partitionBy(report)
    found = F.lower("title").contains("result")
    s = sections.withColumn("_home", F.coalesce(F.min(F.when(found, F.col("ord"))).over(own), F.max("ord").over(own)))
    lines = results.groupBy(report).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("task", "path", "value"))), lambda r: F.concat(F.lit("- "), r["path"], F.lit(": "), r["value"])), "\n").alias("_lines"))
    out = s.join(lines, report, "left")
    body = F.when((F.col("ord") == F.col("_home")) & F.col("_lines").isNotNull(), F.concat(F.lit("\n\n"), "_lines")).otherwise(F.lit(""))
    return out.select(report, "ord", F.concat(F.lit("## "), "title", body).alias("text"))


def fact_coverage(contexts: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """key, facts, covered: how many of a context's facts (key, fact) stand in its text, white space collapsed."""
    flat = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    both = facts.join(contexts.select(key, flat(F.col("text")).alias("_t")), key, "left")
    return both.groupBy(key).agg(F.count(F.lit(1)).alias("facts"), F.sum(F.coalesce(F.contains("_t", flat(F.col("fact"))), F.lit(False)).cast("long")).alias("covered"))


def fragments(df: DataFrame, key: str, text: str = "text", before: str = r"\n(?=Parte \d+ —|El reporte\n)") -> DataFrame:
    """key, pos, name, body: a statement cut before its parts, each named by its first line up to the dash."""
    parts = df.select(key, F.posexplode(F.split(F.col(text), before)).alias("pos", "body"))
    return parts.select(key, "pos", F.element_at(F.split(F.element_at(F.split("body", "\n"), 1), " —"), 1).alias("name"), "body")


def strip_math(text: Column | str) -> Column:
    return F.regexp_replace(text, r"\$([^$\n]+)\$", "$1")


def route(errors: Column, plan_attempts: Column, pending: Column, remaining: Column, approved: Column, code_attempts: Column, problems: Column, write_attempts: Column) -> Column:
    """What a run does next, from its state: the routing rules as one expression."""
    cap = SETTINGS.attempts
    return (
        F.when((errors > 0) & (plan_attempts < cap), "plan_again")
        .when(errors > 0, "finish")
        .when((pending > 0) & (remaining <= SETTINGS.token_reserve), "skip_pending")
        .when((pending > 0) & ~approved & (code_attempts < cap), "code_again")
        .when(pending > 0, "next_task")
        .when((problems > 0) & (write_attempts < cap), "write_again")
        .otherwise("finish")
    )


def naive_verdict(returncode: Column) -> Column:
    """The verdict of an evaluator that looks at the exit code alone."""
    return returncode == 0


@F.pandas_udf(T.BooleanType())
def _filled(code: pd.Series) -> pd.Series:
    """Whether code compiles and holds no ellipsis as a value."""

    def of(source: str | None) -> bool:
        try:
            return not any(getattr(n, "value", None) is Ellipsis for n in ast.walk(ast.parse(source or "")))
        except (SyntaxError, ValueError):
            return False

    return pd.Series([of(c) for c in code], dtype=bool)


def cell_complete(source: Column, is_code: Column) -> Column:
    """Whether an editable cell has been filled in.

    Code must compile and hold no ellipsis; a text must not hold the marker, and must have ten characters or more after
    its first blank line.
    """
    text = F.coalesce(source, F.lit(""))
    gap = F.locate("\n\n", text)
    rest = F.btrim(F.when(gap > 0, F.substring(text, gap + 2, F.length(text))).otherwise(text), F.lit(" \t\n\r\x0b\x0c"))
    written = ~text.rlike("ESCRIBE AQU[IÍ]") & (F.length(rest) >= 10)
    return F.when(is_code, _filled(F.when(is_code, text))).otherwise(written)
