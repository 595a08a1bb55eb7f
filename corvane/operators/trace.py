"""Run traces: usage, budgets, attempts, repeated scripts, waves and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.config import SETTINGS


def usage(events: DataFrame, by: list[str], tokens_in: Column, tokens_out: Column) -> DataFrame:
    """Calls and summed tokens by the columns ``by``."""
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("calls"), F.sum(tokens_in).alias("tokens_in"), F.sum(tokens_out).alias("tokens_out"))


def running_budget(events: DataFrame, run: str, order: list[str], tokens: Column, budget: float = SETTINGS.token_budget, reserve: float = SETTINGS.token_reserve) -> DataFrame:
    """Adds remaining (after each event) and skipped (what was left before it had reached the reserve)."""
    upto = Window.partitionBy(run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    spent = F.sum(tokens).over(upto)
    return events.withColumn("remaining", F.lit(float(budget)) - spent).withColumn("skipped", F.lit(float(budget)) - (spent - tokens) <= reserve)


def attempts(events: DataFrame, task: list[str], order: list[str], cap: int = SETTINGS.attempts) -> DataFrame:
    """Adds attempt, from 1 in each task, and over_cap."""
    n = F.row_number().over(Window.partitionBy(*task).orderBy(*order))
    return events.withColumn("attempt", n).withColumn("over_cap", n > cap)


def repetitions(scripts: DataFrame, run: str, order: list[str], digest: str, rejected: Column) -> DataFrame:
    """Adds repeated: whether the same digest had been rejected earlier in the run."""
    before = Window.partitionBy(run, digest).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return scripts.withColumn("repeated", F.coalesce(F.max(rejected.cast("int")).over(before), F.lit(0)) == 1)


def latest_status(events: DataFrame, task: list[str], order: list[str], status: str) -> DataFrame:
    """The last status of each task, and how many events it had."""
    return events.groupBy(*task).agg(F.max_by(status, F.struct(*order)).alias("status"), F.count(F.lit(1)).alias("events"))


def span(events: DataFrame, by: str, seconds: Column) -> DataFrame:
    """First kind, last kind and the span in seconds, to 0.1, of each run."""
    return events.groupBy(by).agg(F.round(F.max(seconds) - F.min(seconds), 1).alias("span_s"))


def final_status(done: Column, total: Column) -> Column:
    """failed if nothing is done, complete if all is, else partial."""
    return F.when(done == 0, "failed").when(done == total, "complete").otherwise("partial")


def token_ladder(attempt: Column, first: int = SETTINGS.tokens_first, cap: int = SETTINGS.tokens_cap) -> Column:
    """The token limit of each attempt: doubled every time up to the cap."""
    return F.least(F.lit(first) * F.pow(F.lit(2.0), F.least(attempt, F.lit(20)) - 1), F.lit(float(cap)))
