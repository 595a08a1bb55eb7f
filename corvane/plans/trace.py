"""Queries of run traces: events stand for the log, a user for a run, an event type for an agent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.text import script_hash
from corvane.functions.time import utc_micros
from corvane.operators import trace as T
from corvane.sources.tables import table
from corvane.streaming import trace as S

#: The agents of the pivot, in the order of the report.
AGENTS = ["view", "click", "error", "purchase", "signup"]
ORDER = ["ts", "event_id"]


def _events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")


def _in() -> Column:
    return F.floor("value").cast("long")


def _out() -> Column:
    return F.get_json_object("props", "$.k").cast("long")


def usage_by_type(s: SparkSession, d: str) -> DataFrame:
    return T.usage(_events(s, d), ["event_type"], _in(), _out())


def usage_by_run(s: SparkSession, d: str) -> DataFrame:
    return T.usage(_events(s, d), ["user_id", "event_type"], _in(), _out())


def run_summary(s: SparkSession, d: str) -> DataFrame:
    e = _events(s, d)
    done = F.sum((F.col("event_type") == "purchase").cast("long"))
    per = e.groupBy("user_id").agg(
        done.alias("passed"), F.count(F.lit(1)).alias("total"), F.sum((F.col("event_type") == "click").cast("long")).alias("attempts"),
        F.max_by("event_type", F.struct(*ORDER)).alias("last_kind"), F.min_by("event_type", F.struct(*ORDER)).alias("first_kind"),
        (F.max(utc_micros("ts")) - F.min(utc_micros("ts"))).alias("span_us"),
    )
    return per.withColumn("status", T.final_status(F.col("passed"), F.col("total")))


def usage_totals(s: SparkSession, d: str) -> DataFrame:
    """Per type and overall in one pass, with each type's share."""
    r = _events(s, d).rollup("event_type").agg(F.count(F.lit(1)).alias("calls"), F.sum(_in()).alias("tokens"))
    return r.select(F.coalesce("event_type", F.lit("all")).alias("event_type"), "calls", "tokens", F.round(100.0 * F.col("calls") / F.max("calls").over(Window.partitionBy(F.lit(1))), 6).alias("percent"))


def usage_pivot(s: SparkSession, d: str) -> DataFrame:
    p = _events(s, d).groupBy("user_id").pivot("event_type", AGENTS).agg(F.count(F.lit(1)))
    return p.select("user_id", *[F.coalesce(a, F.lit(0)).alias(a) for a in AGENTS])


def running_budget(s: SparkSession, d: str) -> DataFrame:
    b = T.running_budget(_events(s, d), "user_id", ORDER, _in(), budget=500, reserve=100)
    return b.select("event_id", F.col("remaining").cast("double").alias("remaining"), "skipped")


def attempt_numbers(s: SparkSession, d: str) -> DataFrame:
    a = T.attempts(_events(s, d), ["user_id", "event_type"], ORDER)
    return a.select("event_id", F.col("attempt").cast("int").alias("attempt"), "over_cap", T.token_ladder(F.col("attempt")).alias("max_tokens"))


def latest_status(s: SparkSession, d: str) -> DataFrame:
    return T.latest_status(_events(s, d), ["user_id"], ORDER, "event_type")


def phase_times(s: SparkSession, d: str) -> DataFrame:
    """From a run's first view to its first purchase, in microseconds; null without either."""
    first = lambda k: F.min(F.when(F.col("event_type") == k, utc_micros("ts")))
    return _events(s, d).groupBy("user_id").agg((first("purchase") - first("view")).alias("phase_us"))


def repetition_detector(s: SparkSession, d: str) -> DataFrame:
    """Documents stand for scripts, their source for a run; every third document was rejected."""
    docs = table(s, d, "documents").select("doc_id", "source", script_hash("text").alias("digest"))
    return T.repetitions(docs, "source", ["doc_id"], "digest", F.col("doc_id") % 3 == 0).select("doc_id", "repeated")


def stream_usage(s: SparkSession, d: str) -> DataFrame:
    return S.run_available(S.usage_stream(S.event_stream(s, d)), "complete")


def stream_status(s: SparkSession, d: str) -> DataFrame:
    return S.run_available(S.status_stream(S.event_stream(s, d)), "complete")


def stream_budget(s: SparkSession, d: str) -> DataFrame:
    """The last state of each user over all micro-batches."""
    out = S.run_available(S.budget_stream(S.event_stream(s, d), 500.0, 100.0), "update")
    return out.groupBy("user_id").agg(F.round(F.max("spent"), 4).alias("spent"), F.max("stopped").alias("stopped"))


def stream_repetitions(s: SparkSession, d: str) -> DataFrame:
    """Events stand for scripts, their user for a run and their properties for the text; purchases were rejected."""
    e = S.event_stream(s, d)
    scripts = e.select(F.col("user_id").alias("run"), F.md5(F.col("props").cast("binary")).alias("digest"), F.col("event_id").alias("seq"), F.timestamp_micros(utc_micros("ts")).alias("ts"), (F.col("event_type") == "purchase").alias("rejected"))
    return S.run_available(S.repetition_stream(scripts), "append")


def stream_windows(s: SparkSession, d: str) -> DataFrame:
    out = S.run_available(S.windows_stream(S.event_stream(s, d)), "complete")
    return out.select(F.date_from_unix_date((F.unix_micros("window.start") / 86_400_000_000).cast("int")).cast("string").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {
    f.__name__: f
    for f in (usage_by_type, usage_by_run, run_summary, usage_totals, usage_pivot, running_budget, attempt_numbers, latest_status, phase_times, repetition_detector, stream_usage, stream_status, stream_budget, stream_windows, stream_repetitions)
}

_K = "CAST(json_extract(props, '$.k') AS BIGINT)"
_V = "CAST(floor(value) AS BIGINT)"
SQL = {
    "usage_by_type": f"SELECT event_type, count(*) AS calls, CAST(sum({_V}) AS BIGINT) AS tokens_in, CAST(sum({_K}) AS BIGINT) AS tokens_out FROM events GROUP BY 1",
    "usage_by_run": f"SELECT user_id, event_type, count(*) AS calls, CAST(sum({_V}) AS BIGINT) AS tokens_in, CAST(sum({_K}) AS BIGINT) AS tokens_out FROM events GROUP BY 1, 2",
    "run_summary": """SELECT user_id, count(*) FILTER (event_type = 'purchase') AS passed, count(*) AS total, count(*) FILTER (event_type = 'click') AS attempts,
      arg_max(event_type, (ts, event_id)) AS last_kind, arg_min(event_type, (ts, event_id)) AS first_kind, epoch_us(max(ts)) - epoch_us(min(ts)) AS span_us,
      CASE WHEN count(*) FILTER (event_type = 'purchase') = 0 THEN 'failed' WHEN count(*) FILTER (event_type = 'purchase') = count(*) THEN 'complete' ELSE 'partial' END AS status
      FROM events GROUP BY user_id""",
    "usage_totals": f"""SELECT coalesce(event_type, 'all') AS event_type, count(*) AS calls, CAST(sum({_V}) AS BIGINT) AS tokens,
      round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM events), 6) AS percent FROM events GROUP BY ROLLUP (event_type)""",
    "usage_pivot": "SELECT user_id, " + ", ".join(f"count(*) FILTER (event_type = '{a}') AS {a}" for a in AGENTS) + " FROM events GROUP BY user_id",
    "running_budget": f"""WITH r AS (SELECT event_id, {_V} AS v, CAST(sum({_V}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM events)
      SELECT event_id, CAST(500 - spent AS DOUBLE) AS remaining, 500 - (spent - v) <= 100 AS skipped FROM r""",
    "attempt_numbers": """WITH r AS (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events)
      SELECT event_id, CAST(n AS INTEGER) AS attempt, n > 3 AS over_cap, CAST(least(16384 * pow(2, least(n, 20) - 1), 40000) AS DOUBLE) AS max_tokens FROM r""",
    "latest_status": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS events FROM events GROUP BY user_id",
    "phase_times": "SELECT user_id, epoch_us(min(ts) FILTER (event_type = 'purchase')) - epoch_us(min(ts) FILTER (event_type = 'view')) AS phase_us FROM events GROUP BY user_id",
    "repetition_detector": r"""WITH h AS (SELECT doc_id, source, array_to_string(list_filter(list_transform(string_split(trim(text, ' '), chr(10)), lambda x: rtrim(x, ' ')), lambda x: trim(x, ' ') <> ''), chr(10)) AS k FROM documents)
      SELECT a.doc_id, EXISTS (SELECT 1 FROM h b WHERE b.source = a.source AND b.k = a.k AND b.doc_id < a.doc_id AND b.doc_id % 3 = 0) AS repeated FROM h a""",
    "stream_usage": f"SELECT event_type, count(*) AS calls, CAST(sum({_V}) AS BIGINT) AS tokens FROM events GROUP BY 1",
    "stream_status": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS events FROM events GROUP BY user_id",
    "stream_budget": "SELECT user_id, round(sum(value), 4) AS spent, 500 - sum(value) <= 100 AS stopped FROM events GROUP BY user_id",
    "stream_repetitions": """SELECT user_id AS run, md5(props) AS digest, event_id AS seq,
      coalesce(bool_or(event_type = 'purchase') OVER (PARTITION BY user_id, md5(props) ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS repeated FROM events""",
    "stream_windows": "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
