"""Queries of joins by nearness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.time import utc_micros
from corvane.operators import joins as J
from corvane.sources.tables import table


def tolerance_match(s: SparkSession, d: str) -> DataFrame:
    """Order totals, written to one decimal, that some line price backs."""
    asked = table(s, d, "orders").select("o_orderkey", F.round("o_totalprice", 1).alias("value"), F.lit(1).alias("decimals"))
    return J.supported(asked, table(s, d, "lineitem").select(F.col("l_extendedprice").alias("value"))).select("o_orderkey", "value")


def nearest_earlier(s: SparkSession, d: str) -> DataFrame:
    """For each purchase the last view of the same user before it."""
    e = table(s, d, "events").select("user_id", utc_micros("ts").alias("at"), "event_id", "event_type")
    views = e.filter("event_type = 'view'").groupBy("user_id", "at").agg(F.max("event_id").alias("view_id"))
    return J.nearest_earlier(e.filter("event_type = 'purchase'").select("user_id", "at", "event_id"), views, "user_id", "at", "view_id").select("event_id", "view_id")


def outside_boxes(s: SparkSession, d: str) -> DataFrame:
    """Line items as lines on the page of their order; those of more than 45 pieces are tables."""
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q"))
    y = F.col("n") * 10.0
    lines = li.filter("q <= 45").select("page", "n", "q", F.lit(0.0).alias("x0"), y.alias("y0"), (F.col("q") * 2).alias("x1"), (y + 8).alias("y1"))
    boxes = li.filter("q > 45").select("page", F.lit(30.0).alias("x0"), (y - 12).alias("y0"), F.lit(90.0).alias("x1"), (y + 15).alias("y1"))
    return J.outside_boxes(lines, boxes, ["page"]).groupBy("page").agg(F.count(F.lit(1)).alias("lines"), F.sum("q").alias("q"))


def snapshot_diff(s: SparkSession, d: str) -> DataFrame:
    """Orders as files: a third was written again, a seventh is new."""
    o = table(s, d, "orders").select("o_orderkey", utc_micros("o_orderdate").alias("mtime"))
    before = o.filter("o_orderkey % 7 <> 0")
    after = o.withColumn("mtime", F.when(F.col("o_orderkey") % 3 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")))
    return J.changed(before, after, "o_orderkey", "mtime")


def positional_zip(s: SparkSession, d: str) -> DataFrame:
    w = table(s, d, "part").select("p_partkey", F.split("p_name", " ").alias("a"), F.split(F.concat_ws("#", "p_brand", "p_type"), "[# ]").alias("b"))
    z = J.zipped(w, "p_partkey", "a", "b")
    return z.select("p_partkey", F.col("pos").cast("int").alias("pos"), "a", "b")


QUERIES = {f.__name__: f for f in (tolerance_match, nearest_earlier, outside_boxes, snapshot_diff, positional_zip)}

SQL = {
    "tolerance_match": """WITH q AS (SELECT o_orderkey, round(o_totalprice, 1) AS value FROM orders), m AS (SELECT DISTINCT l_extendedprice AS m FROM lineitem)
      SELECT o_orderkey, value FROM q WHERE EXISTS (SELECT 1 FROM m WHERE m BETWEEN value - (0.05::DOUBLE + 1e-12 * value) AND value + (0.05::DOUBLE + 1e-12 * value) AND abs(m - value) <= 0.05::DOUBLE + 1e-12 * value)""",
    "nearest_earlier": """WITH v AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY 1, 2)
      SELECT p.event_id, (SELECT arg_max(v.view_id, v.ts) FROM v WHERE v.user_id = p.user_id AND v.ts < p.ts) AS view_id FROM events p WHERE p.event_type = 'purchase'""",
    "outside_boxes": """WITH l AS (SELECT l_orderkey AS page, l_linenumber * 10.0::DOUBLE AS y, l_quantity AS q FROM lineitem)
      SELECT page, count(*) AS lines, sum(q) AS q FROM l WHERE q <= 45 AND NOT EXISTS (SELECT 1 FROM l b WHERE b.page = l.page AND b.q > 45 AND 0 < 90 AND 30 < l.q * 2 AND l.y < b.y + 15 AND b.y - 12 < l.y + 8) GROUP BY page""",
    "snapshot_diff": "SELECT o_orderkey, epoch_us(o_orderdate) + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS mtime FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 3 = 0",
    "positional_zip": """WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS a, regexp_split_to_array(p_brand || '#' || p_type, '[# ]') AS b FROM part)
      SELECT p_partkey, CAST(i - 1 AS INTEGER) AS pos, a[i] AS a, b[i] AS b FROM (SELECT *, unnest(range(1, least(len(a), len(b)) + 1)) AS i FROM w)""",
}
