"""Queries of plans.  An order stands for a plan, its line items for subtasks; parts stand for tasks of one large plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import planning as P
from corvane.sources.tables import table

_STATUS = ["pending", "approved", "done", "failed", "skipped", "running"]


def _deps(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(s, d, "part").filter(k >= 2).select(k.alias("task"), F.floor(k / 2).cast("long").alias("dep"))


def _tasks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.col("p_partkey").alias("task"), F.get(F.array(*map(F.lit, _STATUS)), (F.col("p_size") % 6).cast("int")).alias("status"))


def round_robin_waves(s: SparkSession, d: str) -> DataFrame:
    return P.replicas(P.waves(_tasks(s, d), _deps(s, d)), 2).select("task", F.col("wave").cast("int").alias("wave"), F.col("replica").cast("int").alias("replica"))


def ready_set(s: SparkSession, d: str) -> DataFrame:
    return P.ready(_tasks(s, d), _deps(s, d)).select("task")


def branch_payload(s: SparkSession, d: str) -> DataFrame:
    chosen = _tasks(s, d).filter("status = 'pending'")
    return P.branch(_tasks(s, d), _deps(s, d), chosen)


def keyed_state(s: SparkSession, d: str) -> DataFrame:
    old = _tasks(s, d)
    new = old.filter("task % 4 = 0").withColumn("status", F.lit("done"))
    return P.reduce_state(old, new, "task").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def plan_violations(s: SparkSession, d: str) -> DataFrame:
    li = table(s, d, "lineitem")
    n = F.col("l_linenumber")
    dep = F.concat(F.lit("s"), (F.col("l_suppkey") % 8).cast("string"))
    tasks = li.select(F.col("l_orderkey").alias("plan"), F.concat(F.lit("s"), n.cast("string")).alias("id"), F.concat(F.lit("sec"), (F.col("l_partkey") % 7).cast("string")).alias("section"), F.when(F.col("l_suppkey") % 5 == 0, F.array(dep)).otherwise(F.array().cast("array<string>")).alias("depends_on"))
    orders = table(s, d, "orders")
    sections = orders.select(F.col("o_orderkey").alias("plan"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k")).select("plan", F.concat(F.lit("sec"), "k").alias("section"), (F.col("k") < 2).alias("numbered"))
    made = orders.select(F.col("o_orderkey").alias("plan"), F.when(F.col("o_orderstatus") == "F", "pdf").otherwise("md").alias("format"), F.when(F.col("o_orderkey") % 2 == 0, "informe.md").otherwise("informe.pdf").alias("filename"))
    return P.violations(tasks, sections, made)


def first_ready(s: SparkSession, d: str) -> DataFrame:
    """The first ready line of every order: a line waits for the one before it, or for the first."""
    li = table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("plan"), F.col("l_linenumber").cast("long").alias("task")).agg(F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("q"))
    tasks = li.select("plan", "task", F.col("task").alias("ord"), F.get(F.array(*map(F.lit, _STATUS)), (F.col("p") % 6).cast("int")).alias("status"))
    deps = li.filter("task > 1").select("plan", "task", F.when(F.col("q") % 2 == 0, F.col("task") - 1).otherwise(F.lit(1)).alias("dep"))
    return P.first_ready(tasks, deps, "plan")


QUERIES = {f.__name__: f for f in (round_robin_waves, ready_set, branch_payload, keyed_state, plan_violations, first_ready)}

_T = "t AS (SELECT p_partkey AS task, (['pending', 'approved', 'done', 'failed', 'skipped', 'running'])[p_size % 6 + 1] AS status FROM part)"
SQL = {
    "first_ready": """WITH l AS (SELECT l_orderkey AS plan, l_linenumber AS task, max(l_partkey) AS p, max(l_suppkey) AS q FROM lineitem GROUP BY 1, 2),
      t AS (SELECT plan, task, (['pending', 'approved', 'done', 'failed', 'skipped', 'running'])[p % 6 + 1] AS status, CASE WHEN task > 1 THEN CASE WHEN q % 2 = 0 THEN task - 1 ELSE 1 END END AS dep FROM l)
      SELECT plan, CAST(min(task) AS BIGINT) AS task FROM t WHERE status = 'pending' AND (dep IS NULL OR EXISTS (SELECT 1 FROM t u WHERE u.plan = t.plan AND u.task = t.dep AND u.status IN ('approved', 'done', 'failed', 'skipped'))) GROUP BY plan""",
    "round_robin_waves": """WITH w AS (SELECT p_partkey AS task, CASE WHEN p_partkey < 2 THEN 0 ELSE CAST(floor(log2(p_partkey)) AS INTEGER) END AS wave FROM part)
      SELECT task, wave, CAST((row_number() OVER (PARTITION BY wave ORDER BY task) - 1) % 2 AS INTEGER) AS replica FROM w""",
    "ready_set": f"WITH {_T} SELECT task FROM t WHERE status = 'pending' AND (task < 2 OR EXISTS (SELECT 1 FROM t u WHERE u.task = t.task // 2 AND u.status IN ('approved', 'done', 'failed', 'skipped')))",
    "branch_payload": f"WITH {_T} SELECT task AS branch, task FROM t WHERE status = 'pending' UNION ALL SELECT task, task // 2 FROM t WHERE status = 'pending' AND task >= 2",
    "keyed_state": f"WITH {_T} SELECT CASE WHEN task % 4 = 0 THEN 'done' ELSE status END AS status, count(*) AS n FROM t GROUP BY 1",
    "plan_violations": """WITH RECURSIVE t AS (SELECT l_orderkey AS plan, 's' || l_linenumber AS id, 'sec' || (l_partkey % 7) AS section, CASE WHEN l_suppkey % 5 = 0 THEN 's' || (l_suppkey % 8) END AS dep FROM lineitem),
      real AS (SELECT DISTINCT plan, id, dep FROM t WHERE dep IS NOT NULL AND dep <> id AND EXISTS (SELECT 1 FROM t u WHERE u.plan = t.plan AND u.id = t.dep)),
      reach(plan, a, b) AS (SELECT plan, id, dep FROM real UNION SELECT reach.plan, a, real.dep FROM reach JOIN real ON real.plan = reach.plan AND real.id = reach.b),
      sec AS (SELECT o_orderkey AS plan, 'sec' || k AS section, k < 2 AS numbered FROM orders, range(0, 6) r(k)),
      made AS (SELECT o_orderkey AS plan, CASE WHEN o_orderstatus = 'F' THEN 'pdf' ELSE 'md' END AS format, CASE WHEN o_orderkey % 2 = 0 THEN 'informe.md' ELSE 'informe.pdf' END AS filename FROM orders)
      SELECT plan, 'empty' AS rule, '' AS item FROM made WHERE plan NOT IN (SELECT plan FROM t)
      UNION SELECT plan, 'duplicate_id', id FROM t GROUP BY plan, id HAVING count(*) > 1
      UNION SELECT plan, 'unknown_section', id FROM t WHERE section = 'sec6' OR plan NOT IN (SELECT plan FROM made)
      UNION SELECT plan, 'unknown_dependency', id || '>' || dep FROM t WHERE dep IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t u WHERE u.plan = t.plan AND u.id = t.dep)
      UNION SELECT plan, 'self_dependency', id FROM t WHERE dep = id
      UNION SELECT plan, 'cycle', a FROM reach WHERE a = b
      UNION SELECT plan, 'uncovered_section', section FROM sec WHERE numbered AND NOT EXISTS (SELECT 1 FROM t WHERE t.plan = sec.plan AND t.section = sec.section)
      UNION SELECT plan, 'filename', filename FROM made WHERE NOT ends_with(filename, '.' || format)""",
}
