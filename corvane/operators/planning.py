"""Plans of subtasks: validation, waves, replicas, status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.graph import closure
from corvane.operators.numbering import running
from corvane.sources.scratch import saved


def violations(subtasks: DataFrame, sections: DataFrame, deliverables: DataFrame) -> DataFrame:
    """plan, rule, item: what is wrong with each plan, a row for each of eight rules and offending item.

    subtasks (plan, id, section, depends_on array<string>); sections (plan, section, numbered); deliverables (plan, format,
    filename), one row for each plan.
    """
    deps = subtasks.select("plan", "id", F.explode("depends_on").alias("dep"))
    ids = subtasks.select("plan", F.col("id").alias("dep")).distinct()
    real = deps.join(ids, ["plan", "dep"], "left_semi").filter("id <> dep")
    key = lambda c: F.concat_ws("\u0001", F.col("plan").cast("string"), F.col(c))
    back = on_cycles(real.select(key("id").alias("src"), key("dep").alias("dst"))).select(F.col("node").alias("k"))
    looped = subtasks.withColumn("k", key("id")).join(back, "k", "left_semi")
    parts = [
        (deliverables.join(subtasks.select("plan"), "plan", "left_anti"), "empty", F.lit("")),
        (subtasks.groupBy("plan", "id").count().filter("count > 1"), "duplicate_id", F.col("id")),
        (subtasks.join(sections, ["plan", "section"], "left_anti"), "unknown_section", F.col("id")),
        (deps.join(ids, ["plan", "dep"], "left_anti"), "unknown_dependency", F.concat_ws(">", "id", "dep")),
        (deps.filter("id = dep"), "self_dependency", F.col("id")),
        (looped, "cycle", F.col("id")),
        (sections.filter("numbered").join(subtasks, ["plan", "section"], "left_anti"), "uncovered_section", F.col("section")),
        (deliverables.filter(~F.endswith(F.col("filename"), F.concat(F.lit("."), "format"))), "filename", F.col("filename")),
    ]
    return reduce(DataFrame.unionByName, [df.select("plan", F.lit(rule).alias("rule"), item.alias("item")) for df, rule, item in parts]).distinct()


def peeled(edges: DataFrame, rounds: int) -> DataFrame:
    """The edges (src, dst) that stay when nodes without an edge to or from them are taken away, again and again, ``rounds`` times.

    Nodes on cycles and on ways from one cycle to another keep their edges.  A round is two semi-joins.
    """
    left, n = saved(edges.select("src", "dst").filter("src <> dst").distinct(), "peel"), None
    for _ in range(rounds):
        now = left.count()
        if now in (0, n):
            break
        n = now
        entered, left_from = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
        left = saved(left.join(entered, "src", "left_semi").join(left_from, "dst", "left_semi").select("src", "dst"), "peel")
    return left


def on_cycles(edges: DataFrame, rounds: int = 12) -> DataFrame:
    """node: the nodes that reach themselves.

    Peeling takes away what is on no cycle, a node from each end of every path a round; of what stays, which is little unless paths are
    long, the closure says which nodes reach each other, in rounds that grow with the logarithm of the longest path.
    """
    core = peeled(edges, rounds)
    if not core.take(1):
        return core.select(F.col("src").alias("node"))
    reach = closure(core)
    back = reach.alias("a").join(reach.alias("b"), (F.col("a.src") == F.col("b.dst")) & (F.col("a.dst") == F.col("b.src")))
    return back.select(F.col("a.src").alias("node")).distinct()


def waves(tasks: DataFrame, deps: DataFrame, most: int = 1000) -> DataFrame:
    """task, wave: every task whose dependencies all stood in earlier waves joins the next one.

    tasks (task), deps (task, dep).  A round is one anti-join over what is left; tasks on a cycle are in no wave.
    More than ``most`` waves are an error.
    """
    left = saved(tasks.select("task").distinct(), "left")
    open_deps = saved(deps.select("task", "dep").filter("task <> dep").distinct(), "deps")
    found, wave = None, 0
    while True:
        ready = saved(left.join(open_deps, "task", "left_anti").withColumn("wave", F.lit(wave)), "ready")
        if not ready.take(1):
            break
        if wave == most:
            raise RuntimeError(f"tasks are left after {most} waves")
        wave += 1
        found = ready if found is None else found.unionByName(ready)
        left = saved(left.join(ready, "task", "left_anti"), "left")
        open_deps = saved(open_deps.join(ready, open_deps["dep"] == ready["task"], "left_anti"), "deps")
    return found if found is not None else tasks.select("task", F.lit(0).alias("wave")).limit(0)


def replicas(placed: DataFrame, n: int) -> DataFrame:
    """Adds replica: tasks of a wave dealt to ``n`` replicas in turn, by task, an integer.

    Tasks are counted by stretches of their numbers, or of the first bytes of their names, so no task of Spark's holds a wave.
    """
    number, width = F.col("task"), 10_000
    if placed.schema["task"].dataType.simpleString() == "string":
        number, width = F.conv(F.rpad(F.hex(F.substring(F.col("task").cast("binary"), 1, 6)), 12, "0"), 16, 10), 1 << 16
    at = saved(placed.withColumn("_one", F.lit(1)).withColumn("_number", number.cast("long")), "placed")
    counted = running(at, ["wave"], ["_number", "task"], "_number", "_one", "_before", width)
    return counted.withColumn("replica", F.pmod("_before", F.lit(n))).drop("_one", "_number", "_before")


def ready(tasks: DataFrame, deps: DataFrame) -> DataFrame:
    """Pending tasks all of whose dependencies are terminal: approved, done, failed or skipped (a failed one counts)."""
    terminal = tasks.filter(F.col("status").isin("approved", "done", "failed", "skipped")).select(F.col("task").alias("dep"))
    waiting = deps.join(terminal, "dep", "left_anti").select("task")
    return tasks.filter("status = 'pending'").join(waiting, "task", "left_anti")


def first_ready(tasks: DataFrame, deps: DataFrame, plan: str) -> DataFrame:
    """plan, task: of each plan's ready tasks the first in the plan's order.  tasks (plan, task, ord, status), deps (plan, task, dep).

    A task is known by its plan and number, so plans meet no other plan's rows.
    """
    terminal = tasks.filter(F.col("status").isin("approved", "done", "failed", "skipped")).select(plan, F.col("task").alias("dep"))
    waiting = deps.join(terminal, [plan, "dep"], "left_anti").select(plan, "task")
    return tasks.filter("status = 'pending'").join(waiting, [plan, "task"], "left_anti").groupBy(plan).agg(F.min_by("task", "ord").alias("task"))


def branch(tasks: DataFrame, deps: DataFrame, chosen: DataFrame) -> DataFrame:
    """branch, task: each chosen task with its direct dependencies only."""
    own = chosen.select(F.col("task").alias("branch"), "task")
    near = chosen.select(F.col("task").alias("branch")).join(deps, F.col("branch") == F.col("task")).select("branch", F.col("dep").alias("task"))
    return own.unionByName(near).join(tasks, "task", "left_semi")


def reduce_state(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of both by key, the new one where both have it."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))
