"""Numbers and running sums within groups that no task has to hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gapless(df: DataFrame, group: list[str], order: list[str], out: str, rows_per_task: int = 50_000) -> DataFrame:
    """Adds ``out``: a number from 0 without gaps within each group, in no given order.

    A group is cut into hash chunks of its order columns; rows are numbered within a chunk, and a chunk starts where the
    counts of the chunks before it end.  Only the counts, one row for each group and chunk, are brought together.
    ``df`` is read three times, so it should be a written table.  Rows equal in every order column stay in one chunk.
    """
    chunks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // rows_per_task + 1)
    at = df.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)))
    keys = [*group, "_chunk"]
    counts = at.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = at.withColumn("_row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    return numbered.join(starts, keys).withColumn(out, (F.col("_start") + F.col("_row")).cast("long")).drop("_chunk", "_row", "_start")


def running(df: DataFrame, group: list[str], order: list[str], step: str, value: str, out: str, width: int = 1000) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before, by ``order``, within each group.

    ``step`` is the last column of ``order``, an integer; its stretches of ``width`` are summed first, so that a task holds one
    stretch of a group and the sums of the stretches.  ``df`` is read twice.
    """
    lead = order[: order.index(step)]
    at = df.withColumn("_stretch", F.floor(F.col(step) / width))
    keys = [*group, *lead, "_stretch"]
    sums = at.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*group).orderBy(*lead, "_stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = at.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(starts, keys).withColumn(out, F.col("_start") + F.col("_inside")).drop("_stretch", "_start", "_inside")
