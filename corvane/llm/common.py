"""Small helpers that the operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.sources.scratch import saved, scratch
from corvane.sources.tables import table

__all__ = ["WHITE", "bounded_batches", "fresh", "gapless", "partitions", "saved", "scratch", "sha256_text", "table"]

#: The white space of every contract here: space and \x09 to \x0D.
WHITE = " \t\n\x0b\x0c\r"
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are bounded in bytes as well as rows, so that very long texts do not pile up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, whatever its columns are called."""
    mark = "__"
    while any(c.lower().startswith(mark) for c in df.columns):
        mark += "_"
    return [mark + n for n in names]


def gapless(df: DataFrame, group: list[str], order: list[str], out: str, rows_per_task: int = 50_000) -> DataFrame:
    """Adds ``out``: a number from 0 without gaps within each group, with no group ever held by one task.

    A group is cut into hash chunks of its order columns; rows are numbered within a chunk, and a chunk starts where the
    counts of the chunks before it end.  Only the counts, one row for each group and chunk, are brought together.
    ``df`` is read three times, so it should be a written table.  Rows equal in every order column stay in one chunk.
    """
    chunks = max(partitions(df.sparkSession), df.count() // rows_per_task + 1)
    at = df.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)))
    keys = [*group, "_chunk"]
    counts = at.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = at.withColumn("_row", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    return numbered.join(starts, keys).withColumn(out, (F.col("_start") + F.col("_row")).cast("long")).drop("_chunk", "_row", "_start")


def sha256_text(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)
