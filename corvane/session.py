"""The Spark session with the settings that the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int | None = None, memory: str = "4g") -> SparkSession:
    """UTC, adaptive execution, dynamic partition overwrite (for replace by key) and last-wins maps (for keyed unions)."""
    b = (
        SparkSession.builder.appName("corvane")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
    )
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()
