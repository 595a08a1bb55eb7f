"""Keyed tables of files: replace by key, deterministic ids, content-addressed caches."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The namespace of chunk ids; any fixed UUID serves.
NAMESPACE = "6f0d8a52-4c0e-5b77-9d53-2f5a1c9e7b10"


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """The version-5 UUID of a name, in the JVM."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def replace_by_key(new: DataFrame, path: str, key: str) -> None:
    """Writes ``new`` partitioned by ``key``, replacing the partitions it holds and no other.

    A key without new rows keeps its old ones, as an emptied source does.
    """
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def delete_key(spark: SparkSession, path: str, key: str, value: str) -> None:
    """Removes one key's partition."""
    if not re.fullmatch(r"[\w.-]+", value):
        raise ValueError(f"not a plain partition value: {value!r}")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{key}={value}")
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def has_key(table: DataFrame, key: str, value: object) -> bool:
    return bool(table.filter(F.col(key) == value).take(1))


def cache_key(*parts: Column, length: int = 24) -> Column:
    """The first characters of the SHA-256 of the parts, a NUL between them."""
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, length)


def missing(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """The rows whose key the cache does not hold, one for each key."""
    return wanted.dropDuplicates([key]).join(cache.select(key), key, "left_anti")


def checked_vectors(df: DataFrame, column: str, size: int) -> DataFrame:
    """df, or an error if the vector column is missing or of another size (one row is looked for)."""
    if column not in df.columns:
        raise ValueError(f"no column {column}")
    if df.filter(F.size(column) != size).take(1):
        raise ValueError(f"{column} does not have {size} numbers in every row")
    return df
