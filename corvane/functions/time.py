"""Time as microseconds since 1970, whatever the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_micros(c: str) -> Column:
    """Of a timestamp without time zone, read as UTC."""
    return F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), F.col(c).cast("timestamp_ntz"))
