"""Work on many items side by side, of which each may fail for itself."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


class Exhausted(RuntimeError):
    """What must stop a run, once all items are done."""


def attempted(df: DataFrame, key: str, item: str, work: Callable[[str | None], object]) -> DataFrame:
    """key, result (JSON), error, fatal: what ``work`` makes of each item, or the kind and words of what it raised.

    An item that fails stops no other; fatal is true for Exhausted.  Items come in Arrow batches.
    """
    schema = df.select(key).schema.add("result", "string").add("error", "string").add("fatal", "boolean")

    def one(value: str | None) -> tuple[str | None, str | None, bool]:
        try:
            return json.dumps(work(value), ensure_ascii=False), None, False
        except Exception as e:  # noqa: BLE001 - any failure is the item's own
            return None, f"{type(e).__name__}: {e}", isinstance(e, Exhausted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [one(v) for v in b.column(1).to_pylist()]
            out = [pa.array([g[k] for g in got], t) for k, t in enumerate((pa.string(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([b.column(0), *out], [key, "result", "error", "fatal"])

    return df.select(key, item).mapInArrow(run, schema)


def finished(results: DataFrame, path: str) -> DataFrame:
    """The results, written to ``path``; if any was fatal, raises Exhausted after all items are done and written."""
    seen = Observation()
    watched = results.observe(seen, F.count(F.lit(1)).alias("items"), F.count(F.when(F.col("fatal"), 1)).alias("fatal"), F.min(F.when(F.col("fatal"), F.col("error"))).alias("first"))
    watched.write.mode("overwrite").parquet(path)
    if seen.get["fatal"]:
        raise Exhausted(f"{seen.get['fatal']} of {seen.get['items']} items: {seen.get['first']}")
    return results.sparkSession.read.schema(results.schema).parquet(path)
