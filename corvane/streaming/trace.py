"""Streaming twins of the run-trace operators, over append-only folders of event files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvane.config import SETTINGS
from corvane.functions.time import utc_micros
from corvane.sources.scratch import scratch


def event_stream(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """The rows of a table as a stream: files are read as they appear, in the schema that the batch reader sees."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")  # a pattern may name a file or a folder


def run_available(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that is there, with its checkpoint and its results in the shared folder.

    Each micro-batch writes its own folder, named by the batch, so a repeated batch overwrites itself; in complete mode
    the last batch holds the result, in other modes all of them together.
    """
    spark = stream.sparkSession
    base = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/{'all' if mode == 'complete' else f'batch={n}'}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out/all" if mode == "complete" else f"{base}/out/batch=*")


def usage_stream(events: DataFrame) -> DataFrame:
    """Running totals by event type."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.floor("value")).cast("long").alias("tokens"))


def status_stream(events: DataFrame) -> DataFrame:
    """The latest event type of each user."""
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count(F.lit(1)).alias("events"))


def windows_stream(events: DataFrame, late: str = "1 hour", length: str = "1 day") -> DataFrame:
    """Events and their sum in tumbling windows; a window closes once the watermark has passed it."""
    events = events.withColumn("ts", F.timestamp_micros(utc_micros("ts")))
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def budget_stream(events: DataFrame, budget: float = SETTINGS.token_budget, reserve: float = SETTINGS.token_reserve) -> DataFrame:
    """user_id, spent, stopped: the budget rule with its state kept by user across micro-batches."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent = state.get[0] if state.exists else 0.0
        for pdf in batches:
            spent += float(pdf["value"].fillna(0).sum())
        state.update((spent,))
        yield pd.DataFrame({"user_id": [key[0]], "spent": [spent], "stopped": [budget - spent <= reserve]})

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id long, spent double, stopped boolean", "spent double", "update", GroupStateTimeout.NoTimeout)


#: Keys of the state of a stream of scripts.  It is fixed in a stream's checkpoint.
BUCKETS = 4096


def repetition_stream(scripts: DataFrame, late: str = "7 days", forget: str = "7 days") -> DataFrame:
    """run, digest, seq, repeated: the batch rule as a stream, for rows (run, digest, seq, ts timestamp, rejected) that come in order of seq.

    The state is kept by hash bucket of run and digest, so that Python is called once for a bucket and not for each pair, and a run
    of any number of scripts is spread over all tasks.  A bucket remembers the pairs that were rejected and when each was last seen;
    a pair that no script has touched for ``forget`` beyond the watermark is dropped.
    """
    keep_ms = int(pd.Timedelta(forget).total_seconds() * 1000)
    pair = ["run", "digest"]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        known = {(r, d): till for r, d, till in zip(*state.get, strict=True) if till > now} if state.exists else {}
        if not state.hasTimedOut:
            rows = pd.concat(list(batches)).sort_values("seq", kind="stable").reset_index(drop=True)
            rows["rejected"] = rows["rejected"].fillna(False).astype(bool)
            group = rows.groupby(pair, dropna=False, sort=False).ngroup()
            earlier = rows["rejected"].astype("int64").groupby(group).cumsum() - rows["rejected"]
            pairs = [(None if pd.isna(r) else r, None if pd.isna(d) else d) for r, d in zip(rows["run"], rows["digest"], strict=True)]
            before = (earlier > 0) | pd.Series([p in known for p in pairs], dtype=bool)
            last = rows["ts"].groupby(group).transform("max")
            marked = rows["rejected"] | before
            for i in marked.to_numpy().nonzero()[0]:
                seen = last[i]
                known[pairs[i]] = max(now if pd.isna(seen) else int(seen.timestamp() * 1000), now) + keep_ms
            yield pd.DataFrame({"run": [p[0] for p in pairs], "digest": [p[1] for p in pairs], "seq": rows["seq"].to_numpy(), "repeated": before.to_numpy()})
        if known:
            state.update(([k[0] for k in known], [k[1] for k in known], list(known.values())))
            state.setTimeoutTimestamp(max(min(known.values()), now + 1))
        elif state.exists:
            state.remove()

    types = {f.name: f.dataType.simpleString() for f in scripts.schema}
    keyed = scripts.select(F.pmod(F.xxhash64(*pair), F.lit(BUCKETS)).cast("int").alias("bucket"), *[F.col(c).cast("string").alias(c) for c in pair], "seq", "ts", "rejected").withWatermark("ts", late).groupBy("bucket")
    out = keyed.applyInPandasWithState(update, f"run string, digest string, seq {types['seq']}, repeated boolean", "run array<string>, digest array<string>, till array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(*[F.col(c).cast(types[c]).alias(c) for c in pair], "seq", "repeated")
