"""The stream of scripts keeps its state by bucket, not by pair, and stays equal to the batch rule."""

import datetime as dt
import random

from pyspark.sql import functions as F

from corvane.operators import trace
from corvane.streaming import trace as streams


def test_state_is_kept_by_bucket(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "BUCKETS", 8)
    rng, schema, out, states, rows = random.Random(9), "run long, digest string, seq long, ts timestamp, rejected boolean", [], [], []
    for step in range(2):
        new = [(rng.choice([None, 1, 2**60 + 1, 2**60 + 2]), rng.choice([None, "", *"abcdefghijklmnop"]), step * 300 + k, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k), rng.choice([None, False, False, True])) for k in range(300)]
        rows += new
        spark.createDataFrame(new, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        q = streams.repetition_stream(stream).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/c").foreachBatch(lambda b, n: out.extend(map(tuple, b.collect()))).trigger(availableNow=True).start()
        q.awaitTermination()
        states += [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]
    batch = trace.repetitions(spark.createDataFrame(rows, schema), "run", ["seq"], "digest", F.coalesce("rejected", F.lit(False)))
    assert sorted(map(repr, out)) == sorted(repr((r["run"], r["digest"], r["seq"], r["repeated"])) for r in batch.collect())
    assert 0 < max(states) <= 8
