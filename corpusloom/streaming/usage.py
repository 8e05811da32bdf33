"""Structured Streaming twins of the usage policy and incremental ingestion."""
from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

IST = "INTERVAL '05:30' HOUR TO MINUTE"


def daily_counts(events: DataFrame, late: str = "2 days", offset: str = IST) -> DataFrame:
    """Counts per (identity, feature, local day); events later than `late` behind the newest are dropped."""
    local = events.withColumn("local_ts", F.col("ts") + F.expr(offset)).withWatermark("local_ts", late)
    return local.groupBy(F.window("local_ts", "1 day").alias("day"), "identity", "feature").agg(F.count("*").alias("used"))


def rate_limit_stream(events: DataFrame, key: str, *, limit: int = 20, ttl: int = 60, late: str = "10 minutes") -> DataFrame:
    """Running accept decisions per key, as operators.usage.rate_limit in kv mode: state is the time of the last accepted
    hit and the count; it goes when the watermark is ttl past it. Events of a trigger are taken in order of time and id."""
    span = ttl * 1_000_000

    def decide(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        at, n = state.get if state.exists else (-(1 << 60), 0)
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["t", "event_id"])
        accepted = []
        for t in rows["t"]:
            n = n if t - at < span else 0
            accepted.append(n < limit)
            if accepted[-1]:
                at, n = int(t), n + 1
        state.update((at, n))
        wake = at // 1000 + ttl * 1000
        if wake > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(wake)
        yield pd.DataFrame({key: keys[0], "event_id": rows["event_id"], "accepted": accepted})

    kind = dict(events.dtypes)[key]
    timed = events.withWatermark("ts", late).select(key, "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return timed.groupBy(key).applyInPandasWithState(
        decide, f"{key} {kind}, event_id long, accepted boolean", "at long, n int", "append", GroupStateTimeout.EventTimeTimeout
    )


def ingest_stream(spark: SparkSession, path: str, schema: str, key: str = "chunk_id", late: str = "1 day") -> DataFrame:
    """New JSON files of a folder, each key once within `late`: ids are deterministic, so a replay changes nothing."""
    rows = spark.readStream.schema(schema).json(path).withColumn("_seen", F.current_timestamp())
    return rows.withWatermark("_seen", late).dropDuplicatesWithinWatermark([key]).drop("_seen")


def start_memory(df: DataFrame, name: str, mode: str = "append", **options: Any):
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode)
    for k, v in options.items():
        writer = writer.option(k, v)
    return writer.start()
