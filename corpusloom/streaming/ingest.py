"""Incremental ingestion into a folder of Parquet batches, exactly once however often a batch is tried.

Spark gives a micro-batch the same id and rows when it runs it again after a crash. So each batch is a folder of its id,
written over: a retry replaces what the failed try left. Rows of a key that come again are kept as its newest version;
`current` reads the newest of each key, and `compact` writes that as one batch.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

BATCH = "batch"


def _write(rows: DataFrame, path: str, batch: int) -> None:
    rows.write.option("compression", "zstd").mode("overwrite").parquet(f"{path}/{BATCH}={batch}")


def merge_batch(rows: DataFrame, batch: int, path: str, key: str) -> None:
    """One micro-batch: of rows that share a key, one (all columns decide which, so a retry keeps the same)."""
    others = sorted(c for c in rows.columns if c != key)
    one = rows.groupBy(key).agg(F.max(F.struct(*others)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in others])
    _write(one.select(*rows.columns), path, batch)


def ingest(stream: DataFrame, path: str, checkpoint: str, *, key: str = "chunk_id", once: bool = True) -> StreamingQuery:
    """Start to merge a stream into `path`; with `once` it takes what is there now and ends."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, batch: merge_batch(rows, batch, path, key))
    return (writer.trigger(availableNow=True) if once else writer).start()


def current(spark: SparkSession, path: str, key: str = "chunk_id") -> DataFrame:
    """The newest row of each key."""
    rows = spark.read.option("basePath", path).parquet(f"{path}/{BATCH}=*")
    others = [c for c in rows.columns if c not in (key, BATCH)]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*others), BATCH).alias("_r"))
    return newest.select(key, *[F.col(f"_r.{c}").alias(c) for c in others])


def compact(spark: SparkSession, path: str, to: str, key: str = "chunk_id") -> None:
    """What is current, as the one batch (of the highest id) of another folder, which later batches may go on from."""
    last = spark.read.option("basePath", path).parquet(f"{path}/{BATCH}=*").agg(F.max(BATCH)).first()[0]
    _write(current(spark, path, key), to, last)
