"""Structured Streaming jobs whose results equal their batch twins over the same input."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyrook.operators.metrics import run_outcome
from tallyrook.session import work_folder


def deduplicated(events: DataFrame, key: str, time: str, overlap: str = "1 hour") -> DataFrame:
    """Re-deliveries of a key within the overlap count once; later ones than the watermark are dropped."""
    return events.withWatermark(time, overlap).dropDuplicatesWithinWatermark([key])


def first_last_seen(events: DataFrame, keys: list[str], time: str) -> DataFrame:
    return events.groupBy(*keys).agg(F.min(time).alias("first_seen_at"), F.max(time).alias("last_seen_at"))


def daily(events: DataFrame, time: str, kind: str, late: str = "2 days") -> DataFrame:
    """Events of each kind a day; months are summed from days in batch, since windows have no month."""
    return events.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), kind, "n")


def late_rows(batch: DataFrame, time: str, horizon) -> DataFrame:
    """Rows of a batch that are older than what earlier batches have closed."""
    return batch.where(F.col(time) < horizon)


def run_available(stream: DataFrame, name: str, sink: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None) -> None:
    """Runs a stream over what has landed and stops. sink(batch, batch_id) writes results, then state: a batch that is
    run again after a failure overwrites its own folder, and state is never ahead of results. With a checkpoint of its
    own, the next call goes on where this one stopped."""
    spark = stream.sparkSession
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint or f"{work_folder(spark)}/stream-{name}-{uuid.uuid4().hex}").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def collected(stream: DataFrame, name: str, mode: str = "append", per_batch: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The rows that a stream, or per_batch of its batches, gives over what has landed: a table with one folder a batch."""
    spark: SparkSession = stream.sparkSession
    path = f"{work_folder(spark)}/stream-out-{name}-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, batch_id: int) -> None:
        (per_batch(batch) if per_batch else batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    run_available(stream, name, sink, mode)
    return spark.read.option("basePath", path).parquet(path).drop("batch")


def batch_outcome(batch: DataFrame) -> DataFrame:
    """Run metrics of a micro-batch of (source_id, status)."""
    return run_outcome(batch.groupBy("source_id").agg(F.max_by("status", "ordinal").alias("status")))


def advance_watermarks(marks: DataFrame, batch: DataFrame) -> DataFrame:
    """marks (key, at), batch (key, ts, complete) -> marks moved to a key's latest time where all of its batch is complete."""
    new = batch.groupBy("key").agg(F.max("ts").alias("new"), F.bool_and("complete").alias("whole"))
    return marks.join(new, "key", "full").select("key", F.when(F.col("whole"), F.greatest("at", "new")).otherwise(F.col("at")).alias("at"))
