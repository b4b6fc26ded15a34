"""Structured Streaming forms of the incremental operators. Each works on any streaming DataFrame and a folder for its state."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """A folder of Parquet files as a stream, a bounded number of files for each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def timed(events: DataFrame, ts: str, late: str) -> DataFrame:
    """events with a watermark; times without a zone count as the session's."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def rate_windows(events: DataFrame, ts: str, key: str, width: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Counts in tumbling windows; rows later than the watermark are dropped by the engine."""
    return timed(events, ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"))


def sessions(events: DataFrame, ts: str, key: str, silence: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Stretches without a longer silence; what lies between two of a key is a gap."""
    return timed(events, ts, late).groupBy(F.session_window(ts, silence), key).agg(F.count("*").alias("n"))


def once(events: DataFrame, ts: str, key: list[str], late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark: idempotent appends."""
    return timed(events, ts, late).dropDuplicatesWithinWatermark(key)


def late_flag(events: DataFrame, ts: str, observed: str, slack: str = "10 minutes") -> DataFrame:
    """events with a mark on times that lie in the future of their observation; no row is dropped."""
    return events.withColumn("future_suspect", F.col(ts) > F.col(observed) + F.expr(f"INTERVAL {slack}"))


def drain(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Work off what is there and stop; a restart goes on after the last whole batch."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class KeyedState:
    """A keyed table of Parquet snapshots that batches are merged into; the last writer by seq wins.

    Each batch writes a whole new snapshot and then the name of it, so a reader sees one or the other, and a batch that
    is repeated after a failure gives the same snapshot.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: str):
        self.spark, self.folder, self.key, self.schema = spark, folder.rstrip("/"), key, schema

    def _names(self) -> list[str]:
        try:
            return [r["value"] for r in self.spark.read.text(f"{self.folder}/names/*").collect()]  # one row for each batch
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return []
            raise

    def read(self) -> DataFrame:
        names = self._names()
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/{max(names, key=lambda n: int(n.split('-')[1]))}")

    def merge(self, batch: DataFrame, number: int) -> None:
        from ..operators.sync import apply_changes

        if any(int(n.split("-")[1]) >= number for n in self._names()):
            return
        name = f"batch-{number}-{time.time_ns()}"
        apply_changes(self.read(), batch, self.key).write.parquet(f"{self.folder}/{name}")
        self.spark.createDataFrame([(name,)], "value string").coalesce(1).write.text(f"{self.folder}/names/{name}")
