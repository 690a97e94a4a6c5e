"""Call metrics over a stream: lifetime counters and the newest 500 calls per tool."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.observability import WINDOW_CALLS, window_calls
from .common import drain_batches

NEWEST = ("ts", "seq")


class RollingCalls:
    """Keeps (tool, seq, ts, duration, size) of the newest calls and counters per tool.

    Each batch shrinks to its newest calls per tool before it meets the state,
    so a tool with most of the traffic costs no more than any other. A batch
    writes the state under its own number: running it again gives the same files.
    """

    def __init__(self, spark: SparkSession, folder: str, size: int = WINDOW_CALLS):
        self.spark, self.folder, self.size = spark, folder, size

    def _path(self, part: str, batch_id: int) -> str:
        return os.path.join(self.folder, part, str(batch_id))

    def update(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        columns = ["tool", "seq", "ts", "duration_ms", "output_size"]
        rows = batch.select(*columns)
        counts = batch.groupBy("tool").agg(
            F.count(F.lit(1)).alias("count"), F.count_if(F.col("error").isNotNull()).alias("errors")
        )
        if batch_id > 0:
            rows = rows.unionByName(spark.read.parquet(self._path("window", batch_id - 1)))
            counts = counts.unionByName(spark.read.parquet(self._path("counts", batch_id - 1)))
            counts = counts.groupBy("tool").agg(F.sum("count").alias("count"), F.sum("errors").alias("errors"))
        window_calls(rows, [F.desc(c) for c in NEWEST], self.size).write.mode("overwrite").parquet(self._path("window", batch_id))
        counts.write.mode("overwrite").parquet(self._path("counts", batch_id))
        self.last = batch_id

    def run(self, calls: DataFrame) -> DataFrame:
        """Drain the stream; (tool, count, errors, n, mean_ms) at its end."""
        self.last = -1
        drain_batches(calls, self.folder, self.update)
        window = self.spark.read.parquet(self._path("window", self.last))
        counts = self.spark.read.parquet(self._path("counts", self.last))
        means = window.groupBy("tool").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("duration_ms"), 6).alias("mean_ms"))
        return counts.join(means, "tool")
