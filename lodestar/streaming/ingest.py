"""Commit ingestion: classify, promote and store commits as they arrive."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.store import ingest_commits
from .common import drain_batches


class CommitIngest:
    """Appends each batch's decided commits to a log, one folder per batch.

    The prefix counts behind recurring patterns include all earlier batches. A
    repeated batch overwrites its own folder.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _log(self, spark: SparkSession, before: int) -> DataFrame | None:
        root = os.path.join(self.folder, "events")
        paths = [os.path.join(root, str(i)) for i in range(before)]
        return spark.read.parquet(*paths) if paths else None

    def update(self, batch: DataFrame, batch_id: int) -> None:
        decided = ingest_commits(batch, self._log(batch.sparkSession, batch_id))
        decided.write.mode("overwrite").parquet(os.path.join(self.folder, "events", str(batch_id)))
        self.last = batch_id

    def run(self, commits: DataFrame) -> DataFrame:
        self.last = -1
        drain_batches(commits, self.folder, self.update)
        return self._log(self.spark, self.last + 1)


def once_only(events: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Events delivered more than once within the delay pass only once."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
