"""Shared plumbing of the streaming jobs."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one stream's state, checkpoint and output."""
    return os.path.join(shared_dir(spark), "streams", f"{name}-{uuid.uuid4().hex}")


def table_stream(spark: SparkSession, root: str, name: str, files_per_batch: int | None = None) -> DataFrame:
    """A driver table as a file stream; new files that appear become new batches."""
    schema = spark.read.parquet(os.path.join(root, f"{name}.parquet")).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(root)


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all available data into Parquet and return what it wrote."""
    out = os.path.join(folder, "out")
    query = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("checkpointLocation", os.path.join(folder, "checkpoint")).option("path", out)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def drain_batches(stream: DataFrame, folder: str, handle) -> None:
    """Run ``handle(batch, batch_id)`` over all available data, once per batch."""
    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", os.path.join(folder, "checkpoint")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
