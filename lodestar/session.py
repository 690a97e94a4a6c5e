"""Session defaults, table reading and durable intermediate tables."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHECKPOINT_KEY = "spark.checkpoint.dir"


def get_spark(app_name: str = "lodestar", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators assume (UTC, AQE, skew joins)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only in local mode."""
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors share")
    path = tempfile.mkdtemp(prefix="lodestar-")
    spark.sparkContext.setCheckpointDir(path)
    return path


def materialise(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    Cuts the lineage durably (an executor loss re-reads files instead of
    recomputing the plan), keeps column pruning and filter pushdown for every
    later use and gives the planner the true size for its join choices.
    """
    spark = df.sparkSession
    path = os.path.join(_run_folder(spark), f"{label}-{uuid.uuid4().hex}")
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_if_there(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    """A stored Parquet table, or None if nothing is stored there; every other failure is raised."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _run_folder(spark: SparkSession) -> str:
    return os.path.join(shared_dir(spark), "tables", spark.sparkContext.applicationId)


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application, once no frame needs them."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_run_folder(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a scan of few, large pieces one partition per core; others stay as they are.

    A file of one row group is read by one task, which would run all row-wise
    work of the stage alone. Scans with enough partitions are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def in_pieces(df: DataFrame, key: str, each: int, size: Column | None = None) -> DataFrame:
    """``df`` partitioned by ``key`` into pieces of about ``each`` rows, or units of ``size``, however large it is.

    The number is stated, so adaptive execution does not merge the pieces again
    and the memory of a task stays the same on larger inputs.
    """
    total = df.agg(F.coalesce(F.sum(size) if size is not None else F.count(F.lit(1)), F.lit(0))).first()[0]
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(total / each)), key)


def read_table(spark: SparkSession, root: str, name: str, *columns: str) -> DataFrame:
    """One driver table; timestamps without zone become session (UTC) timestamps."""
    df = spark.read.parquet(os.path.join(root, f"{name}.parquet"))
    if columns:
        df = df.select(*columns)
    for field in df.schema.fields:
        if isinstance(field.dataType, T.TimestampNTZType):
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df
