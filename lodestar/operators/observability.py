"""Call metrics: lifetime counters and exact statistics of the newest calls."""

from __future__ import annotations

import functools
import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .skew import latest, top_k

# --- Fixed values. ---
WINDOW_CALLS = 500
ERROR_TEXT = 160
PERCENTILES = (50, 95, 99)
# --- End of fixed values. ---

CALL_SCHEMA = "ts timestamp, tool string, duration_ms double, output_size bigint, error string, msg string"


def window_calls(calls: DataFrame, order: list[Column], size: int = WINDOW_CALLS) -> DataFrame:
    """The newest ``size`` calls per tool; map tasks prune before the shuffle."""
    return top_k(calls, ["tool"], order, size, "_r").drop("_r")


def lifetime(calls: DataFrame) -> DataFrame:
    """(tool, count, errors, error_rate): over all calls."""
    errors = F.count_if(F.col("error").isNotNull())
    return calls.groupBy("tool").agg(
        F.count(F.lit(1)).alias("count"), errors.alias("errors"),
        F.round(errors / F.count(F.lit(1)), 3).alias("error_rate"),
    )


def summary(calls: DataFrame, order: list[Column]) -> DataFrame:
    """Per tool: lifetime counters and window latency and size statistics.

    Percentiles are exact (linear interpolation); they only ever see the window,
    so their state is bounded.
    """
    duration = F.col("duration_ms")
    recent = window_calls(calls.select("tool", "duration_ms", "output_size", "ts", *_extra(calls)), order)
    stats = recent.groupBy("tool").agg(
        F.round(F.avg(duration), 2).alias("avg_ms"),
        *[F.round(F.percentile(duration, F.lit(p / 100.0)), 2).alias(f"p{p}_ms") for p in PERCENTILES],
        F.round(F.max(duration), 2).alias("max_ms"),
        F.floor(F.avg("output_size")).cast("bigint").alias("avg_size"),
        F.max("output_size").alias("max_size"),
    )
    return lifetime(calls).join(stats, "tool")


def _extra(calls: DataFrame) -> list[str]:
    return [c for c in ("seq",) if c in calls.columns]


def last_errors(calls: DataFrame, order: list[Column]) -> DataFrame:
    """(tool, last_error): newest error as "type: message", cut to 160 characters."""
    failed = calls.where("error is not null").select(
        "tool", *[o.alias(f"_o{i}") for i, o in enumerate(order)],
        F.concat("error", F.lit(": "), F.left(F.coalesce("msg", F.lit("")), F.lit(ERROR_TEXT))).alias("last_error"),
    )
    newest = latest(failed, ["tool"], [F.col(f"_o{i}") for i in range(len(order))])
    return newest.select("tool", "last_error")


def errors_by_type(calls: DataFrame) -> DataFrame:
    return calls.where("error is not null").groupBy("tool", "error").agg(F.count(F.lit(1)).alias("n"))


def dashboard(calls: DataFrame, memories: DataFrame, outcomes: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, name, value): one long table of small aggregates."""
    def section(name: str, df: DataFrame, key: str, value: Column) -> DataFrame:
        return df.select(F.lit(name).alias("section"), F.col(key).cast("string").alias("name"), value.cast("bigint").alias("value"))

    parts = [
        section("tools", calls.groupBy("tool").agg(F.count(F.lit(1)).alias("n")), "tool", F.col("n")),
        section("memory", memories.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "status", F.col("n")),
        section("feedback", outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n")), "outcome", F.col("n")),
        section("graph", edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "kind", F.col("n")),
    ]
    return functools.reduce(DataFrame.unionByName, parts)


# ----------------------------------------------------------------- call recorder
class CallRecorder:
    """Times Python API calls and appends them to a ``tool_calls`` table."""

    def __init__(self, spark: SparkSession, path: str, flush_every: int = 100):
        self.spark, self.path, self.flush_every = spark, path, flush_every
        self._rows: list[tuple] = []

    def observed(self, name: str | None = None) -> Callable:
        """Decorator; wrapping a function twice records it once."""
        def wrap(fn: Callable) -> Callable:
            if getattr(fn, "_recorded_by", None) is self:
                return fn

            @functools.wraps(fn)
            def call(*args, **kwargs):
                started, result, error = time.time(), None, None
                try:
                    result = fn(*args, **kwargs)
                    return result
                except Exception as exc:
                    error = exc
                    raise
                finally:
                    self._record(name or fn.__name__, started, result, error)

            call._recorded_by = self
            return call

        return wrap

    def instrument(self, tools: dict[str, Callable]) -> dict[str, Callable]:
        return {name: self.observed(name)(fn) for name, fn in tools.items()}

    def _record(self, tool: str, started: float, result, error: Exception | None) -> None:
        import datetime

        try:
            if isinstance(result, str):
                size = len(result)
            else:
                size = 0 if result is None or isinstance(result, DataFrame) else len(json.dumps(result, default=str))
        except Exception:  # noqa: BLE001 - an odd result must not break the call
            size = 0
        self._rows.append((
            datetime.datetime.fromtimestamp(started, datetime.timezone.utc), tool,
            (time.time() - started) * 1000.0, size,
            type(error).__name__ if error else None, str(error)[:240] if error else None,
        ))
        if len(self._rows) >= self.flush_every:
            self.flush()

    def flush(self) -> None:
        if self._rows:
            rows, self._rows = self._rows, []
            self.spark.createDataFrame(rows, CALL_SCHEMA).write.mode("append").parquet(self.path)
