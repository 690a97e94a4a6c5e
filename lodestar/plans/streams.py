"""Queries that replay driver tables as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.claims import expired_claims
from ..streaming.common import drain, new_folder, table_stream
from ..streaming.decisions import DecisionIngest
from ..streaming.ingest import CommitIngest, once_only
from ..streaming.rolling import RollingCalls
from . import sources as D


def stream_rolling_500(spark: SparkSession, sf: str) -> DataFrame:
    calls = D.calls_of(table_stream(spark, sf, "events"))
    return RollingCalls(spark, new_folder(spark, "rolling")).run(calls)


def stream_claim_expiry(spark: SparkSession, sf: str) -> DataFrame:
    orders = table_stream(spark, sf, "orders").select(
        F.col("o_custkey").alias("ticket"), F.col("o_orderdate").cast("timestamp").alias("created_at")
    )
    done = drain(expired_claims(orders), new_folder(spark, "claims"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return done.select("ticket", day("first_claim"), day("expires_at"), "n_claims")


def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Each event is a commit on the file of its user."""
    events = table_stream(spark, sf, "events")
    prefix = (
        F.when(F.col("event_type") == "error", "revert: ").when(F.col("event_type") == "click", "fix: ")
        .when(F.col("event_type") == "view", "feat: ").when(F.col("event_type") == "signup", "refactor: ").otherwise("docs: ")
    )
    commits = events.select(
        F.lit("shop").alias("project"), F.col("event_id").alias("commit_hash"),
        F.concat(prefix, F.lit("u"), "user_id").alias("message"),
        F.array(F.concat(F.lit("b"), F.col("user_id") % 5, F.lit("/u"), F.col("user_id"))).alias("files"),
    )
    return CommitIngest(spark, new_folder(spark, "ingest")).run(commits).select(
        "commit_hash", "classification", "promoted", "confidence", "scope_type", "scope_value"
    )


def stream_late_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The event stream delivered twice comes out once."""
    events = table_stream(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    again = table_stream(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    unique = drain(once_only(events.unionByName(again), "event_id", "ts", "2 days"), new_folder(spark, "dedup"))
    return unique.select("event_id", "event_type", "value")


def _event_commits(spark: SparkSession, sf: str) -> DataFrame:
    """Events as commits in the order of their ids; a sign-up decides where an area is kept."""
    events = table_stream(spark, sf, "events")
    user, size = F.col("user_id").cast("string"), F.regexp_extract("props", r'"k": (\d+)', 1)
    other = F.concat(F.when(F.col("event_type") == "error", "revert: ").when(F.col("event_type") == "click", "fix: ").when(F.col("event_type") == "view", "feat: ").otherwise("docs: "), F.lit("u"), user)
    decision = F.concat(F.lit("migrate area"), user, F.lit(" to store"), size, F.lit(" by team"), (F.col("user_id") % 7).cast("string"))
    return events.select(
        F.col("event_id").alias("seq"), F.lit("shop").alias("project"), F.col("event_id").cast("string").alias("commit_hash"),
        F.when(F.col("event_type") == "signup", decision).otherwise(other).alias("message"), F.array(F.concat(F.lit("b/u"), user)).alias("files"),
    )


def _event_decisions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return DecisionIngest(spark, new_folder(spark, "decisions"), common=("decision", "migrate")).run(_event_commits(spark, sf))


def stream_promotions(spark: SparkSession, sf: str) -> DataFrame:
    """Every event's promotion, counting only itself and what came before it."""
    return _event_decisions(spark, sf)[0].select("seq", "classification", "promoted", "confidence", "reason")


def stream_superseded(spark: SparkSession, sf: str) -> DataFrame:
    """The first later decision that replaces each one, from keyed state."""
    return _event_decisions(spark, sf)[1].select("old_seq", "new_seq", F.round("similarity", 6).alias("similarity"))


QUERIES = {f.__name__: f for f in (
    stream_rolling_500, stream_claim_expiry, stream_ingest, stream_late_dedup, stream_promotions, stream_superseded,
)}
