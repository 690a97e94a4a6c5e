"""Predictions, outcomes and what they teach the memories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import precision_recall
from .skew import latest, running_sum

# --- Fixed values. ---
HIT_PRECISION = 0.3
DEMOTE_DELTA = 3
PROMOTE_DELTA = 3
SCORE_BUMP = 0.1
SCORE_CAP = 1.0
OUTCOMES = ("completed", "reverted", "abandoned")
# --- End of fixed values. ---


def latest_prediction(predictions: DataFrame) -> DataFrame:
    """The newest logged prediction per (project, ticket)."""
    return latest(predictions, ["project", "ticket_id"], [F.col("id")])


def valid_outcomes(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.col("outcome").isin(*OUTCOMES))


def reconcile(outcomes: DataFrame, predictions: DataFrame, threshold: float = HIT_PRECISION) -> DataFrame:
    """One row per outcome with its metrics and the feedback for shown memories.

    Without a prediction or when abandoned it is skipped; a reverted ticket is a
    miss; a completed one a hit when precision reaches the threshold. Outcomes
    of any other name are rejected.
    """
    newest = latest_prediction(predictions).select(
        "project", "ticket_id", "predicted_files", "memories_shown", F.lit(True).alias("_known")
    )
    joined = valid_outcomes(outcomes).join(newest, ["project", "ticket_id"], "left")
    m = precision_recall(F.col("predicted_files"), F.col("actual_files"))
    status = (
        F.when(F.col("_known").isNull(), "skipped").when(F.col("outcome") == "abandoned", "skipped")
        .when(F.col("outcome").isin("completed", "reverted"), "reconciled").otherwise("error")
    )
    feedback = F.when(
        F.col("status") == "reconciled",
        F.when((F.col("outcome") == "completed") & (F.col("precision") >= threshold), "hit").otherwise("miss"),
    )
    known = lambda c: F.when(F.col("_known"), c)
    return (
        joined.withColumn("status", status)
        .select(
            "id", "project", "ticket_id", "outcome", "status", "memories_shown",
            *[known(c).alias(name) for name, c in m.items()],
        )
        .withColumn("feedback", feedback)
    )


def feedback_events(reconciled: DataFrame) -> DataFrame:
    """(memory_id, seq, delta): +1 per hit and -1 per miss, in outcome order."""
    rows = reconciled.where("feedback is not null").select(
        "id", "feedback", F.posexplode("memories_shown").alias("pos", "memory_id")
    )
    return rows.select(
        "memory_id", F.struct(F.col("id").cast("long").alias("id"), F.col("pos").cast("long").alias("pos")).alias("seq"),
        F.when(F.col("feedback") == "hit", 1).otherwise(-1).alias("delta"),
    )


def auto_tune(memories: DataFrame, events: DataFrame) -> DataFrame:
    """(id, hit_count, miss_count, status, score) after all feedback events.

    The rules run after every event and look only at d = hits - misses: d <= -3
    makes a memory suspect, d >= 3 makes it active and adds 0.1 up to 1. So the
    final status follows the last event with |d| >= 3 and the score the number
    of events with d >= 3; both are aggregates over a running sum, and a memory
    with very many events is never folded in one task.
    """
    start = memories.select(
        "id", F.coalesce("hit_count", F.lit(0)).alias("h0"), F.coalesce("miss_count", F.lit(0)).alias("m0"),
        "status", F.coalesce("score", F.lit(0.0)).alias("score"),
    )
    summed = running_sum(events, ["memory_id"], "seq", "delta", "run").join(
        start.select(F.col("id").alias("memory_id"), (F.col("h0") - F.col("m0")).alias("d0")), "memory_id"
    )
    d = F.col("run") + F.col("d0")
    turn = F.when(d <= -DEMOTE_DELTA, "suspect").when(d >= PROMOTE_DELTA, "active")
    per = summed.groupBy(F.col("memory_id").alias("id")).agg(
        F.count_if(F.col("delta") == 1).alias("hits"), F.count_if(F.col("delta") == -1).alias("misses"),
        F.count_if(d >= PROMOTE_DELTA).alias("bumps"),
        F.max_by(turn, F.when(turn.isNotNull(), F.col("seq"))).alias("turned"),
    )
    tuned = F.col("status").isin("active", "suspect")
    bumped = F.least(
        F.greatest(F.lit(SCORE_CAP), F.col("score")), F.col("score") + F.lit(SCORE_BUMP) * F.coalesce("bumps", F.lit(0))
    )
    return start.join(per, "id", "left").select(
        "id",
        (F.col("h0") + F.coalesce("hits", F.lit(0))).cast("int").alias("hit_count"),
        (F.col("m0") + F.coalesce("misses", F.lit(0))).cast("int").alias("miss_count"),
        F.when(tuned, F.coalesce("turned", "status")).otherwise(F.col("status")).alias("status"),
        F.round(F.when(tuned, bumped).otherwise(F.col("score")), 6).alias("score"),
    )


def feedback_stats(
    outcomes: DataFrame, predictions: DataFrame, since: Column | None = None, fanout: bool = False
) -> DataFrame:
    """(project, total, completed, reverted, abandoned, averages, samples).

    ``fanout`` counts an outcome once per prediction of its ticket; the default
    uses the newest prediction only.
    """
    rows = outcomes if since is None else outcomes.where(F.col("created_at") >= since)
    used = predictions if fanout else latest_prediction(predictions)
    joined = rows.join(
        used.select("project", "ticket_id", "predicted_files", F.lit(True).alias("_known")), ["project", "ticket_id"], "left"
    )
    m = precision_recall(F.col("predicted_files"), F.col("actual_files"))
    sample = F.col("_known") & (F.col("outcome") != "abandoned")
    return joined.groupBy("project").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES],
        F.round(F.avg(F.when(sample, m["precision"])), 3).alias("avg_precision"),
        F.round(F.avg(F.when(sample, m["recall"])), 3).alias("avg_recall"),
        F.count_if(sample).alias("samples"),
    )
