"""Validating an external ranking of answered files and applying it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- Fixed values. ---
ABSTAIN_BELOW = 0.75
REASON_LENGTH = 240
FIELDS = ("ranking", "confidence", "reason")
SCHEMA = "ranking array<string>, confidence double, reason string"
# --- End of fixed values. ---


def parse_verdict(raw: Column, candidates: Column) -> Column:
    """struct(ranking, confidence, reason) or NULL when the reply is not valid.

    The reply must be one JSON object with exactly the three fields and proper
    types. Unknown paths are dropped; missing candidates follow in their order.
    """
    text = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    keys = F.json_object_keys(text)
    value = F.from_json(text, SCHEMA)
    wanted = F.array(*[F.lit(f) for f in FIELDS])
    exact = (F.size(F.array_except(keys, wanted)) == 0) & (F.size(F.array_except(wanted, keys)) == 0)
    typed = (
        value["ranking"].isNotNull() & value["confidence"].between(0.0, 1.0) & value["reason"].isNotNull()
        & (F.length(value["reason"]) <= REASON_LENGTH) & ~F.exists(value["ranking"], lambda p: p.isNull())
        & F.get_json_object(text, "$.confidence").rlike(r"^-?[0-9.]+([eE][-+]?[0-9]+)?$")
    )
    order = F.array_distinct(F.concat(F.array_intersect(value["ranking"], candidates), candidates))
    return F.when(
        exact & typed & (F.size(candidates) > 0),
        F.struct(order.alias("ranking"), value["confidence"].alias("confidence"), value["reason"].alias("reason")),
    )


def apply_verdicts(answers: DataFrame, replies: DataFrame, head: int = 5) -> DataFrame:
    """(query_id, ranking, status): answers re-ordered by valid, confident replies.

    ``answers`` is (query_id, ranking array), ``replies`` (query_id, raw). Only
    the first ``head`` files may move; a reply that changes the first file with
    too little confidence abstains; an invalid one leaves the order as it was.
    """
    joined = answers.join(replies, "query_id", "left").withColumn("_head", F.slice("ranking", 1, head))
    joined = joined.withColumn("_v", parse_verdict(F.col("raw"), F.col("_head")))
    moved = F.col("_v.ranking")[0] != F.col("_head")[0]
    status = (
        F.when(F.col("raw").isNull(), "skipped").when(F.col("_v").isNull(), "error")
        .when(moved & (F.col("_v.confidence") < ABSTAIN_BELOW), "abstained").otherwise("verified")
    )
    tail = F.slice("ranking", head + 1, F.greatest(F.size("ranking") - head, F.lit(0)))
    return joined.withColumn("status", status).select(
        "query_id",
        F.when(F.col("status") == "verified", F.concat("_v.ranking", tail)).otherwise(F.col("ranking")).alias("ranking"),
        "status",
    )
