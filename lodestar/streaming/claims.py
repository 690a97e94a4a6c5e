"""Claim expiry over a stream of claim events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.store import CLAIM_TTL_DAYS


def expired_claims(claims: DataFrame, delay: str = "1 day") -> DataFrame:
    """(ticket, first_claim, expires_at, n_claims) once a ticket's claim ran out.

    Every claim renews its ticket for seven days, so the claims of a ticket form
    a session that closes seven days after the last one. The session closes when
    the watermark passes that moment.
    """
    session = F.session_window("created_at", f"{CLAIM_TTL_DAYS} days")
    return (
        claims.withWatermark("created_at", delay)
        .groupBy("ticket", session.alias("session"))
        .agg(F.count(F.lit(1)).alias("n_claims"))
        .select("ticket", F.col("session.start").alias("first_claim"), F.col("session.end").alias("expires_at"), "n_claims")
    )
