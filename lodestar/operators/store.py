"""Operational state as append-only change logs with latest-row views."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import paths as P
from ..functions import text as X
from ..session import materialise, read_if_there
from .skew import latest, ranked, top_k

# --- Fixed values. ---
STALE_DAYS = 90
SUSPECT_DAYS = 60
TOUCHED_DAYS = 14
CLAIM_TTL_DAYS = 7
PROMOTION_THRESHOLD = 3
MIN_SEMANTIC_FILES = 3
MAX_MODULE_FILES = 5
PREFIX_LENGTH = 30
OUTCOMES = ("completed", "reverted", "abandoned")
TICKET_CATEGORIES = ("decision", "pattern", "failed")
LEVEL_1, LEVEL_2 = 0.7, 0.4
# --- End of fixed values. ---

MEMORY_SCHEMA = (
    "id bigint, project string, level int, category string, content string, score double, status string, "
    "confidence string, source string, scope_type string, scope_value string, superseded_by bigint, "
    "hit_count int, miss_count int, last_verified_at timestamp, last_outcome_at timestamp, "
    "created_at timestamp, updated_at timestamp"
)


class ChangeLog:
    """One table kept as Parquet change rows (key, version, payload).

    Updates append a new version of the whole row; the current state is the
    newest version per key. Nothing is rewritten in place, so concurrent readers
    and repeated batches stay correct.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, schema: str, key: str):
        self.spark, self.key = spark, key
        self.path = os.path.join(root, name)
        # The DDL text is parsed here because parsing needs a running session.
        fields = T.StructType.fromDDL(schema).fields
        self.schema = T.StructType(fields + [T.StructField("version", T.LongType())])

    def log(self) -> DataFrame:
        stored = read_if_there(self.spark, self.path, self.schema)
        return self.spark.createDataFrame([], self.schema) if stored is None else stored

    def current(self) -> DataFrame:
        return latest(self.log(), [self.key], [F.col("version")]).select(*self.schema.fieldNames()).drop("version")

    def next_version(self) -> int:
        return (self.log().agg(F.max("version")).first()[0] or 0) + 1

    def append(self, rows: DataFrame) -> None:
        """Add rows (new or changed) as one version; missing columns become NULL."""
        version = self.next_version()
        columns = [
            F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in self.schema.fields[:-1]
        ]
        out = rows.select(*columns, F.lit(version).cast("bigint").alias("version"))
        out.write.mode("append").parquet(self.path)

    def insert(self, rows: DataFrame, order: list[Column]) -> DataFrame:
        """Append new rows with the next ids, given in the stated order."""
        first = (self.log().agg(F.max(self.key)).first()[0] or 0) + 1
        rows = materialise(rows, "insert")
        numbered = ranked(rows, [], order, "_rn")
        numbered = materialise(
            numbered.withColumn(self.key, (F.col("_rn") + (first - 1)).cast("bigint")).drop("_rn"), "numbered"
        )
        self.append(numbered)
        return numbered


# ---------------------------------------------------------------- memory rules
def memory_score(age_days: Column, frequency: Column, files: Column, explicit: Column) -> Column:
    """Recency over 30 days, frequency to 10, impact to 5 files, explicit mark."""
    return F.round(
        F.greatest(F.lit(0.0), 1.0 - age_days / 30.0) * 0.35
        + F.least(F.lit(1.0), frequency / 10.0) * 0.30
        + F.least(F.lit(1.0), files / 5.0) * 0.20
        + F.when(explicit, 1.0).otherwise(0.0) * 0.15,
        3,
    )


def memory_level(score: Column) -> Column:
    return F.when(score >= LEVEL_1, 1).when(score >= LEVEL_2, 2).otherwise(3)


def touched_scopes(memories: DataFrame, changed_files: DataFrame, branches: DataFrame) -> DataFrame:
    """Adds ``touched``: does the scope overlap recent changes.

    Only file and module scopes compare with paths; a scope value lies inside a
    path, so the distinct values and paths meet on whole path pieces first
    (a value without any whole piece falls back to trigrams).
    """
    from .similarity import containing

    scope = F.coalesce("scope_type", F.lit("repo"))
    by_path = memories.where(scope.isin("file", "module") & (F.coalesce("scope_value", F.lit("")) != ""))
    values = by_path.select("scope_value").distinct()
    hit = containing(
        values, "scope_value", F.col("scope_value"), changed_files.select("path").distinct(), "path", F.col("path")
    ).select("scope_value").distinct().withColumn("_hit", F.lit(True))
    live = branches.select(F.col("branch").alias("scope_value")).distinct().withColumn("_live", F.lit(True))
    has_value = F.coalesce("scope_value", F.lit("")) != ""
    touched = (
        F.when((scope == "branch") & has_value, F.coalesce("_live", F.lit(False)))
        .when(scope.isin("file", "module") & has_value, F.coalesce("_hit", F.lit(False)))
        .otherwise(F.lit(True))
    )
    return (
        memories.join(hit, "scope_value", "left").join(live, "scope_value", "left")
        .withColumn("touched", touched).drop("_hit", "_live")
    )


def sweep_staleness(memories: DataFrame, now: Column) -> DataFrame:
    """Adds ``new_status`` for active and suspect rows with a known verification time."""
    at = F.col("last_verified_at")
    older = lambda days: at < now - F.make_dt_interval(F.lit(days))
    status = (
        F.when(at.isNull(), F.col("status"))
        .when(older(STALE_DAYS), "stale")
        .when(older(SUSPECT_DAYS), F.when(F.col("touched"), "stale").otherwise("suspect"))
        .when(F.col("touched") & older(TOUCHED_DAYS), "suspect")
        .otherwise("active")
    )
    return memories.where(F.col("status").isin("active", "suspect")).withColumn("new_status", status)


def sweep_counts(swept: DataFrame) -> DataFrame:
    """(outcome, n): how many rows changed to each status, or stayed."""
    outcome = F.when(F.col("new_status") == F.col("status"), "unchanged").otherwise(F.col("new_status"))
    return swept.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def superseded_by_prefix(memories: DataFrame, prefix: str, new_id: int) -> DataFrame:
    """Active rows that contain the prefix, marked as replaced by ``new_id``."""
    return memories.where(
        (F.col("status") == "active") & (F.col("id") != new_id)
        & F.lower("content").contains(prefix.lower())
    ).withColumn("status", F.lit("superseded")).withColumn("superseded_by", F.lit(new_id).cast("bigint"))


def reactivated(memories: DataFrame, now: Column) -> DataFrame:
    return (
        memories.withColumn("status", F.lit("active"))
        .withColumn("last_verified_at", now).withColumn("updated_at", now)
    )


def memory_health(memories: DataFrame, limit: int = 20) -> DataFrame:
    """Memories with feedback, those with the most misses first."""
    hit, miss = F.coalesce("hit_count", F.lit(0)), F.coalesce("miss_count", F.lit(0))
    return (
        memories.where((hit > 0) | (miss > 0)).withColumn("delta", miss - hit)
        .orderBy(F.desc("delta"), F.desc("id")).limit(limit)
    )


def by_level(memories: DataFrame, project: str, level: int | None = None, active_only: bool = True) -> DataFrame:
    rows = memories.where(F.col("project") == project)
    if level is not None:
        rows = rows.where(F.col("level") == level)
    if active_only:
        rows = rows.where("status = 'active'")
    return rows.orderBy(F.desc("score"), F.desc("updated_at"))


# ------------------------------------------------------------- commit ingestion
def scope_of(files: Column) -> Column:
    """struct(scope_type, scope_value): module when at most 5 files share one folder."""
    dirs = F.array_distinct(
        F.array_compact(F.transform(files, lambda f: P.directory(f)))
    )
    one = (F.size(files) > 0) & (F.size(files) <= MAX_MODULE_FILES) & (F.size(dirs) == 1)
    return F.struct(
        F.when(one, "module").otherwise("repo").alias("scope_type"),
        F.when(one, F.element_at(dirs, 1)).alias("scope_value"),
    )


def similar_message_counts(events: DataFrame) -> DataFrame:
    """(project, prefix, n): messages per case-insensitive 30-character prefix."""
    return events.groupBy("project", message_prefix(F.col("message")).alias("prefix")).agg(
        F.count(F.lit(1)).alias("n")
    )


def promotion(message: Column, classification: Column, n_files: Column, similar: Column) -> Column:
    """struct(promote, confidence, reason) of the first rule that applies."""
    low = F.trim(F.lower(message))

    def verdict(promote: bool, confidence: str, reason: Column | str) -> Column:
        text = F.lit(reason) if isinstance(reason, str) else reason
        return F.struct(
            F.lit(promote).alias("promote"), F.lit(confidence).alias("confidence"), text.alias("reason")
        )

    return (
        F.when(
            X.any_prefix(low, X.NOISE_PREFIXES),
            verdict(False, "low", F.concat(F.lit("low-signal prefix ("), F.substring_index(low, ":", 1), F.lit(":)"))),
        )
        .when(X.any_of(low, X.BREAKING_WORDS), verdict(True, "high", "breaking change or revert"))
        .when(classification == "decision", verdict(True, "high", "architectural decision"))
        .when(
            X.any_prefix(message, X.SEMANTIC_PREFIXES) & (n_files >= MIN_SEMANTIC_FILES),
            verdict(True, "medium", F.concat(F.lit("semantic commit with multi-file impact ("), n_files, F.lit(" files)"))),
        )
        .when(
            similar >= PROMOTION_THRESHOLD,
            verdict(True, "medium", F.concat(F.lit("recurring pattern ("), similar, F.lit(" occurrences)"))),
        )
        .otherwise(verdict(False, "low", "insufficient signal"))
    )


def message_prefix(message: Column) -> Column:
    """What recurring messages share: the first 30 characters, in lower case."""
    return F.lower(F.left(message, F.lit(PREFIX_LENGTH)))


def ingest_commits(commits: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """Classified commits with promotion and the memory fields they would get.

    ``commits`` is (project, commit_hash, message, files); the prefix counts run
    over ``history`` plus these commits. Noise is never promoted.
    """
    seen = commits.select("project", "message")
    if history is not None:
        seen = seen.unionByName(history.select("project", "message"))
    counts = similar_message_counts(seen)
    return decide_commits(commits.withColumn("prefix", message_prefix(F.col("message"))).join(counts, ["project", "prefix"]))


def decide_commits(counted: DataFrame, *keep: str) -> DataFrame:
    """The same for commits that know ``n``, the number of messages with their prefix; ``keep`` names further columns."""
    decided = counted.withColumn("classification", X.classify_commit(F.col("message"))).withColumn(
        "_p", promotion(F.col("message"), F.col("classification"), F.size("files"), F.col("n"))
    ).withColumn("_s", scope_of(F.col("files")))
    promoted = F.col("_p.promote") & (F.col("classification") != "noise")
    high = F.col("_p.confidence") == "high"
    return decided.select(
        *keep, "project", "commit_hash", "message", "files", "classification", promoted.alias("promoted"),
        F.col("_p.confidence").alias("confidence"), F.col("_p.reason").alias("reason"),
        F.when(high, 1).otherwise(2).alias("level"), F.when(high, 0.8).otherwise(0.5).alias("score"),
        F.concat(
            "classification", F.lit(": "), F.regexp_extract(F.trim("message"), r"^([^\r\n]*)", 1)
        ).alias("content"),
        F.col("_s.scope_type").alias("scope_type"), F.col("_s.scope_value").alias("scope_value"),
    )


# ----------------------------------------------------------------------- claims
def claim_state(claims: DataFrame, now: Column) -> DataFrame:
    """The newest claim per ticket with its state at ``now``; released ones are gone.

    ``claims`` is an event log (ticket, author, files, status, created_at).
    """
    current = latest(claims, ["ticket"], [F.col("created_at"), F.col("seq")])
    expires = F.col("created_at") + F.make_dt_interval(F.lit(CLAIM_TTL_DAYS))
    return (
        current.where("status != 'released'")
        .withColumn("expires_at", expires)
        .withColumn("status", F.when((now > expires) & (F.col("status") == "active"), "stale").otherwise(F.col("status")))
    )


def active_claims(state: DataFrame) -> DataFrame:
    return state.where(F.col("status").isin("active", "suspect"))


def claims_for_files(state: DataFrame, files: DataFrame) -> DataFrame:
    """Active claims on any of files(file), with the shared files."""
    opened = active_claims(state).select("ticket", "author", F.explode(F.array_distinct("files")).alias("file"))
    return opened.join(files.select("file").distinct(), "file", "left_semi").groupBy("ticket", "author").agg(
        F.array_sort(F.collect_set("file")).alias("overlap")
    )


# --------------------------------------------------------------------- contexts
def context_lists(rows: DataFrame, key: str, category: str, text: str, order: list[Column], limits: dict[str, int]) -> DataFrame:
    """(key, category, items): the first n texts per category, as one list.

    Rows beyond a category's limit are pruned before they are collected.
    """
    wanted = rows.where(F.col(category).isin(*limits))
    first = top_k(wanted, [key, category], order, max(limits.values()), "_r")
    cap = F.lit(0)
    for name, n in limits.items():
        cap = F.when(F.col(category) == name, F.lit(n)).otherwise(cap)
    kept = first.where(F.col("_r") <= cap)
    return kept.groupBy(key, category).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", text))), lambda s: s[text]).alias("items")
    )


def raw_events(events: DataFrame, promoted: bool, newest_first: list[Column]) -> DataFrame:
    """Raw events that were (or were not) promoted, with ``place`` 1 for the newest.

    ``events`` has a boolean ``promoted``; NULL counts as not promoted.
    """
    return ranked(events.where(F.coalesce("promoted", F.lit(False)) == promoted).drop("promoted"), [], newest_first, "place")


def similar_tickets(
    tickets: DataFrame, memories: DataFrame, newest: int | None = None, threshold: float = 0.2, k: int = 5
) -> DataFrame:
    """(ticket_id, memory_id, similarity, rank) of fresh, related memories.

    Candidates are all active or suspect memories of a ticket-like category or
    text, or the ``newest`` of them if that is given. A memory scoped to a predicted file adds 0.2; memories of
    the ticket itself are left out. ``tickets`` is (ticket_id, text,
    predicted_files).
    """
    from .similarity import FILE_BONUS, containing

    fresh = memories.where(
        F.col("status").isin("active", "suspect")
        & (F.col("category").isin(*TICKET_CATEGORIES) | F.lower("content").rlike("ticket #|issue #|pr #"))
    )
    if newest is not None:
        fresh = fresh.orderBy(F.desc("id")).limit(newest)
    m = materialise(
        fresh.select(
            F.col("id").alias("memory_id"), "content", X.ticket_id(F.col("content")).alias("memory_ticket"),
            F.lower(F.coalesce("scope_value", F.lit(""))).alias("sv"),
        ),
        "candidates",
    )
    t = tickets.select("ticket_id", "text", F.coalesce("predicted_files", F.array().cast("array<string>")).alias("files"))
    # A related pair shares a token or a file, so both kinds meet in equi-joins.
    tt = X.set_token_rows(t, F.col("text"), "ticket_id")
    mt = X.set_token_rows(m, F.col("content"), "memory_id")
    tn = tt.groupBy("ticket_id").agg(F.count(F.lit(1)).alias("tn"))
    mn = mt.groupBy("memory_id").agg(F.count(F.lit(1)).alias("mn"))
    shared = tt.join(mt, "term").groupBy("ticket_id", "memory_id").agg(F.count(F.lit(1)).alias("shared"))
    named = t.select("ticket_id", F.explode("files").alias("f")).select("ticket_id", F.lower("f").alias("f")).distinct()
    scoped = m.where("sv != ''").select("memory_id", "sv")
    values, files = scoped.select("sv").distinct(), named.select("f").distinct()
    inside = containing(values, "sv", F.col("sv"), files, "f", F.col("f")).unionByName(
        containing(files, "f", F.col("f"), values, "sv", F.col("sv")).select("sv", "f")
    ).distinct()
    bonus = named.join(inside, "f").join(scoped, "sv").select("ticket_id", "memory_id").distinct().withColumn(
        "bonus", F.lit(FILE_BONUS)
    )
    text_part = F.coalesce(
        F.try_divide(F.col("shared"), F.col("tn") + F.col("mn") - F.col("shared")), F.lit(0.0)
    )
    total = F.least(F.lit(1.0), text_part + F.coalesce("bonus", F.lit(0.0)))
    scored = (
        shared.join(bonus, ["ticket_id", "memory_id"], "full")
        .join(tn, "ticket_id", "left").join(mn, "memory_id", "left")
        .join(m.select("memory_id", "memory_ticket"), "memory_id")
        .where(F.col("memory_ticket").isNull() | (F.col("memory_ticket") != F.col("ticket_id")))
        .withColumn("_total", total).where(F.col("_total") >= threshold)
        .select("ticket_id", "memory_id", F.round("_total", 3).alias("similarity"))
    )
    return top_k(scored, ["ticket_id"], [F.desc("similarity"), F.desc("memory_id")], k)
