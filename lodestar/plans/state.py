"""Queries: operational state, feedback, claims, contexts and call metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import feedback, metrics, observability as O, store
from ..operators.skew import latest, top_k
from ..session import materialise, read_table
from . import sources as D


def precision_recall(spark: SparkSession, sf: str) -> DataFrame:
    newest = feedback.latest_prediction(D.predictions(spark, sf))
    joined = D.outcomes(spark, sf).join(newest.select("ticket_id", "predicted_files"), "ticket_id")
    m = metrics.precision_recall(F.col("predicted_files"), F.col("actual_files"))
    return joined.select("ticket_id", *[c.alias(n) for n, c in m.items()])


def raw_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events that were not promoted (purchases were), newest first."""
    rows = read_table(spark, sf, "events", "event_id", "ts", "event_type")
    rows = rows.withColumn("promoted", F.col("event_type") == "purchase")
    return store.raw_events(rows, False, [F.desc("ts"), F.desc("event_id")]).select("event_id", "event_type", "place")


def latest_prediction(spark: SparkSession, sf: str) -> DataFrame:
    return feedback.latest_prediction(D.predictions(spark, sf)).select(
        "ticket_id", "id", F.size("predicted_files").alias("n_files")
    )


def _reconciled(spark: SparkSession, sf: str) -> DataFrame:
    return feedback.reconcile(D.outcomes(spark, sf), D.predictions(spark, sf))


def reconcile(spark: SparkSession, sf: str) -> DataFrame:
    return _reconciled(spark, sf).select("ticket_id", "outcome", "status", "precision", "recall", "feedback")


def auto_tune(spark: SparkSession, sf: str) -> DataFrame:
    events = materialise(feedback.feedback_events(_reconciled(spark, sf)), "feedback")
    return feedback.auto_tune(D.shown_memories(spark, sf), events)


def _stats(spark: SparkSession, sf: str, fanout: bool) -> DataFrame:
    since = D.last_order_date(spark, sf) - F.make_dt_interval(F.lit(365))
    return feedback.feedback_stats(D.outcomes(spark, sf), D.predictions(spark, sf), since, fanout)


def feedback_stats_latest(spark: SparkSession, sf: str) -> DataFrame:
    return _stats(spark, sf, False)


def feedback_stats_fanout(spark: SparkSession, sf: str) -> DataFrame:
    return _stats(spark, sf, True)


def memory_health(spark: SparkSession, sf: str) -> DataFrame:
    """Label quality as hits, toxicity as misses, per source."""
    labels = read_table(spark, sf, "labels", "doc_id", "quality", "toxic")
    memories = labels.select(
        F.col("doc_id").alias("id"), F.col("quality").alias("hit_count"), (F.col("toxic") * 2).alias("miss_count")
    )
    return store.memory_health(memories)


def memory_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Order value, urgency and recency scored as a memory, with its level."""
    orders = read_table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_totalprice")
    age = F.greatest(F.datediff(D.last_order_date(spark, sf), "o_orderdate"), F.lit(0)) % 45
    score = store.memory_score(
        age.cast("double"), (F.col("o_custkey") % 12).cast("double"), (F.col("o_orderkey") % 7).cast("double"),
        F.col("o_orderpriority") == "1-URGENT",
    )
    return orders.select("o_orderkey", score.alias("score"), store.memory_level(score).alias("level"))


def memory_by_status(spark: SparkSession, sf: str) -> DataFrame:
    return D.customer_memories(spark, sf).groupBy("status", "scope_type").agg(F.count(F.lit(1)).alias("n"))


def _swept(spark: SparkSession, sf: str) -> DataFrame:
    now = D.last_order_date(spark, sf)
    orders = read_table(spark, sf, "orders", "o_orderkey", "o_orderdate").where(
        F.col("o_orderdate") >= now - F.make_dt_interval(F.lit(30))
    )
    items = read_table(spark, sf, "lineitem", "l_orderkey", "l_suppkey", "l_partkey")
    changed = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select(D.part_path().alias("path")).distinct()
    branches = read_table(spark, sf, "supplier", "s_suppkey").select(F.concat(F.lit("branch"), F.col("s_suppkey") % 3).alias("branch"))
    return store.sweep_staleness(store.touched_scopes(D.customer_memories(spark, sf), changed, branches), now)


def staleness_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return _swept(spark, sf).select("id", "status", "touched", "new_status")


def staleness_counts(spark: SparkSession, sf: str) -> DataFrame:
    return store.sweep_counts(_swept(spark, sf))


def latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    """Newest event of each user: the view over a change log."""
    events = read_table(spark, sf, "events", "event_id", "ts", "user_id", "event_type", "value")
    return latest(events, ["user_id"], [F.col("ts"), F.col("event_id")]).select("user_id", "event_id", "event_type", "value")


def upsert_view(spark: SparkSession, sf: str) -> DataFrame:
    """Current project row per user and type after all upserts, removed ones excluded."""
    events = read_table(spark, sf, "events", "event_id", "user_id", "event_type", "value")
    newest = latest(events, ["user_id", "event_type"], [F.col("event_id")])
    return newest.where("value >= 1").select("user_id", "event_type", "event_id", "value")


def last_session(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    return latest(rows, ["conv_id"], [F.col("turn")]).select("conv_id", "turn", "role", F.length("text").alias("n_chars"))


def l1_context(spark: SparkSession, sf: str) -> DataFrame:
    """First texts per role and conversation: 3 of one kind, 2 of another."""
    rows = read_table(spark, sf, "conversations", "conv_id", "turn", "role", "text").withColumn("digest", F.md5("text"))
    lists = store.context_lists(rows, "conv_id", "role", "digest", [F.desc("turn")], {"user": 3, "assistant": 2, "system": 1})
    return lists.select("conv_id", "role", F.array_join("items", ",").alias("items"))


def promotion(spark: SparkSession, sf: str) -> DataFrame:
    return store.ingest_commits(D.commit_messages(spark, sf)).select(
        "commit_hash", "classification", "promoted", "confidence", "reason", "content"
    )


def scope_inference(spark: SparkSession, sf: str) -> DataFrame:
    return store.ingest_commits(D.commit_messages(spark, sf)).select("commit_hash", "scope_type", "scope_value")


def prefix_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return store.similar_message_counts(
        D.commits(spark, sf).select(F.lit("shop").alias("project"), F.col("subject").alias("message"))
    ).select("prefix", "n")


def claims_expiry(spark: SparkSession, sf: str) -> DataFrame:
    state = store.claim_state(D.claim_log(spark, sf), D.last_order_date(spark, sf))
    return state.select("ticket", "author", "status", F.date_format("expires_at", "yyyy-MM-dd").alias("expires"), F.size("files").alias("n_files"))


def claims_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Active claims on any file that urgent orders touch."""
    state = store.claim_state(D.claim_log(spark, sf), D.last_order_date(spark, sf))
    urgent = read_table(spark, sf, "orders", "o_orderkey", "o_orderpriority").where("o_orderpriority = '1-URGENT'")
    items = read_table(spark, sf, "lineitem", "l_orderkey", "l_suppkey", "l_partkey")
    files = items.join(urgent, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select(D.part_path().alias("file"))
    return store.claims_for_files(state, files).select("ticket", "author", F.array_join("overlap", ",").alias("overlap"))


def similar_tickets(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages as tickets, documents as memories of their source."""
    docs = read_table(spark, sf, "documents", "doc_id", "text", "lang", "source")
    category = F.when(F.col("lang") == "en", "decision").when(F.col("lang") == "fr", "pattern").otherwise("failed")
    memories = docs.select(
        F.col("doc_id").alias("id"), category.alias("category"), F.col("text").alias("content"), F.lit("active").alias("status"),
        F.lit("module").alias("scope_type"), F.col("source").alias("scope_value"),
    )
    tickets = D.issues(spark, sf).select(
        F.col("query_id").alias("ticket_id"), "text", F.array(F.concat(F.lit("src"), F.col("query_id") % 20, F.lit("/x.py"))).alias("predicted_files")
    )
    return store.similar_tickets(tickets, memories)


def paired_arm_means(spark: SparkSession, sf: str) -> DataFrame:
    events = read_table(spark, sf, "events", "user_id", "event_type", "value")
    return metrics.paired_means(events, "user_id", "event_type", "value", ("click", "purchase"))


NEWEST_CALL = ("ts", "seq")


def tool_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return O.summary(D.tool_calls(spark, sf), [F.desc(c) for c in NEWEST_CALL])


def error_rates(spark: SparkSession, sf: str) -> DataFrame:
    return O.lifetime(D.tool_calls(spark, sf))


def errors_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return O.errors_by_type(D.tool_calls(spark, sf))


def last_errors(spark: SparkSession, sf: str) -> DataFrame:
    return O.last_errors(D.tool_calls(spark, sf), [F.col(c) for c in NEWEST_CALL])


def rolling_500(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of the newest 500 calls per tool."""
    recent = O.window_calls(D.tool_calls(spark, sf), [F.desc(c) for c in NEWEST_CALL])
    return recent.groupBy("tool").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("duration_ms"), 6).alias("mean_ms"))


def dashboard(spark: SparkSession, sf: str) -> DataFrame:
    edges = D.sparse_edges(spark, sf).select(F.lit("import").alias("kind"))
    return O.dashboard(D.tool_calls(spark, sf), D.customer_memories(spark, sf), D.outcomes(spark, sf), edges)


QUERIES = {f.__name__: f for f in (
    raw_events,
    precision_recall, latest_prediction, reconcile, auto_tune, feedback_stats_latest, feedback_stats_fanout, memory_health,
    memory_levels, memory_by_status, staleness_sweep, staleness_counts, latest_per_key, upsert_view, last_session, l1_context,
    promotion, scope_inference, prefix_frequency, claims_expiry, claims_overlap, similar_tickets, paired_arm_means,
    tool_percentiles, error_rates, errors_by_type, last_errors, rolling_500, dashboard,
)}
