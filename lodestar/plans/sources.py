"""The driver tables mapped onto the engine's own tables.

The given tables hold no source code, so documents stand for files, benchmark
passages for issues, orders for commits, line items for changed files, and so
on. Every frame here is derived by Spark from whole tables.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P, text as X
from ..operators import graph, index
from ..operators.similarity import containing
from ..session import in_pieces, read_table, spread

#: Line items that one task gathers into patches.
ITEMS_PER_PIECE = 500_000


def fingerprint(spark: SparkSession, sf: str, name: str) -> str:
    """Identity of a table's files: path, sizes and modification times."""
    meta = (
        spark.read.parquet(os.path.join(sf, f"{name}.parquet"))
        .select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
        .groupBy("file_path").agg(F.max("file_size").alias("s"), F.max("file_modification_time").alias("t"))
        .agg(F.sum("s"), F.max("t"), F.count(F.lit(1)), F.min("file_path")).first()
    )
    return hashlib.md5(repr(tuple(meta)).encode()).hexdigest()[:16]


# ------------------------------------------------------------ text corpus side
def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Files: (doc, path, text, n_lines). Source 3 plays tests, source 7 build output."""
    docs = spread(read_table(spark, sf, "documents", "doc_id", "text", "lang", "source"), "doc_id")
    folder = F.when(F.col("source") == "src7", "build").otherwise(F.col("source"))
    name = F.when(F.col("source") == "src3", "test_doc_").otherwise("doc_")
    return docs.select(
        F.col("doc_id").alias("doc"),
        F.concat("lang", F.lit("/"), folder, F.lit("/"), name, "doc_id", F.lit(".py")).alias("path"),
        "text",
        (F.length("text") - F.length(F.regexp_replace("text", "\n", "")) + 1).alias("n_lines"),
    )


def issues(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, title, text) from the benchmark passages."""
    return read_table(spark, sf, "benchmark", "item_id", "text").select(
        F.col("item_id").alias("query_id"), X.title_of(F.col("text")).alias("title"), "text"
    )


def failure_reports(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, title, text): every event as a report whose stack frames, paths and module name point at two documents."""
    files = corpus(spark, sf).select("doc", "path")
    n = files.count()
    first, second = F.pmod(F.col("event_id"), F.lit(n)), F.pmod(F.col("event_id") * 7 + 1, F.lit(n))
    events = read_table(spark, sf, "events", "event_id", "event_type").select("event_id", "event_type", first.alias("a"), second.alias("b"))
    events = events.join(files.select(F.col("doc").alias("a"), F.col("path").alias("pa")), "a").join(files.select(F.col("doc").alias("b"), F.col("path").alias("pb")), "b")
    text = F.concat(
        F.lit('Traceback (most recent call last):\n  File "/srv/app/'), "pa", F.lit('", line 10, in run\n  File "/srv/app/'), "pb",
        F.lit('", line 20, in load\nSeen since ./'), "pa", F.lit(" changed; see "), P.module_of(F.col("pb")), F.lit(" there."),
    )
    return events.select(F.col("event_id").alias("query_id"), F.concat(F.lit("Failed "), "event_type").alias("title"), text.alias("text"))


def gold(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, doc): documents that contain the passage."""
    return containing(
        issues(spark, sf), "query_id", F.col("text"), corpus(spark, sf), "doc", F.col("text")
    )


def token_index(spark: SparkSession, sf: str) -> index.CorpusIndex:
    name = f"tokens-{fingerprint(spark, sf, 'documents')}"
    return index.get_or_build(spark, name, lambda: index.code_token_index(corpus(spark, sf), "doc", "text"))


def term_index(spark: SparkSession, sf: str) -> index.CorpusIndex:
    name = f"terms-{fingerprint(spark, sf, 'documents')}"
    return index.get_or_build(spark, name, lambda: index.code_term_index(corpus(spark, sf), "doc", "text"))


def line_starts(text: Column) -> Column:
    return X.matches(text, "(?:^|\n)([A-Za-z][A-Za-z0-9_]{2,})", 1)


def definitions(files: DataFrame) -> DataFrame:
    """(doc, symbol, kind): words that start a line; capitalised ones play classes."""
    words = files.select("doc", F.explode(line_starts(F.col("text"))).alias("w"))
    kind = F.when(F.col("w").rlike("^[A-Z]"), "class").otherwise("func")
    return words.groupBy("doc", F.lower("w").alias("symbol")).agg(F.min(kind).alias("kind"))


def literals(files: DataFrame) -> DataFrame:
    """(doc, literal): message-like lines of each file."""
    line = F.regexp_replace("line", r"^\s+|\s+$", "")
    return (
        files.select("doc", F.explode(F.split("text", "\n")).alias("line"))
        .select("doc", X.literal_fragment(line).alias("literal"))
        .where("literal is not null").distinct()
    )


def definition_table(spark: SparkSession, sf: str) -> DataFrame:
    """The stored definitions of the corpus."""
    name = f"defs-{fingerprint(spark, sf, 'documents')}"
    return index.get_or_build_table(spark, name, lambda: definitions(corpus(spark, sf)))


def literal_table(spark: SparkSession, sf: str) -> DataFrame:
    """The stored literals of the corpus."""
    name = f"literals-{fingerprint(spark, sf, 'documents')}"
    return index.get_or_build_table(spark, name, lambda: literals(corpus(spark, sf)))


def legacy_index(spark: SparkSession, sf: str) -> index.CorpusIndex:
    name = f"legacy-{fingerprint(spark, sf, 'documents')}"
    return index.get_or_build(spark, name, lambda: index.legacy_index(legacy_files(spark, sf)))


def legacy_files(spark: SparkSession, sf: str) -> DataFrame:
    """(path, doc, symbols, identifiers) for the symbol index."""
    text = F.col("text")
    symbols = F.array_distinct(F.transform(line_starts(text), lambda w: F.lower(w)))
    return corpus(spark, sf).select("path", "doc", symbols.alias("symbols"), X.index_identifiers(text).alias("identifiers"))


# ------------------------------------------------------------------ commit side
SUBJECTS = {
    "1-URGENT": "fix: urgent order", "2-HIGH": "feat: order", "3-MEDIUM": "refactor: order",
    "4-NOT SPECIFIED": "revert: order",
}


def commits(spark: SparkSession, sf: str) -> DataFrame:
    """(commit, subject, at, author) from orders."""
    subject = F.lit("docs: order")
    for priority, text in SUBJECTS.items():
        subject = F.when(F.col("o_orderpriority") == priority, F.lit(text)).otherwise(subject)
    orders = read_table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    return orders.select(
        F.col("o_orderkey").alias("commit"),
        F.concat(subject, F.lit(" for customer "), "o_custkey").alias("subject"),
        F.col("o_orderdate").alias("at"),
        F.concat(F.lit("dev"), F.col("o_custkey") % 20).alias("author"),
    )


NEWEST = ("at", "commit")


def aged_commits(spark: SparkSession, sf: str) -> DataFrame:
    return graph.commit_ages(commits(spark, sf), [F.desc(c) for c in NEWEST])


def changes(spark: SparkSession, sf: str) -> DataFrame:
    """(commit, file): parts of an order, as numbers."""
    return read_table(spark, sf, "lineitem", "l_orderkey", "l_partkey").select(
        F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file")
    )


def cochange_pairs(spark: SparkSession, sf: str, **kw) -> DataFrame:
    """Change coupling over all commits."""
    rows = changes(spark, sf).join(aged_commits(spark, sf).select("commit", "age"), "commit")
    return graph.cochange(rows, **kw)


def sparse_edges(spark: SparkSession, sf: str) -> DataFrame:
    """(src, dst): both directions between the smallest and the largest part of every order; one link an order keeps it sparse."""
    ends = changes(spark, sf).groupBy("commit").agg(F.min("file").alias("left"), F.max("file").alias("right"))
    pairs = ends.where("left < right").select("left", "right").distinct().withColumn("weight", F.lit(1.0))
    return graph.symmetric(pairs)


def file_history(spark: SparkSession, sf: str) -> DataFrame:
    """(doc, touches, recent, fixes): orders as commits, parts as files."""
    from ..operators import channels as C

    aged = aged_commits(spark, sf)
    files = changes(spark, sf).distinct().groupBy("commit").agg(F.collect_list("file").alias("files"))
    return C.history_counts(aged.join(files, "commit")).withColumnRenamed("path", "doc")


# ------------------------------------------------------------------- event side
def tool_calls(spark: SparkSession, sf: str) -> DataFrame:
    """(seq, ts, tool, duration_ms, output_size, error, msg) from events."""
    return calls_of(read_table(spark, sf, "events"))


def calls_of(events: DataFrame) -> DataFrame:
    size = F.regexp_extract("props", r'"k": (\d+)', 1).cast("bigint")
    return events.select(
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("tool"),
        F.col("value").alias("duration_ms"), size.alias("output_size"),
        F.when(size % 10 == 0, "TimeoutError").when(size % 10 == 5, "ValueError").alias("error"),
        F.concat(F.lit("user "), F.col("user_id"), F.lit(" size "), size).alias("msg"),
    )


# ------------------------------------------------------------ operational state
def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Prediction log: every ticket's parts, and for even tickets a second, shorter list."""
    items = read_table(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_linenumber")
    orders = read_table(spark, sf, "orders", "o_orderkey", "o_custkey")
    entries = items.select(
        "l_orderkey", "l_partkey", "l_linenumber",
        F.explode(
            F.when(F.col("l_orderkey") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        ).alias("version"),
    ).where((F.col("version") == 0) | (F.col("l_linenumber") <= 4))
    lists = entries.groupBy("l_orderkey", "version").agg(
        F.collect_set(F.concat(F.lit("p"), "l_partkey")).alias("predicted_files")
    )
    return lists.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("l_orderkey") * 2 + F.col("version")).alias("id"), F.lit("shop").alias("project"),
        F.col("l_orderkey").alias("ticket_id"), "predicted_files",
        F.array((F.col("o_custkey") % 50).cast("bigint"), (F.col("o_custkey") + 100).cast("bigint")).alias("memories_shown"),
    )


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Ticket outcomes: the files with larger quantities were really changed."""
    items = read_table(spark, sf, "lineitem", "l_orderkey", "l_partkey", "l_quantity")
    orders = read_table(spark, sf, "orders", "o_orderkey", "o_orderstatus", "o_orderdate")
    actual = items.where("l_quantity > 20").groupBy("l_orderkey").agg(
        F.collect_set(F.concat(F.lit("p"), "l_partkey")).alias("actual_files")
    )
    outcome = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "reverted").otherwise("abandoned")
    return orders.join(actual, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("id"), F.lit("shop").alias("project"), F.col("o_orderkey").alias("ticket_id"),
        outcome.alias("outcome"), F.coalesce("actual_files", F.array().cast("array<string>")).alias("actual_files"),
        F.col("o_orderdate").alias("created_at"),
    )


def shown_memories(spark: SparkSession, sf: str) -> DataFrame:
    """(id, hit_count, miss_count, status, score) of every memory that was shown."""
    customers = read_table(spark, sf, "customer", "c_custkey")
    ids = customers.select((F.col("c_custkey") % 50).cast("bigint").alias("id")).distinct().unionByName(
        customers.select((F.col("c_custkey") + 100).cast("bigint").alias("id"))
    )
    return ids.select(
        "id", F.lit(0).alias("hit_count"), F.lit(0).alias("miss_count"),
        F.when(F.col("id") % 3 == 0, "suspect").otherwise("active").alias("status"), F.lit(0.5).alias("score"),
    )


SCOPES = {"BUILDING": "repo", "AUTOMOBILE": "module", "MACHINERY": "file", "HOUSEHOLD": "branch"}


def part_path(supplier: str = "l_suppkey", part: str = "l_partkey") -> Column:
    return F.concat(F.lit("b"), F.col(supplier) % 5, F.lit("/p"), F.col(part))


def customer_memories(spark: SparkSession, sf: str) -> DataFrame:
    """One memory per ordering customer, verified with the last order."""
    orders = read_table(spark, sf, "orders", "o_custkey", "o_orderdate")
    last = orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_verified_at"))
    customers = read_table(spark, sf, "customer", "c_custkey", "c_mktsegment")
    key = F.col("c_custkey")
    scope = F.lit("ticket")
    for segment, name in SCOPES.items():
        scope = F.when(F.col("c_mktsegment") == segment, F.lit(name)).otherwise(scope)
    value = (
        F.when(scope == "module", F.concat(F.lit("b"), key % 7, F.lit("/p1"), key % 10))
        .when(scope == "file", F.concat(F.lit("b"), key % 6, F.lit("/p"), key))
        .when(scope == "branch", F.concat(F.lit("branch"), key % 5))
    )
    return customers.join(last, key == F.col("o_custkey")).select(
        key.alias("id"), scope.alias("scope_type"), value.alias("scope_value"),
        F.when(key % 2 == 0, "active").otherwise("suspect").alias("status"), "last_verified_at",
    )


def last_order_date(spark: SparkSession, sf: str) -> Column:
    """The newest order date, the fixed "now" of the state queries."""
    return F.lit(read_table(spark, sf, "orders", "o_orderdate").agg(F.max("o_orderdate")).first()[0])


def claim_log(spark: SparkSession, sf: str) -> DataFrame:
    """Claim events: a customer's orders claim their parts; status P releases."""
    orders = read_table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    items = read_table(spark, sf, "lineitem", "l_orderkey", "l_suppkey", "l_partkey")
    files = items.groupBy("l_orderkey").agg(F.collect_set(part_path()).alias("files"))
    return orders.join(files, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("ticket"), F.concat(F.lit("dev"), F.col("o_custkey") % 20).alias("author"), "files",
        F.when(F.col("o_orderstatus") == "P", "released").otherwise("active").alias("status"),
        F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("seq"),
    )


def commit_messages(spark: SparkSession, sf: str) -> DataFrame:
    """(project, commit_hash, message, files) with file paths."""
    items = read_table(spark, sf, "lineitem", "l_orderkey", "l_suppkey", "l_partkey")
    files = items.groupBy(F.col("l_orderkey").alias("commit")).agg(F.collect_set(part_path()).alias("files"))
    return commits(spark, sf).join(files, "commit").select(
        F.lit("shop").alias("project"), F.col("commit").alias("commit_hash"), F.col("subject").alias("message"), "files"
    )


# ----------------------------------------------------------------- patches, code
def patch_sections(item: Callable[[str], Column]) -> Column:
    """The diff text of one line item, whose columns ``item`` gives by name.

    Line number mod 3 decides: 0 changes a body, 1 a signature, 2 removes a
    function.
    """
    part, supp, line = item("l_partkey"), item("l_suppkey"), item("l_linenumber")
    path = F.concat(F.lit("pkg/p"), part, F.lit(".py"))
    kind = line % 3
    old = F.when(kind == 0, F.concat(F.lit("-    return "), item("l_quantity").cast("int"))).otherwise(
        F.concat(F.lit("-def f"), supp, F.lit("(self, "), item("l_returnflag"), F.lit("):"))
    )
    new = (
        F.when(kind == 0, F.concat(F.lit("+    return "), item("l_quantity").cast("int") + 1))
        .when(kind == 1, F.concat(F.lit("+def f"), supp, F.lit("(self, "), item("l_returnflag"), F.lit(", "), item("l_linestatus"), F.lit("):")))
        .otherwise(F.lit("+++ gone"))
    )
    return F.concat(
        F.lit("diff --git a/"), path, F.lit(" b/"), path, F.lit("\n--- a/"), path, F.lit("\n+++ b/"), path,
        F.lit("\n@@ -"), line * 10, F.lit(",2 +"), line * 10, F.lit(",2 @@ class C"), supp, F.lit(":\n"),
        F.lit(" keep\n"), old, F.lit("\n"), new,
    )


def patches(spark: SparkSession, sf: str) -> DataFrame:
    """(patch_id, author, patch, fallback_file): one patch per order."""
    columns = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag", "l_linestatus")
    items = in_pieces(read_table(spark, sf, "lineitem", "l_orderkey", *columns), "l_orderkey", ITEMS_PER_PIECE)
    # Only the items' columns are shuffled and gathered; the far longer text is written row by row after that.
    orders = items.groupBy(F.col("l_orderkey").alias("patch_id")).agg(F.collect_list(F.struct(*columns)).alias("items"))
    in_order = F.array_sort(F.transform("items", lambda s: F.struct(*[s[c].alias(c) for c in columns[:4]], patch_sections(lambda c: s[c]).alias("text"))))
    return orders.select(
        "patch_id", F.array_join(F.transform(in_order, lambda s: s["text"]), "\n").alias("patch"), F.lit(None).cast("string").alias("fallback_file"),
    )


def code_files(spark: SparkSession, sf: str) -> DataFrame:
    """(path, content): one small Python or TypeScript source per part."""
    part = read_table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_type")
    n = part.count()
    key = F.col("p_partkey")
    folder = F.concat(F.lit("pkg/b"), F.regexp_extract("p_brand", r"(\d+)", 1))
    base = part.select(
        key.alias("k"), folder.alias("folder"), F.lower("p_type").alias("type"),
        F.initcap(F.split("p_name", " ")[0]).alias("w1"), F.initcap(F.split("p_name", " ")[1]).alias("w2"), "p_name",
    )
    other = base.select(F.col("k").alias("ok"), F.col("folder").alias("ofolder"), F.col("type").alias("otype"))
    joined = base.join(other, (F.col("k") * 7 + 1) % n == F.col("ok"))
    k, ok = F.col("k"), F.col("ok")
    cls = F.concat("w1", "w2", k)
    method = F.concat(F.lower("w1"), F.lit("_"), F.lower("w2"))
    target = F.concat(F.regexp_replace("ofolder", "/", "."), F.lit(".p"), ok)
    callee = F.concat(F.lit("make_"), "otype", F.lit("_"), ok)
    maker = F.concat(F.lit("make_"), "type", F.lit("_"), k)
    python = F.concat(
        F.lit("import os\nfrom "), target, F.lit(" import "), callee, F.lit("\n\n\nclass "), cls,
        F.lit(":\n    def "), method, F.lit("(self, size):\n        return "), callee, F.lit("(size)\n\n\ndef "),
        maker, F.lit('(size):\n    raise ValueError("unknown '), "p_name", F.lit(' value in part")\n'),
    )
    script = F.concat(
        F.lit('import { x } from "../'), F.regexp_replace("ofolder", "pkg/", ""), F.lit("/p"), ok, F.lit('";\n\nexport class '),
        cls, F.lit(" {}\nexport function "), maker, F.lit("(size) { return "), callee, F.lit("(size); }\n"),
    )
    is_script = k % 5 == 0
    path = F.concat("folder", F.lit("/p"), k, F.when(is_script, ".ts").otherwise(".py"))
    return joined.select(path.alias("path"), F.when(is_script, script).otherwise(python).alias("content"))
