"""Queries: tokenisers, text and path predicates, similarity, lookups and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X
from ..operators import evidence, resolve, similarity
from ..operators import signals as S
from ..operators import bm25
from ..operators.skew import latest
from ..session import materialise, read_table, spread
from . import sources as D


def _part_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    part = read_table(spark, sf, "part", "p_partkey", "p_name", "p_type", "p_brand")
    words = F.split("p_name", " ")
    ident = F.concat(
        F.initcap(words[0]), F.initcap(words[1]), "p_type", F.lit("_"), F.lower("p_type"), F.lit("_v"), F.col("p_partkey")
    )
    return part.select("p_partkey", ident.alias("ident"))


def camel_tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.code_token_rows(_part_identifiers(spark, sf), F.col("ident"), "p_partkey")
    return rows.groupBy("p_partkey", "term").agg(F.count(F.lit(1)).alias("cnt"))


def code_terms(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.code_term_rows(_part_identifiers(spark, sf), F.col("ident"), "p_partkey")
    return rows.groupBy("p_partkey", "term").agg(F.count(F.lit(1)).alias("cnt"))


def document_token_sets(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(read_table(spark, sf, "documents", "doc_id", "text"), "doc_id")
    rows = X.set_token_rows(docs, F.col("text"), "doc_id")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.min("term").alias("first_term"))


def keyword_sets(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "conversations", "conv_id", "turn", "text")
    return rows.select("conv_id", "turn", F.array_join(F.array_sort(X.keyword_set(F.col("text"))), " ").alias("keywords"))


def index_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(read_table(spark, sf, "documents", "doc_id", "text"), "doc_id")
    return docs.select("doc_id", F.explode(X.index_identifiers(F.col("text"))).alias("ident")).groupBy("ident").agg(
        F.count(F.lit(1)).alias("df")
    )


def keyword_weights(spark: SparkSession, sf: str) -> DataFrame:
    return S.weighted_terms(D.issues(spark, sf)).select("query_id", "term", F.round("weight", 6).alias("weight"))


def conversation_weights(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "conversations", "conv_id", "turn", "text")
    keyed = rows.select(F.concat_ws(":", "conv_id", "turn").alias("query_id"), "text")
    return S.weighted_terms(keyed).select("query_id", "term", F.round("weight", 6).alias("weight"))


def title_body_split(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(read_table(spark, sf, "documents", "doc_id", "text"), "doc_id")
    return docs.select("doc_id", X.title_of(F.col("text")).alias("title"), F.length("text").alias("body_length"))


def document_literals(spark: SparkSession, sf: str) -> DataFrame:
    return D.literals(D.corpus(spark, sf)).groupBy("literal").agg(F.count(F.lit(1)).alias("files"))


def _url_paths(spark: SparkSession, sf: str) -> DataFrame:
    pages = read_table(spark, sf, "pages", "page_id", "url")
    return pages.select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("path"))


def url_path_functions(spark: SparkSession, sf: str) -> DataFrame:
    path = F.col("path")
    return _url_paths(spark, sf).select(
        "page_id", P.module_of(path).alias("module"), P.stem(path).alias("stem"), P.depth(path).cast("int").alias("depth"),
        F.coalesce(P.directory(path), F.lit("")).alias("directory"), P.top_dir(path).alias("top"),
    )


def path_predicates(spark: SparkSession, sf: str) -> DataFrame:
    path = F.col("path")
    return D.corpus(spark, sf).select(
        "doc", P.is_test_index(path).alias("test_index"), P.is_test_localizer(path).alias("test_localizer"),
        P.is_test_prior(path).alias("test_prior"), P.is_test_penalty(path).alias("test_penalty"),
        P.is_generated(path).alias("generated"), P.language(path).alias("language"), P.diff_language(path).alias("diff_language"),
    )


def test_to_source(spark: SparkSession, sf: str) -> DataFrame:
    files = D.corpus(spark, sf).select("doc", F.concat(F.lit("pkg/tests/test_"), "doc", F.lit(".py")).alias("p"), "path")
    return files.select(
        "doc", F.array_join(P.test_to_source(F.col("p")), ",").alias("nested"),
        F.array_join(P.test_to_source(F.col("path")), ",").alias("own"),
    )


def ticket_id_extract(spark: SparkSession, sf: str) -> DataFrame:
    orders = read_table(spark, sf, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus")
    text = F.when(
        F.col("o_orderstatus") == "F", F.concat(F.lit("Ticket #"), "o_orderkey", F.lit(" closed"))
    ).when(
        F.col("o_orderstatus") == "O", F.concat(F.lit("see issue "), "o_orderkey", F.lit(": "), "o_orderpriority")
    ).otherwise(F.concat(F.lit("order "), "o_orderkey"))
    return orders.select("o_orderkey", X.ticket_id(text).alias("ticket_id"))


def _event_messages(spark: SparkSession, sf: str) -> DataFrame:
    events = read_table(spark, sf, "events", "event_id", "event_type", "user_id")
    prefix = (
        F.when(F.col("event_type") == "error", "Revert \"").when(F.col("event_type") == "click", "fix: ")
        .when(F.col("event_type") == "view", "feat: ").when(F.col("event_type") == "signup", "refactor: ").otherwise("docs: ")
    )
    return events.select("event_id", F.concat(prefix, F.lit("change for user "), "user_id").alias("message"))


def commit_classify(spark: SparkSession, sf: str) -> DataFrame:
    return _event_messages(spark, sf).select("event_id", X.classify_commit(F.col("message")).alias("classification"))


def traceback_frames(spark: SparkSession, sf: str) -> DataFrame:
    events = read_table(spark, sf, "events", "event_id", "event_type", "user_id")
    text = F.concat(
        F.lit('Traceback\n  File "src/m'), F.col("user_id"), F.lit('.py", line 3, in run_'), "event_type",
        F.lit('\n  File "lib/base.py", line 9, in call\nlib/u'), F.col("user_id"), F.lit(".js:10:2 failed"),
    )
    return events.select("event_id", F.posexplode(S.frames(text)).alias("pos", "f")).select(
        "event_id", "pos", F.col("f.path").alias("path"), F.col("f.func").alias("func")
    )


def superseded(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(read_table(spark, sf, "documents", "doc_id", "text", "lang"), "doc_id")
    return similarity.superseded_by(docs, "doc_id", F.col("text"), "lang").select(
        "old_id", "new_id", F.round("similarity", 3).alias("similarity")
    )


def similar_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(read_table(spark, sf, "documents", "doc_id", "text"), "doc_id")
    return similarity.similar_top(docs, "doc_id", F.col("text"))


def longest_prefix_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """URL modules looked up among all shorter modules of the same table."""
    pages = _url_paths(spark, sf).select(P.module_of(F.col("path")).alias("name")).distinct()
    modules = pages.select(F.regexp_replace("name", r"\.[^.]*$", "").alias("module")).distinct().withColumn(
        "target", F.col("module")
    )
    return resolve.resolve_modules(pages, modules)


def suffix_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Paths mentioned with extra leading folders resolve to the longest known suffix."""
    files = D.corpus(spark, sf).select("path")
    mentions = files.select(F.concat(F.lit("site-packages/x/"), "path").alias("mention"))
    return resolve.resolve_path_suffixes(mentions, files)


def first_match_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Documents resolve to their label, else to their first copy's label."""
    labels = read_table(spark, sf, "labels", "doc_id", "quality")
    docs = read_table(spark, sf, "documents", "doc_id", "lang")
    asked = docs.select("doc_id", "lang")
    candidates = F.array("doc_id", F.col("doc_id") - 1, F.col("doc_id") - 2)
    return resolve.first_match(asked, candidates, labels, "doc_id", ["doc_id", "lang"], "quality")


def anti_changed(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without a label: the ones a cache would have to analyse again."""
    docs = read_table(spark, sf, "documents", "doc_id", "n_chars")
    return docs.join(read_table(spark, sf, "labels", "doc_id"), "doc_id", "left_anti")


def semi_split(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with items, by status: a split by the ids of another table."""
    orders = read_table(spark, sf, "orders", "o_orderkey", "o_orderstatus")
    used = read_table(spark, sf, "lineitem", "l_orderkey").withColumnRenamed("l_orderkey", "o_orderkey")
    return orders.join(used, "o_orderkey", "left_semi").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def first_per_instance(spark: SparkSession, sf: str) -> DataFrame:
    """De-duplicate by text, first id wins."""
    docs = read_table(spark, sf, "documents", "doc_id", "text", "source")
    keyed = docs.select("doc_id", F.md5("text").alias("instance"), "source")
    return latest(keyed, ["instance"], [-F.col("doc_id")]).select("doc_id", "instance", "source")


def gold_language(spark: SparkSession, sf: str) -> DataFrame:
    """Majority language of the right documents of each question; ties by name."""
    lang = read_table(spark, sf, "documents", "doc_id", "lang").withColumnRenamed("doc_id", "doc")
    votes = D.gold(spark, sf).join(lang, "doc").groupBy("query_id", "lang").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("query_id").agg(F.min_by("lang", F.struct(-F.col("n"), F.col("lang"))).alias("lang"))


def compact_texts(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(read_table(spark, sf, "documents", "doc_id", "text"), "doc_id")
    return docs.select("doc_id", F.md5(X.compact(F.col("text"), 240)).alias("digest"))


def evidence_windows(spark: SparkSession, sf: str) -> DataFrame:
    issues = D.issues(spark, sf)
    best = materialise(bm25.search(D.token_index(spark, sf), issues).select("query_id", "doc"), "best")
    docs = D.corpus(spark, sf).select("doc", "text")
    terms = bm25.issue_terms(issues).select("query_id", "term")
    picked = evidence.pick_windows(evidence.window_scores(best, docs, terms))
    return picked.select("query_id", "doc", F.array_join("starts", ",").alias("starts"))


def evidence_window_hits(spark: SparkSession, sf: str) -> DataFrame:
    issues = D.issues(spark, sf)
    best = materialise(bm25.search(D.token_index(spark, sf), issues).select("query_id", "doc"), "best")
    docs = D.corpus(spark, sf).select("doc", "text")
    return evidence.window_scores(best, docs, bm25.issue_terms(issues).select("query_id", "term"))


def evidence_outline(spark: SparkSession, sf: str) -> DataFrame:
    issues, files = D.issues(spark, sf), D.corpus(spark, sf)
    best = materialise(bm25.search(D.token_index(spark, sf), issues).select("query_id", "doc"), "best")
    return evidence.outline(D.definitions(files), best, S.identifier_rows(issues))


QUERIES = {f.__name__: f for f in (
    camel_tokens, code_terms, document_token_sets, keyword_sets, index_identifiers, keyword_weights, conversation_weights,
    title_body_split, document_literals, url_path_functions, path_predicates, test_to_source, ticket_id_extract,
    commit_classify, traceback_frames, superseded, similar_documents, longest_prefix_lookup, suffix_lookup,
    first_match_lookup, anti_changed, semi_split, first_per_instance, gold_language, compact_texts, evidence_windows,
    evidence_window_hits, evidence_outline,
)}
