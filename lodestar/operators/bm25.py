"""BM25 retrieval: one kernel, several weightings."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X
from ..session import materialise
from .index import CorpusIndex, idf
from .skew import ROWS_PER_SALT, salted_join, top_k

# --- Fixed values. ---
SEARCH_K1 = 1.5
CHANNEL_K1 = 1.2
B = 0.75
TEST_FILE_PENALTY = 0.3
TITLE_FACTOR = 1.5
API_DEFS_SCALE = 20
# --- End of fixed values. ---
#: Postings times the queries that ask for them, which one task adds up.
CONTRIBUTIONS_PER_PIECE = 4_000_000


def tf_part(tf: Column, dl: Column, avgdl: float, k1: float, b: float = B) -> Column:
    """Saturated, length-normalised term frequency."""
    norm = F.lit(1.0 - b) + F.lit(b) * (dl / F.lit(avgdl)) if avgdl > 0 else F.lit(1.0)
    return tf * F.lit(k1 + 1.0) / (tf + F.lit(k1) * norm)


def contributions(
    index: CorpusIndex, query_terms: DataFrame, k1: float = SEARCH_K1, b: float = B,
    rows_per_salt: int = ROWS_PER_SALT, keep: tuple[str, ...] = (),
) -> DataFrame:
    """(query_id, doc, term, contribution, kept columns) for query_terms(query_id, term, weight).

    Terms absent from the corpus drop out in the join with the term table, so
    only useful terms meet the postings. Very frequent terms are salted. The
    postings asked for are dealt by document into pieces of bounded work, so a
    task sums up whole documents and its memory does not grow with the index.
    """
    # Stored, so that the join with the postings is planned by the size the terms really have.
    weighted = materialise(query_terms.join(index.terms, "term").select(
        "query_id", "term", (F.col("weight") * idf(F.col("df"), index.n)).alias("w"), "df", *keep
    ), "weighted")
    expected = weighted.agg(F.sum("df")).first()[0] or 0
    weighted = weighted.drop("df")
    pieces = max(weighted.sparkSession.sparkContext.defaultParallelism, math.ceil(expected / CONTRIBUTIONS_PER_PIECE))
    asked = index.postings.join(weighted.select("term").distinct(), "term", "left_semi").repartition(pieces, "doc")
    counts = index.terms.select("term", F.col("df").alias("n"))
    joined = salted_join(
        asked, weighted, "term", "doc", counts, index.total_postings, rows_per_salt
    )
    score = F.col("w") * tf_part(F.col("tf"), F.col("dl"), index.avgdl, k1, b)
    return joined.select("query_id", "doc", "term", score.alias("contribution"), *keep)


def scores(index: CorpusIndex, query_terms: DataFrame, k1: float = SEARCH_K1, **kw) -> DataFrame:
    """(query_id, doc, score, n_terms); partial sums are formed before the shuffle."""
    return contributions(index, query_terms, k1, **kw).groupBy("query_id", "doc").agg(
        F.sum("contribution").alias("score"), F.count(F.lit(1)).alias("n_terms")
    )


def search_terms(queries: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, term, weight = count) of the query text."""
    rows = X.code_token_rows(queries, F.col(text), "query_id")
    return rows.groupBy("query_id", "term").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def search(
    index: CorpusIndex, queries: DataFrame, k: int = 10, penalised: Column | None = None,
    penalised_docs: DataFrame | None = None,
) -> DataFrame:
    """(query_id, doc, score, rank): the k best documents per query.

    ``penalised_docs`` (doc) lists test-like documents whose summed score is
    multiplied by 0.3; ``penalised`` is the same as a predicate on ``doc``.
    """
    found = scores(index, search_terms(queries))
    if penalised_docs is not None:
        flagged = penalised_docs.select("doc", F.lit(True).alias("_test"))
        found = found.join(flagged, "doc", "left")
        penalised = F.col("_test")
    if penalised is not None:
        found = found.withColumn(
            "score", F.when(penalised, F.col("score") * TEST_FILE_PENALTY).otherwise(F.col("score"))
        )
    found = found.select("query_id", "doc", F.round("score", 6).alias("score"))
    return top_k(found, ["query_id"], [F.desc("score"), F.asc("doc")], k)


def explain(index: CorpusIndex, queries: DataFrame, best: DataFrame, parts: int = 3) -> DataFrame:
    """Adds ``matched_terms``: the query terms that gave most of each score.

    Only the k x |query| pairs of the answer are looked at again.
    """
    terms = search_terms(queries).join(index.terms, "term").select(
        "query_id", "term", (F.col("weight") * idf(F.col("df"), index.n)).alias("w")
    )
    wanted = best.select("query_id", "doc").join(terms, "query_id")
    hits = wanted.join(index.postings, ["doc", "term"]).select(
        "query_id", "doc", "term",
        F.round(F.col("w") * tf_part(F.col("tf"), F.col("dl"), index.avgdl, SEARCH_K1), 6).alias("c"),
    )
    first = top_k(hits, ["query_id", "doc"], [F.desc("c"), F.asc("term")], parts, "_r")
    named = first.groupBy("query_id", "doc").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_r", "term"))), lambda s: s["term"]), ","
        ).alias("matched_terms")
    )
    return best.join(named, ["query_id", "doc"])


# --------------------------------------------------------- channel weightings
def issue_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf, in_title) from query_id, title and text."""
    body = X.code_term_rows(queries, F.col("text"), "query_id").withColumn("t", F.lit(0))
    title = X.code_term_rows(queries, F.col("title"), "query_id").withColumn("t", F.lit(1))
    return body.unionByName(title).groupBy("query_id", "term").agg(
        F.count_if(F.col("t") == 0).alias("qtf"), (F.max("t") == 1).alias("in_title")
    ).where("qtf > 0")


def log_tf(qtf: Column) -> Column:
    return F.lit(1.0) + F.log(qtf.cast("double"))


def text_channels(index: CorpusIndex, terms: DataFrame) -> DataFrame:
    """(query_id, doc, value, title_value): text BM25, title terms counted 1.5 times.

    The title score is the title terms' share of the same sum, so both come from
    one join with the postings.
    """
    weight = log_tf(F.col("qtf")) * F.when(F.col("in_title"), F.lit(TITLE_FACTOR)).otherwise(F.lit(1.0))
    weighted = terms.select("query_id", "term", weight.alias("weight"), "in_title")
    parts = contributions(index, weighted, CHANNEL_K1, keep=("in_title",))
    return parts.groupBy("query_id", "doc").agg(
        F.sum("contribution").alias("value"),
        F.coalesce(F.sum(F.when(F.col("in_title"), F.col("contribution"))), F.lit(0.0)).alias("title_value"),
    )


def text_channel(index: CorpusIndex, terms: DataFrame, title_only: bool = False) -> DataFrame:
    """(query_id, doc, value): one of the two text channels."""
    used = terms.where("in_title") if title_only else terms
    return text_channels(index, used).select("query_id", "doc", "value")


def path_term_rows(files: DataFrame) -> DataFrame:
    """Distinct (doc, term) of the dotted module path of each file."""
    spaced = F.regexp_replace(P.module_of(F.col("path")), r"\.", " ")
    return X.code_term_rows(files.select("doc", spaced.alias("m")), F.col("m"), "doc").distinct()


def path_channel(files: DataFrame, terms: DataFrame, n: int) -> DataFrame:
    """(query_id, doc, value): issue terms in the module path, weighted by rarity."""
    rows = path_term_rows(files)
    df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighted = materialise(terms.join(df, "term").select(
        "query_id", "term",
        (F.log(1.0 + F.lit(float(n)) / F.col("df")) * log_tf(F.col("qtf"))).alias("w"),
    ), "path-weights")
    return rows.join(weighted, "term").groupBy("query_id", "doc").agg(F.sum("w").alias("value"))


def api_channel(defs: DataFrame, terms: DataFrame, n: int) -> DataFrame:
    """(query_id, doc, value): issue terms among the parts of defined names.

    ``defs`` is (doc, symbol, kind). Terms found in half of the files or more
    say nothing and are left out before the join.
    """
    rows = X.code_term_rows(defs, F.col("symbol"), "doc").distinct()
    sizes = defs.groupBy("doc").agg(F.count_distinct("symbol").alias("n_defs"))
    df = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") < n / 2)
    weighted = materialise(terms.join(df, "term").select(
        "query_id", "term", (idf(F.col("df"), n) * log_tf(F.col("qtf"))).alias("w")
    ), "api-weights")
    damp = F.sqrt(1.0 + F.col("n_defs") / F.lit(float(API_DEFS_SCALE)))
    hits = rows.join(weighted, "term").groupBy("query_id", "doc").agg(F.sum("w").alias("w"))
    return hits.join(sizes, "doc").select("query_id", "doc", (F.col("w") / damp).alias("value"))
