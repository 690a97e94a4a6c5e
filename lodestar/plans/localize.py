"""From questions to ranked, explained documents with a reading plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import bm25, channels as C, fusion, signals as S
from ..operators.index import CorpusIndex
from ..operators.similarity import containing
from ..session import materialise


@dataclass
class Repository:
    """The tables a question is asked against; all keyed by ``doc``.

    files(doc, path, text, n_lines), index over its terms, defs(doc, symbol,
    kind), qualified(doc, qualified), literals(doc, literal), imports(src, dst)
    and history(doc, touches, recent, fixes). The last four may be missing.
    """

    files: DataFrame
    index: CorpusIndex
    defs: DataFrame
    qualified: DataFrame | None = None
    literals: DataFrame | None = None
    imports: DataFrame | None = None
    history: DataFrame | None = None


def channel_values(repo: Repository, issues: DataFrame, mentions: bool = True) -> DataFrame:
    """Stored long table (query_id, doc, channel, value) of all direct channels, positive values to six digits.

    ``mentions`` adds the channels fed by names, paths and stack frames in the
    text; corpora of plain prose can leave them out.
    """
    terms = materialise(bm25.issue_terms(issues), "issue-terms")
    idents = S.identifier_rows(issues)
    n = repo.index.n
    parts = {
        "api": bm25.api_channel(repo.defs, terms, n),
        "path_bm25": bm25.path_channel(repo.files, terms, n),
    }
    if repo.literals is not None:
        parts["literal"] = literal_values(repo, issues)
    if mentions:
        sig = materialise(S.issue_signals(issues), "signals")
        parts["module"] = C.module_channel(sig, repo.files)
        parts["literal_path"] = C.literal_path_channel(sig, repo.files)
        parts["traceback"] = C.traceback_channel(sig, repo.files)
        if repo.qualified is not None:
            parts["qualified"] = C.qualified_channel(sig, repo.qualified)
    text = bm25.text_channels(repo.index, terms).select(
        "query_id", "doc",
        F.explode(
            F.array(
                F.struct(F.lit("bm25").alias("channel"), F.col("value")),
                F.struct(F.lit("bm25_title").alias("channel"), F.col("title_value").alias("value")),
            )
        ).alias("c"),
    ).select("query_id", "doc", "c.channel", "c.value").where("value > 0")
    direct = C.union_channels(parts).unionByName(text)
    defined = C.definition_channels(repo.defs, idents, n).select("query_id", "doc", "channel", "value")
    return materialise(C.rounded_values(direct.unionByName(defined)), "channels")


def literal_values(repo: Repository, issues: DataFrame) -> DataFrame:
    """(query_id, doc, value) of the literal channel alone."""
    said = issues.select("query_id", X.normalised_lower(F.col("text")).alias("said"))
    contained = containing(
        repo.literals.select("literal").distinct(), "literal", F.col("literal"), said, "query_id", F.col("said")
    )
    return C.literal_channel(repo.literals, contained, repo.index.n)


def features(repo: Repository, issues: DataFrame, mentions: bool = True) -> DataFrame:
    """Wide feature rows of the candidate pool of each question."""
    values = channel_values(repo, issues, mentions)
    if repo.imports is not None:
        values = values.unionByName(C.neighbor_channel(values, repo.imports))
    pooled = pool_features(values, C.candidate_files(repo.files.select("doc", "path")).select("doc"), repo.files, issues)
    if repo.history is not None:
        pooled = C.with_history(pooled, repo.history)
    else:
        for name in ("hist_touch", "hist_recent", "hist_fix"):
            pooled = pooled.withColumn(name, F.lit(0.0))
    return pooled


def pool_features(values: DataFrame, eligible: DataFrame, files: DataFrame, issues: DataFrame) -> DataFrame:
    """The best candidates of stored, rounded channel values, normalised, with their path features."""
    # Ranks are over all documents; from here on only those that may be answers count.
    wide = C.widen(C.in_reach(values, materialise(eligible, "eligible")))
    words = bm25.issue_terms(issues).select("query_id", F.col("term").alias("word")).unionByName(
        S.identifier_rows(issues).select("query_id", F.col("ident").alias("word"))
    )
    return C.structural(C.pool(wide), files, words)


def score(feature_rows: DataFrame, weights: dict[str, float] | None = None, model: dict | None = None) -> DataFrame:
    """Adds ``score`` from a tree model or, by default, linear weights."""
    value = fusion.tree_score(model) if model else fusion.linear_score(weights or fusion.DEFAULT_WEIGHTS)
    return feature_rows.withColumn("score", F.round(value, 6))


def localize(
    repo: Repository, issues: DataFrame, k: int = 10, tiers: list[dict] | None = None,
    weights: dict[str, float] | None = None, model: dict | None = None, mentions: bool = True,
) -> DataFrame:
    """(query_id, rank, doc, path, score, why, confidence [, read_first]) of the best k.

    The margin behind the reading plan uses the whole pool, before the cut to k.
    """
    scored = materialise(score(features(repo, issues, mentions), weights, model), "scored")
    best = fusion.rank_scores(scored, k)
    out = best.select(
        "query_id", "rank", "doc", "path", "score", fusion.why(set(scored.columns)).alias("why")
    )
    if tiers is None:
        return out
    plan = fusion.reading_plan(fusion.margins(scored), tiers).select(
        "query_id", F.least("read_first", F.lit(k)).alias("read_first"), F.col("confidence").alias("_c"), "margin"
    )
    return out.join(plan, "query_id").withColumn(
        "confidence", F.when(F.col("rank") <= F.col("read_first"), F.col("_c")).otherwise("low")
    ).drop("_c")


def with_fallback(questions: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Answers of the first ranker, and of the second for questions the first left without any.

    Both are (query_id, path, score, rank); ``source`` tells which one answered.
    """
    columns = ["query_id", "path", "score", "rank"]
    answered = first.join(questions.select("query_id"), "query_id", "left_semi").select(*columns, F.lit("first").alias("source"))
    empty = questions.select("query_id").join(first.select("query_id").distinct(), "query_id", "left_anti")
    return answered.unionByName(second.join(empty, "query_id", "left_semi").select(*columns, F.lit("fallback").alias("source")))


def calibrate(repo: Repository, issues: DataFrame, gold: DataFrame, target: float = fusion.TARGET_HIT, **kw) -> list[dict]:
    """Reading-plan tiers fitted on questions with known answers."""
    return fusion.fit_tiers(results(score(features(repo, issues, **kw)), gold), target)


def results(scored: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, margin, gold_rank) for the questions that have an answer."""
    scored = materialise(scored.select("query_id", "doc", "path", "score"), "scores")
    asked = gold.select("query_id").distinct()
    margin = fusion.margins(scored).select("query_id", F.coalesce("margin", F.lit(0.0)).alias("margin"))
    ranks = gold_ranks(scored, gold)
    return (
        asked.join(margin, "query_id", "left").join(ranks, "query_id", "left")
        .select("query_id", F.coalesce("margin", F.lit(0.0)).alias("margin"), "gold_rank")
    )


def gold_ranks(scored: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, gold_rank) within pools of at most 300 documents."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("path"))
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return fusion.gold_ranks(ranked, gold)
