"""Queries: indexes, retrieval, channels, fusion, calibration and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import bm25, channels as C, crossval, fusion, index, metrics, ml, predictor, similarity
from ..operators import signals as S
from ..operators.skew import top_k
from ..session import materialise, read_table
from . import localize as L
from . import sources as D


def r6(name: str):
    return F.round(name, 6).alias(name)


def term_stats(spark: SparkSession, sf: str) -> DataFrame:
    idx = D.token_index(spark, sf)
    totals = idx.postings.groupBy("term").agg(F.sum("tf").alias("cf"))
    return idx.terms.join(totals, "term").select("term", "df", "cf")


def idf_table(spark: SparkSession, sf: str) -> DataFrame:
    return D.token_index(spark, sf).idf().select("term", "df", r6("idf"))


def doc_lengths(spark: SparkSession, sf: str) -> DataFrame:
    idx = D.token_index(spark, sf)
    return idx.documents.select("doc", "dl", F.round(F.col("dl") / idx.avgdl, 6).alias("relative"))


def boosted_terms(spark: SparkSession, sf: str) -> DataFrame:
    files = D.corpus(spark, sf).select(
        "path", F.transform(D.line_starts(F.col("text")), lambda w: w).alias("symbols"), F.col("text").alias("content")
    )
    rows = index.boosted_rows(files.repartition("path"))
    return index.term_frequencies(rows, "path", F.col("weight")).select(F.col("doc").alias("path"), "term", "tf", "dl")


def legacy_stats(spark: SparkSession, sf: str) -> DataFrame:
    idx = D.legacy_index(spark, sf)
    return idx.terms.select("term", "df", F.lit(idx.n).alias("n"), F.round(F.lit(idx.avgdl), 6).alias("avgdl"))


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.search(D.token_index(spark, sf), D.issues(spark, sf))


def bm25_explain(spark: SparkSession, sf: str) -> DataFrame:
    idx, issues = D.token_index(spark, sf), D.issues(spark, sf)
    best = materialise(bm25.search(idx, issues), "best")
    return bm25.explain(idx, issues, best)


def bm25_test_penalty(spark: SparkSession, sf: str) -> DataFrame:
    tests = D.corpus(spark, sf).where(P.is_test_index(F.col("path"))).select("doc")
    return bm25.search(D.token_index(spark, sf), D.issues(spark, sf), penalised_docs=tests)


def _issue_terms(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.issue_terms(D.issues(spark, sf))


def _top(values: DataFrame, k: int = 20) -> DataFrame:
    return top_k(
        values.select("query_id", "doc", r6("value")), ["query_id"], [F.desc("value"), F.asc("doc")], k
    )


def bm25_title_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return _top(bm25.text_channel(D.term_index(spark, sf), _issue_terms(spark, sf)))


def bm25_title_only(spark: SparkSession, sf: str) -> DataFrame:
    return _top(bm25.text_channel(D.term_index(spark, sf), _issue_terms(spark, sf), title_only=True))


def path_bm25(spark: SparkSession, sf: str) -> DataFrame:
    n = D.term_index(spark, sf).n
    return bm25.path_channel(D.corpus(spark, sf), _issue_terms(spark, sf), n).select("query_id", "doc", r6("value"))


def api_bm25(spark: SparkSession, sf: str) -> DataFrame:
    n = D.term_index(spark, sf).n
    return _top(bm25.api_channel(D.definition_table(spark, sf), _issue_terms(spark, sf), n))


def _mentions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return S.issue_signals(D.failure_reports(spark, sf)), D.corpus(spark, sf).select("doc", "path")


def traceback_channel(spark: SparkSession, sf: str) -> DataFrame:
    """Files named by the stack frames of every failure report."""
    return C.traceback_channel(*_mentions(spark, sf)).select("query_id", "doc", r6("value"))


def literal_path_channel(spark: SparkSession, sf: str) -> DataFrame:
    """Files whose path every failure report spells out."""
    return C.literal_path_channel(*_mentions(spark, sf)).select("query_id", "doc", r6("value"))


def module_channel(spark: SparkSession, sf: str) -> DataFrame:
    """Files behind the dotted names of every failure report."""
    return C.module_channel(*_mentions(spark, sf)).select("query_id", "doc", r6("value"))


def definition_channel(spark: SparkSession, sf: str) -> DataFrame:
    n = D.term_index(spark, sf).n
    defs = D.definition_table(spark, sf)
    return C.definition_channels(defs, S.identifier_rows(D.issues(spark, sf)), n).select(
        "query_id", "doc", "channel", r6("value")
    )


def _imports(spark: SparkSession, sf: str) -> DataFrame:
    ids = D.corpus(spark, sf).select(F.col("doc").alias("src"))
    return D.sparse_edges(spark, sf).where("src < dst").join(ids, "src", "left_semi").join(
        ids.withColumnRenamed("src", "dst"), "dst", "left_semi"
    ).select("src", "dst")


def _repo(spark: SparkSession, sf: str, graph: bool = False) -> L.Repository:
    files = D.corpus(spark, sf)
    imports = history = None
    if graph:
        imports = _imports(spark, sf)
        history = D.file_history(spark, sf)
    return L.Repository(
        files, D.term_index(spark, sf), D.definition_table(spark, sf), literals=D.literal_table(spark, sf), imports=imports, history=history
    )


def literal_channel(spark: SparkSession, sf: str) -> DataFrame:
    return L.literal_values(_repo(spark, sf), D.issues(spark, sf)).select("query_id", "doc", r6("value"))


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return C.normalise(L.channel_values(_repo(spark, sf), D.issues(spark, sf), mentions=False), rounded=True)


def channel_normalise(spark: SparkSession, sf: str) -> DataFrame:
    rows = _features(spark, sf)
    return rows.select("query_id", "channel", "doc", r6("value"), r6("n"), r6("rr"))


DIRECT = ("bm25", "bm25_title", "path_bm25", "api", "defs", "defs_class", "literal")


def channel_pivot(spark: SparkSession, sf: str) -> DataFrame:
    wide = C.widen(_features(spark, sf), DIRECT)
    return wide.select("query_id", "doc", *[r6(f"{c}_{s}") for c in DIRECT for s in ("n", "rr")])


def candidate_pool(spark: SparkSession, sf: str) -> DataFrame:
    """The pool of every question; only ranks that can lead into it are counted."""
    eligible = materialise(C.candidate_files(D.corpus(spark, sf)).select("doc"), "eligible")
    rows = C.leading(L.channel_values(_repo(spark, sf), D.issues(spark, sf), mentions=False), eligible, rounded=True)
    best = rows.join(eligible, "doc", "left_semi").groupBy("query_id", "doc").agg(F.max("rr").alias("best_rr"))
    return C.pool(best).select("query_id", "doc", r6("best_rr"), "pool_rank")


def neighbour_propagation(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence one edge away from the text matches, which are the only channel it is made of."""
    text = bm25.text_channel(D.term_index(spark, sf), _issue_terms(spark, sf)).withColumn("channel", F.lit("bm25"))
    base = C.relative(materialise(text, "text-channel")).select("query_id", "doc", F.col("n").alias("value"))
    rows = C.neighbor_rows(C.neighbor_values(base, _imports(spark, sf)))
    return rows.select("query_id", "doc", r6("value"), r6("rr"))


def structural_features(spark: SparkSession, sf: str) -> DataFrame:
    issues, files = D.issues(spark, sf), D.corpus(spark, sf)
    pairs = bm25.search(D.token_index(spark, sf), issues).select("query_id", "doc")
    words = S.identifier_rows(issues).select("query_id", F.col("ident").alias("word"))
    return C.structural(pairs, files, words).select(
        "query_id", "doc", "path", "is_init", "is_generic", "non_package", "depth", r6("log_lines"), "stem_in_issue"
    )


def history_counters(spark: SparkSession, sf: str) -> DataFrame:
    return D.file_history(spark, sf).select("doc", "touches", "recent", "fixes")


def _scored(spark: SparkSession, sf: str, model: dict | None = None, graph: bool = False) -> DataFrame:
    rows = L.features(_repo(spark, sf, graph), D.issues(spark, sf), mentions=False)
    return L.score(rows, model=model)


# A small fixed ensemble in the exported format, to exercise both evaluators.
DEMO_MODEL = {
    "features": ["bm25_n", "bm25_title_n", "defs_n", "literal_n", "path_bm25_n", "depth"],
    "trees": [
        [0, 0.5, [1, 0.25, -0.5, 0.1], [2, 0.1, 0.75, 1.5]],
        [3, 0.0, -0.25, [3, 0.5, 0.5, 2.0]],
        [4, 0.9, 0.0, [5, 1.0, 0.05, 0.15]],
    ],
}


def linear_score(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.rank_scores(_scored(spark, sf).select("query_id", "doc", "path", "score"), 20).drop("path")


def tree_score(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.rank_scores(_scored(spark, sf, DEMO_MODEL).select("query_id", "doc", "path", "score"), 20).drop("path")


def tree_score_batched(spark: SparkSession, sf: str) -> DataFrame:
    rows = L.features(_repo(spark, sf), D.issues(spark, sf), mentions=False)
    score = fusion.tree_score_udf(DEMO_MODEL)(*[F.col(f) for f in DEMO_MODEL["features"]])
    return fusion.rank_scores(rows.select("query_id", "doc", "path", F.round(score, 6).alias("score")), 20).drop("path")


def localize(spark: SparkSession, sf: str) -> DataFrame:
    return L.localize(_repo(spark, sf, graph=True), D.issues(spark, sf), k=10)


def localize_with_plan(spark: SparkSession, sf: str) -> DataFrame:
    repo, issues = _repo(spark, sf, graph=True), D.issues(spark, sf)
    scored = materialise(L.score(L.features(repo, issues)), "scored")
    tiers = fusion.fit_tiers(L.results(scored, D.gold(spark, sf)))
    plan = fusion.reading_plan(fusion.margins(scored), tiers)
    best = fusion.rank_scores(scored, 10).select("query_id", "rank", "doc", "score")
    return best.join(plan, "query_id").select(
        "query_id", "rank", "doc", "score",
        F.when(F.col("rank") <= F.least("read_first", F.lit(10)), F.col("confidence")).otherwise("low").alias("confidence"),
    )


def _bm25_scored(spark: SparkSession, sf: str) -> DataFrame:
    idx, issues = D.token_index(spark, sf), D.issues(spark, sf)
    return bm25.search(idx, issues, k=C.MAX_CANDIDATES).select("query_id", "doc", "score", "rank")


def top2_margin(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.margins(_bm25_scored(spark, sf)).select("query_id", F.round("margin", 6).alias("margin"), "n")


def _results(spark: SparkSession, sf: str) -> DataFrame:
    """Every question's margin and the rank of its first right document."""
    scored = materialise(_bm25_scored(spark, sf), "bm25")
    ranks = fusion.gold_ranks(scored, D.gold(spark, sf))
    rows = fusion.margins(scored).select("query_id", F.round(F.coalesce("margin", F.lit(0.0)), 6).alias("margin"))
    return materialise(rows.join(ranks, "query_id", "left"), "results")


def tier_calibration(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.tier_table(_results(spark, sf), target=0.5)


def reading_plan(spark: SparkSession, sf: str) -> DataFrame:
    results = _results(spark, sf)
    tiers = fusion._sorted(fusion.tier_table(results, target=0.5))
    return fusion.reading_plan(results.withColumn("n", F.lit(C.MAX_CANDIDATES)), tiers)


def holdout_check(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.holdout_check(_results(spark, sf), [F.desc("query_id")], target=0.5)


def hit_recall_ap(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.rank_metrics(bm25_topk(spark, sf), D.gold(spark, sf))


def metrics_summary(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.summarise(hit_recall_ap(spark, sf))


def _by_lang(spark: SparkSession, sf: str) -> DataFrame:
    gold = D.gold(spark, sf)
    lang = read_table(spark, sf, "documents", "doc_id", "lang").withColumnRenamed("doc_id", "doc")
    repo = gold.join(lang, "doc").groupBy("query_id").agg(F.min("lang").alias("lang"))
    return metrics.rank_metrics(bm25_topk(spark, sf), gold).join(repo, "query_id")


def micro_macro_worst(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.micro_macro_worst(_by_lang(spark, sf), "lang")


def grouping_lang_tier(spark: SparkSession, sf: str) -> DataFrame:
    results = _results(spark, sf)
    tiers = fusion._sorted(fusion.tier_table(results, target=0.5))
    plan = fusion.reading_plan(results.withColumn("n", F.lit(C.MAX_CANDIDATES)), tiers).select("query_id", "confidence")
    rows = _by_lang(spark, sf).join(plan, "query_id")
    return metrics.with_totals(
        rows, "lang", "confidence", F.count(F.lit(1)).alias("n"), F.round(F.avg("hit_10"), 6).alias("hit_rate")
    )


def containment_join(spark: SparkSession, sf: str) -> DataFrame:
    return D.gold(spark, sf)


def predict_with_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Files that hold a question's literals, or else the symbol index's answers."""
    paths = D.corpus(spark, sf).select("doc", "path")
    found = literal_channel(spark, sf).join(paths, "doc").select("query_id", "path", F.col("value").alias("score"))
    first = top_k(found, ["query_id"], [F.desc("score"), F.asc("path")], 10)
    return L.with_fallback(D.issues(spark, sf), first, symbol_bm25(spark, sf))


def symbol_bm25(spark: SparkSession, sf: str) -> DataFrame:
    idx = D.legacy_index(spark, sf)
    scored = predictor.symbol_scores(idx, S.weighted_terms(D.issues(spark, sf)))
    return top_k(
        scored.select("query_id", F.col("doc").alias("path"), r6("score"), "n_symbols", "n_identifiers"),
        ["query_id"], [F.desc("score"), F.asc("path")], 10,
    )


def predict_files(spark: SparkSession, sf: str) -> DataFrame:
    files = D.corpus(spark, sf).select("path")
    return predictor.predict(files, D.legacy_index(spark, sf), D.issues(spark, sf)).select(
        "query_id", "path", "score", "confidence", "rank"
    )


def predict_with_impact(spark: SparkSession, sf: str) -> DataFrame:
    files = D.corpus(spark, sf).select("doc", "path")
    idx = D.legacy_index(spark, sf)
    ids = files.select("doc", "path")
    edges = (
        D.sparse_edges(spark, sf).join(ids.select(F.col("doc").alias("src"), F.col("path").alias("sp")), "src")
        .join(ids.select(F.col("doc").alias("dst"), F.col("path").alias("dp")), "dst")
        .select(F.col("sp").alias("src"), F.col("dp").alias("dst"), F.lit("import").alias("kind"), F.lit(1.0).alias("weight"))
    )
    return predictor.predict_with_impact(files.select("path"), idx, D.issues(spark, sf), edges)


def cosine_rerank(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    centres = _centroids(rows)
    scored = rows.join(centres, "label").select(
        F.col("label").alias("query_id"), F.col("vec_id").alias("doc"),
        F.round(similarity.clipped(similarity.cosine(F.col("embedding"), F.col("centre"))), 5).alias("similarity"),
    )
    return top_k(scored, ["query_id"], [F.desc("similarity"), F.asc("doc")], 10)


def _centroids(rows: DataFrame) -> DataFrame:
    """(label, centre): mean vector per label, one partial sum per position."""
    flat = rows.select("label", F.posexplode("embedding").alias("i", "x"))
    means = flat.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centre")
    )


def semantic_blend(spark: SparkSession, sf: str) -> DataFrame:
    best = bm25_topk(spark, sf)
    vectors = read_table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    centres = _centroids(vectors)
    queries = best.select("query_id").distinct().join(centres, F.col("query_id") % 10 == F.col("label")).select("query_id", "centre")
    joined = best.join(vectors.select(F.col("vec_id").alias("doc"), "embedding"), "doc", "left").join(queries, "query_id")
    sim = F.coalesce(similarity.cosine(F.col("embedding"), F.col("centre")), F.lit(0.0))
    blended = similarity.blend_semantic(joined.withColumn("similarity", sim))
    return blended.select("query_id", "doc", F.round("semantic_score", 4).alias("semantic_score"), F.round("blended", 4).alias("blended"))


def dense_max_chunk(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of one label play the chunks of a document; bm25 answers are the pool."""
    vectors = read_table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    chunks = vectors.select((F.col("vec_id") % 50).alias("doc"), "embedding")
    centres = _centroids(vectors)
    queries = centres.select(F.col("label").cast("bigint").alias("query_id"), F.col("centre").alias("query_embedding"))
    pool = vectors.select(F.col("label").cast("bigint").alias("query_id"), (F.col("vec_id") % 50).alias("doc")).distinct()
    return similarity.dense_channel(chunks, queries, pool).select("query_id", "doc", F.round("value", 5).alias("value"))


def _labelled(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    rows = L.features(_repo(spark, sf), D.issues(spark, sf), mentions=False)
    gold = D.gold(spark, sf).withColumn("is_gold", F.lit(True))
    return rows.join(gold, ["query_id", "doc"], "left").fillna(False, ["is_gold"]), [f"{c}_{s}" for c in DIRECT for s in ("n", "rr")]


def pairwise_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Number, mean and largest size of the differences that the pairwise learner sees, per feature."""
    rows, names = _labelled(spark, sf)
    diffs = ml.pairwise_differences(rows, names)
    sums = [F.struct(F.lit(n).alias("feature"), F.count(F.lit(1)).alias("pairs"), F.round(F.avg(f"d{i}"), 6).alias("mean"), F.round(F.max(F.abs(f"d{i}")), 6).alias("largest")) for i, n in enumerate(names)]
    return diffs.agg(F.array(*sums).alias("s")).select(F.inline("s"))


def pairwise_weights(spark: SparkSession, sf: str) -> DataFrame:
    labelled, names = _labelled(spark, sf)
    weights = ml.fit_pairwise(materialise(labelled, "labelled"), names)
    return spark.createDataFrame(sorted(weights.items()), "feature string, weight double").select("feature", F.round("weight", 3).alias("weight"))


def cross_validated(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy on questions whose language the weights never saw: over questions, over languages, and the worst one."""
    rows, names = _labelled(spark, sf)
    gold = D.gold(spark, sf)
    languages = gold.join(D.corpus(spark, sf).select("doc", "path"), "doc").groupBy("query_id").agg(
        F.min_by(F.split("path", "/")[0], "doc").alias("language")
    )
    per_query, _weights = crossval.cross_validate(rows.join(languages, "query_id"), gold, names, "language", 8)
    return metrics.micro_macro_worst(per_query, "language")


QUERIES = {f.__name__: f for f in (
    traceback_channel, literal_path_channel, module_channel, pairwise_differences, predict_with_fallback,
    term_stats, idf_table, doc_lengths, boosted_terms, legacy_stats, bm25_topk, bm25_explain, bm25_test_penalty,
    bm25_title_weighted, bm25_title_only, path_bm25, api_bm25, definition_channel, literal_channel, channel_normalise,
    channel_pivot, candidate_pool, neighbour_propagation, structural_features, history_counters, linear_score,
    tree_score, tree_score_batched, localize, localize_with_plan, top2_margin, tier_calibration, reading_plan,
    holdout_check, hit_recall_ap, metrics_summary, micro_macro_worst, grouping_lang_tier, containment_join,
    symbol_bm25, predict_files, predict_with_impact, cosine_rerank, semantic_blend, dense_max_chunk, pairwise_weights, cross_validated,
)}
