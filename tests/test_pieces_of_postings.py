"""BM25 adds up whole documents in pieces of bounded work."""

from pyspark.sql import functions as F

from lodestar.operators import bm25, index


def test_scores_in_pieces_of_documents(spark, monkeypatch):
    docs = spark.range(60).select(F.col("id").alias("doc"), F.concat(F.lit("alpha beta gamma "), F.when(F.col("id") % 3 == 0, "delta").otherwise("omega")).alias("text"))
    idx = index.code_token_index(docs, "doc", "text")
    terms = spark.createDataFrame([(q, t, 1.0) for q in range(5) for t in ("alpha", "delta", "unknown")], "query_id int, term string, weight double")
    want = {tuple(r)[:2]: round(r["score"], 9) for r in bm25.scores(idx, terms).collect()}
    assert len(want) == 300
    monkeypatch.setattr(bm25, "CONTRIBUTIONS_PER_PIECE", 20)  # 5 questions x (60 + 20) postings
    got = bm25.scores(idx, terms)
    held = got.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("doc").alias("docs")).collect()
    assert len(held) > 8 and max(r["pairs"] for r in held) <= 60
    assert all(r["pairs"] == 5 * r["docs"] for r in held)  # every document is summed up in one place
    assert {tuple(r)[:2]: round(r["score"], 9) for r in got.collect()} == want
