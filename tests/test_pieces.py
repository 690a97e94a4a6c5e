"""Work in pieces whose size does not grow with the input."""

from pyspark.sql import functions as F

from lodestar.functions import text as X
from lodestar.operators import index
from lodestar.session import in_pieces


def test_pieces_follow_the_size(spark):
    rows = spark.range(100).withColumn("text", F.repeat(F.lit("x"), 10))
    assert in_pieces(rows, "id", 5).rdd.getNumPartitions() == 20
    assert in_pieces(rows, "id", 50, F.length("text")).rdd.getNumPartitions() == 20
    assert in_pieces(rows.limit(0), "id", 5).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_index_tokenises_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(index, "CHARS_PER_PIECE", 20)
    seen = []
    monkeypatch.setattr(X, "code_token_rows", lambda df, *a, rows=X.code_token_rows, **k: (seen.append(df.rdd.getNumPartitions()), rows(df, *a, **k))[1])
    docs = spark.createDataFrame([(i, "alpha beta gamma delta") for i in range(10)], "doc long, text string")
    built = index.code_token_index(docs, "doc", "text")
    assert seen == [11] and built.n == 10 and {(r.term, r.df) for r in built.terms.collect()} == {(t, 10) for t in ("alpha", "beta", "gamma", "delta")}
