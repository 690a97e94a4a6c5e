"""Needles without an inner word."""

from pyspark.sql import functions as F

from lodestar.operators import similarity


def test_needles_without_inner_words_meet_on_their_own_length(spark):
    needles = ["b1/p12", "b1/p999", "ab", "", "x/" + "y" * 40, None]
    hay = ["zb1/p123", "b1/p99", "ab", "ax/" + "y" * 41, "x/" + "y" * 35, "b1/p12", None]
    frame = lambda values, name: spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"{name} int, text string")
    found = similarity.containing(frame(needles, "n"), "n", F.col("text"), frame(hay, "h"), "h", F.col("text"))
    assert {(r.n, r.h) for r in found.collect()} == {(0, 0), (0, 5), (4, 3)}
    pieces = spark.createDataFrame([("abcab",)], "t string").select(similarity._pieces(F.col("t"), [2, 4, 9]).alias("p")).first().p
    assert sorted(pieces) == ["ab", "abca", "bc", "bcab", "ca"]
