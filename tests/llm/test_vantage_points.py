import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import vantage_points as vp


def brute(rows, queries, k):
    out = []
    for qid, q in queries:
        far = sorted((float(np.sqrt(((np.array(q) - np.array(v)) ** 2).sum())), vid) for vid, v in rows if vid != qid)
        out += [(qid, rank, vid, d) for rank, (d, vid) in enumerate(far[:k], 1)]
    return sorted(out)


def found(frame):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in frame.collect())


def make(n, dim, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, dim)) * 2
    points = centres[r.integers(0, 5, n)] + r.normal(size=(n, dim)) * 0.4
    points[n // 2: n // 2 + n // 4] = points[0]  # a quarter are copies
    return [(i, [float(np.float32(x)) for x in p]) for i, p in enumerate(points)]


def test_exact_search_with_copies_and_many_shards(spark, monkeypatch):
    monkeypatch.setattr(vp, "SHARD_ROWS", 40)
    monkeypatch.setattr(vp, "QUERY_BLOCK", 7)
    rows = make(900, 6, 1)
    queries = rows[::10]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = found(vp.nearest(table, table.where("vec_id % 10 = 0"), k=5))
    want = brute(rows, queries, 5)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(g[3] == pytest.approx(w[3], abs=1e-12) for g, w in zip(got, want))


def test_relaxed_search_keeps_recall(spark, monkeypatch):
    monkeypatch.setattr(vp, "SHARD_ROWS", 100)
    rows = make(1500, 8, 2)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = {w[:1] + w[2:3] for w in brute(rows, rows[::25], 10)}
    got = {g[:1] + g[2:3] for g in found(vp.nearest(table, table.where("vec_id % 25 = 0"), k=10, factor=1.3))}
    assert len(got & want) / len(want) >= 0.9


def test_tree_prunes_only_what_cannot_win():
    rows = make(700, 5, 3)
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    queries = vectors[::9] + 0.01
    far, near = vp.Tree(ids, vectors, leaf=8).search(queries, 6, 1.0)
    full = vp.distances(queries, vectors)
    for row, (d, i) in enumerate(zip(far, near)):
        order = np.lexsort((ids, full[row]))[:6]
        assert i.tolist() == ids[order].tolist() and np.allclose(d, full[row][order])


def test_odd_rows(spark):
    rows = [
        (1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "b"), (3, None, "c"), (4, [0.0, 0.0], "d"), (5, [math.nan, 1.0], "e"), (6, [math.inf, 1.0], "f"), (7, [None, 1.0], "g"),
        (8, [], "h"), (9, [1.0, 2.0, 3.0], "i"), (None, [1.0, 1.0], "j"), (10, [1.0, 0.0], "k"), (10, [1.0, 0.0], "k"),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep string")
    got = found(vp.nearest(table, table, k=10))
    assert [g[:3] for g in got] == [(1, 1, 10), (1, 2, 2), (2, 1, 1), (2, 2, 10), (10, 1, 1), (10, 2, 2)]
    assert got[0][3] == 0.0 and got[1][3] == pytest.approx(math.sqrt(2))
    assert vp.nearest(table.limit(0), table, k=3).count() == 0
    assert vp.nearest(table, table.limit(0), k=3).count() == 0


def test_every_length_is_searched_among_its_own(spark):
    """Neither side votes: the table's and the queries' most frequent lengths may differ."""
    rng = np.random.default_rng(7)
    rows = [(i, rng.random(3 if i < 60 else 5 if i < 70 else 2).tolist()) for i in range(71)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = [i for i in range(71) if i in (0, 1) or i >= 60]  # most of these have five components
    want = []
    for q in asked:
        near = sorted((math.dist(v, rows[q][1]), i) for i, v in rows if i != q and len(v) == len(rows[q][1]))[:4]
        want += [(q, rank, i) for rank, (_, i) in enumerate(near, 1)]
    got = found(vp.nearest(table, table.where(F.col("vec_id").isin(asked)), k=4))
    assert [g[:3] for g in got] == sorted(want)
