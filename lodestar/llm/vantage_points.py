"""Nearest neighbours with vantage-point trees per shard.

Vectors lie in cells around pivots (fitted on a bounded sample); a large cell is
split over shards of bounded size, so a hot cell is many shards. Each shard is
one index row with its tree. A query searches its own cell first and learns a
distance within which the rest must lie; then only cells that the triangle
inequality does not exclude are searched. Inside a tree the same inequality
prunes subtrees. ``factor`` relaxes both: a part is skipped if its lower bound
times the factor exceeds the k-th distance found. Factor one is exact search.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import pick

SHARD_ROWS = 2048
LEAF = 32
QUERY_BLOCK = 256
#: The pivots are fitted on at most this many vectors, and there are at most this many pivots (both are broadcast).
PIVOT_SAMPLE = 8192
PIVOTS = 512
FACTOR = 1.0


def distances(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, each summed alike in every call."""
    out = np.empty((len(queries), len(vectors)))
    step = max(1, 4_000_000 // max(1, vectors.size))
    for at in range(0, len(queries), step):
        out[at:at + step] = np.sqrt(((queries[at:at + step, None, :] - vectors[None, :, :]) ** 2).sum(axis=2))
    return out


class Tree:
    """A balanced vantage-point tree over one shard; rows are ordered by id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.ids, self.vectors = ids, vectors
        self.nodes: list[tuple] = []  # (leaf rows) or (row, inner, inner low, inner high, outer, outer low, outer high)
        self.root = self._build(np.arange(len(ids)), leaf)

    def _build(self, rows: np.ndarray, leaf: int) -> int:
        number = len(self.nodes)
        self.nodes.append(())
        if len(rows) <= leaf:
            self.nodes[number] = (rows,)
            return number
        # of a few rows the one farthest from another separates best
        vantage = rows[int(np.argmax(distances(self.vectors[rows[:1]], self.vectors[rows])[0]))]
        rest = rows[rows != vantage]
        far = distances(self.vectors[[vantage]], self.vectors[rest])[0]
        order = np.argsort(far, kind="stable")
        rest, far, half = rest[order], far[order], len(rest) // 2
        inner, outer = np.sort(rest[:half]), np.sort(rest[half:])
        self.nodes[number] = (int(vantage), self._build(inner, leaf), far[0], far[half - 1], self._build(outer, leaf), far[half], far[-1])
        return number

    def search(self, queries: np.ndarray, k: int, factor: float, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids of the k nearest rows of each query, nearest first, ties to the smaller id; unused places hold infinity.

        ``limit``: a distance for each query beyond which nothing is wanted.
        """
        best = np.full((len(queries), k), np.inf)
        found = np.full((len(queries), k), np.iinfo(np.int64).max)
        cap = np.full(len(queries), np.inf) if limit is None else limit

        def offer(which: np.ndarray, far: np.ndarray, rows: np.ndarray) -> None:
            d = np.concatenate((best[which], far), axis=1)
            i = np.concatenate((found[which], np.broadcast_to(self.ids[rows], far.shape)), axis=1)
            order = np.lexsort((i, d), axis=1)[:, :k]
            best[which], found[which] = np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)

        def open_to(which: np.ndarray, far: np.ndarray, low: float, high: float) -> np.ndarray:
            bound = np.maximum(np.maximum(far - high, low - far), 0.0)
            reach = np.minimum(best[which, k - 1], cap[which])
            return which[bound * factor <= reach * (1 + 1e-12) + 1e-12]

        def visit(node: int, which: np.ndarray) -> None:
            if not len(which):
                return
            content = self.nodes[node]
            if len(content) == 1:
                if len(content[0]):
                    offer(which, distances(queries[which], self.vectors[content[0]]), content[0])
                return
            row, inner, in_low, in_high, outer, out_low, out_high = content
            far = distances(queries[which], self.vectors[[row]])
            offer(which, far, np.array([row]))
            far = far[:, 0]
            near_in = far <= (in_high + out_low) / 2
            visit(inner, open_to(which[near_in], far[near_in], in_low, in_high))
            visit(outer, open_to(which[~near_in], far[~near_in], out_low, out_high))
            visit(inner, open_to(which[~near_in], far[~near_in], in_low, in_high))
            visit(outer, open_to(which[near_in], far[near_in], out_low, out_high))

        if len(self.ids):
            visit(self.root, np.arange(len(queries)))
        return best, found


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, empty or zero, and without null or non-finite components."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def prepared(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, vector)`` of the rows that take part, in double precision."""
    rows = pick(table, vec_id=id_col, vector=vector_col).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("vector").cast("array<double>").alias("vector"))
    return rows.where(F.col("vec_id").isNotNull() & usable(F.col("vector")))


def lengths(rows: DataFrame) -> set[int]:
    """The vector lengths of a table: a number for each model that made its vectors."""
    return {r["n"] for r in rows.select(F.size("vector").alias("n")).distinct().collect()}


def fit_pivots(rows: DataFrame, total: int) -> np.ndarray:
    """Pivots from a bounded sample (smallest hashes of the ids): a few rounds of moving each to the mean of its cell."""
    place = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40))
    # a bound on the hash first, so that tasks send about the sample and not one each
    drawn = rows.where(place <= F.lit(int(min(1.0, 1.2 * PIVOT_SAMPLE / total) * (1 << 40))))
    sample = drawn.orderBy(place, "vec_id").limit(PIVOT_SAMPLE).select("vector").collect()
    points = np.array([r["vector"] for r in sample], dtype=np.float64)
    count = int(min(PIVOTS, len(points), max(1, total // (4 * SHARD_ROWS))))
    pivots = points[:count].copy()
    for _ in range(4 if count > 1 else 0):
        cell = np.argmin(distances(points, pivots), axis=1)
        for c in range(count):
            if (cell == c).any():
                pivots[c] = points[cell == c].mean(axis=0)
    return pivots


def _near_cells(rows: DataFrame, pivots: np.ndarray, extra: str = "") -> DataFrame:
    """Adds ``cell`` (nearest pivot) and ``far`` (its distance)."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)  # at most PIVOTS vectors

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                far = distances(np.array(frame["vector"].tolist(), dtype=np.float64), shared.value)
                cell = np.argmin(far, axis=1)
                yield frame.assign(cell=cell.astype("int32"), far=far[np.arange(len(far)), cell])

    return rows.mapInPandas(place, "vec_id long, vector array<double>, cell int, far double")


def build(rows: DataFrame, label: str = "vantage") -> tuple[DataFrame, DataFrame, np.ndarray, dict[int, float]]:
    """Index of all vectors: shard rows ``(cell, shard, tree)``, ``members(vec_id, rep)``, pivots and the radius of each cell.

    Equal vectors are one entry, named by their smallest id; the members table
    has a row for every vector.
    """
    members = materialise(rows.groupBy("vector").agg(F.min("vec_id").alias("vec_id")), f"{label}-distinct")
    total = members.count()
    if not total:
        raise ValueError("no vector takes part")
    pivots = fit_pivots(members.select("vec_id", "vector"), total)
    placed = materialise(_near_cells(members.select("vec_id", "vector"), pivots), f"{label}-placed")
    cells = {r["cell"]: (r["n"], r["radius"]) for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()}
    parts = F.element_at(F.array(*[F.lit(max(1, -(-cells.get(c, (0, 0))[0] // SHARD_ROWS))) for c in range(len(pivots))]), F.col("cell") + 1)
    sharded = placed.withColumn("shard", F.pmod(F.xxhash64("vec_id"), parts).cast("int"))

    def grow(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id")
        tree = Tree(frame["vec_id"].to_numpy(dtype=np.int64), np.array(frame["vector"].tolist(), dtype=np.float64))
        return pd.DataFrame({"cell": [key[0]], "shard": [key[1]], "tree": [pickle.dumps(tree.__dict__, protocol=5)]})

    index = materialise(sharded.groupBy("cell", "shard").applyInPandas(grow, "cell int, shard int, tree binary"), f"{label}-index")
    named = rows.select("vec_id", F.col("vector").alias("_v")).join(members.select(F.col("vec_id").alias("rep"), "vector"), F.col("_v") == F.col("vector")).select("vec_id", "rep").distinct()
    return index, materialise(named, f"{label}-members"), pivots, {c: r for c, (_, r) in cells.items()}


def _search(asked: DataFrame, index: DataFrame, k: int, factor: float) -> DataFrame:
    """Search ``asked(query_id, vector, reach, cell)``, in blocks of queries, in every shard of its cell: ``(query_id, rep, score)``."""
    total = asked.groupBy("cell").agg(F.count(F.lit(1)).alias("asked"))
    blocks = asked.join(F.broadcast(total), "cell")  # at most PIVOTS rows
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("query_id"), F.ceil(F.col("asked") / QUERY_BLOCK).cast("long")))
    blocks = blocks.groupBy("cell", "block").agg(F.collect_list(F.struct("query_id", "vector", "reach")).alias("queries"))  # about QUERY_BLOCK of them

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for queries, raw in zip(frame["queries"], frame["tree"]):
                tree = Tree.__new__(Tree)
                tree.__dict__.update(pickle.loads(raw))
                ids = np.array([q["query_id"] for q in queries], dtype=np.int64)
                reach = np.array([q["reach"] for q in queries], dtype=np.float64)
                far, reps = tree.search(np.array([list(q["vector"]) for q in queries], dtype=np.float64), k, factor, reach)
                kept = np.isfinite(far) & (far <= reach[:, None])
                yield pd.DataFrame({"query_id": np.repeat(ids, kept.sum(axis=1)), "rep": reps[kept], "score": far[kept]})

    pairs = blocks.join(index, "cell").select("queries", "tree")
    return pairs.mapInPandas(look, "query_id long, rep long, score double")


def nearest(table: DataFrame, queries: DataFrame, k: int = 10, factor: float = FACTOR, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest other vectors of each query, ties to the smaller id.

    ``queries`` has the same two columns. A query's own id is no candidate. Null,
    empty, zero and non-finite vectors take no part on either side, nor do null
    ids. A repeated id counts once per different
    vector. Equal vectors are searched as one and expanded at the end to at most
    k + 1 ids each, which is all that can rank. Fewer candidates give fewer rows.
    Vectors of several lengths are searched each among its own length.
    """
    rows = materialise(prepared(table, id_col, vector_col), "vantage-rows")
    asked = materialise(prepared(queries, id_col, vector_col).distinct(), "vantage-asked")
    parts = [
        _nearest(rows.where(F.size("vector") == n), asked.where(F.size("vector") == n), k, factor) for n in sorted(lengths(rows) & lengths(asked))
    ]
    if not parts:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, parts)


def _nearest(rows: DataFrame, asked: DataFrame, k: int, factor: float) -> DataFrame:
    """The search among prepared vectors of one length, on both sides."""
    spark = rows.sparkSession
    index, members, pivots, radius = build(rows)
    asked = materialise(_near_cells(asked, pivots).select(F.col("vec_id").alias("query_id"), "vector", "cell"), "vantage-queries")
    top = Window.partitionBy("query_id").orderBy("score", "rep")
    depth = k + 1  # the query's own vector may be one of them
    endless = F.lit(float("inf"))
    home = materialise(_search(asked.withColumn("reach", endless), index, depth, factor), "vantage-home")
    ranked = home.withColumn("n", F.row_number().over(top)).where(F.col("n") == depth).select("query_id", F.col("score").alias("reach"))
    shared = spark.sparkContext.broadcast((pivots, radius))

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivots, radius = shared.value
        cells = np.array(sorted(radius))
        edge = np.array([radius[c] for c in cells])
        for frame in frames:
            if len(frame):
                bound = np.maximum(distances(np.array(frame["vector"].tolist(), dtype=np.float64), pivots)[:, cells] - edge, 0.0)
                go = bound * factor <= frame["reach"].to_numpy()[:, None] * (1 + 1e-12) + 1e-12
                go &= cells[None, :] != frame["cell"].to_numpy()[:, None]
                row, column = np.nonzero(go)
                yield frame.iloc[row].assign(cell=cells[column].astype("int32"))

    others = asked.join(ranked, "query_id", "left").withColumn("reach", F.coalesce("reach", endless)).select("query_id", "vector", "reach", "cell")
    others = others.mapInPandas(route, "query_id long, vector array<double>, reach double, cell int")
    away = _search(others, index, depth, factor)
    best = home.unionByName(away).withColumn("n", F.row_number().over(top)).where(F.col("n") <= depth).select("query_id", "rep", "score")
    copies = members.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("vec_id"))).where(F.col("n") <= depth).select("rep", "vec_id")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    pairs = best.join(copies, "rep").where("vec_id <> query_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
