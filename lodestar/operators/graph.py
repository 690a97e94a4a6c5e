"""Change-coupling and dependency graphs as edge tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .skew import ROWS_PER_SALT, hot_keys, ranked, salted_join, top_k

# --- Fixed values. ---
MAX_COMMITS = 500
MAX_FILES_PER_COMMIT = 20
HALF_LIFE_COMMITS = 150.0
IMPORT_WEIGHT = 1.0
CALL_WEIGHT = 1.5
COCHANGE_WEIGHT = 0.8
DAMPING = 0.72
ITERATIONS = 24
# --- End of fixed values. ---

STORE_EVERY = 4
#: Queries whose scores share a row.
QUERIES_PER_ROW = 32
#: Residual mass below which a node waits.
PUSH_EPSILON = 1e-6


def commit_ages(commits: DataFrame, newest_first: list[Column]) -> DataFrame:
    """Adds ``age``: 0 for the newest commit. """
    return ranked(commits, [], newest_first, "_rn").withColumn(
        "age", F.col("_rn") - 1
    ).drop("_rn")


def newest_commits(commits: DataFrame, newest_first: list[Column], depth: int = MAX_COMMITS) -> DataFrame:
    """The ``depth`` newest commits with their ages; only those rows are sorted in full."""
    return commit_ages(commits.orderBy(*newest_first).limit(depth), newest_first)


def cochange(
    changes: DataFrame, max_files: int = MAX_FILES_PER_COMMIT, half_life: float = HALF_LIFE_COMMITS
) -> DataFrame:
    """(left, right, weight), left < right, from changes(commit, age, file).

    A commit adds 2^(-age / half life) / (n - 1) to each of its pairs. Commits of
    one or of more than ``max_files`` files do not count; they are dropped before
    the pairs are formed, so a commit yields at most max_files^2 / 2 rows.
    """
    rows = changes.groupBy("commit", "file").agg(F.min("age").alias("age"))
    sizes = rows.groupBy("commit").agg(F.count(F.lit(1)).alias("n"))
    total = rows.count()
    huge = hot_keys(sizes, "commit", total)
    if not huge.isEmpty():  # far above max_files, and at most MAX_HOT_KEYS rows
        rows = rows.join(F.broadcast(huge.select("commit")), "commit", "left_anti")
    used = rows.join(sizes.where((F.col("n") >= 2) & (F.col("n") <= max_files)), "commit")
    used = used.withColumn(
        "w", F.pow(F.lit(2.0), -F.col("age") / F.lit(max(half_life, 1.0))) / (F.col("n") - 1)
    ).select("commit", "file", "w")
    left = used.select("commit", F.col("file").alias("left"), "w")
    right = used.select("commit", F.col("file").alias("right"))
    return (
        left.join(right, "commit").where(F.col("left") < F.col("right"))
        .groupBy("left", "right").agg(F.round(F.sum("w"), 8).alias("weight"))
    )


def symmetric(pairs: DataFrame) -> DataFrame:
    """Both directions of (left, right, weight) as (src, dst, weight)."""
    return pairs.select(F.col("left").alias("src"), F.col("right").alias("dst"), "weight").unionByName(
        pairs.select(F.col("right").alias("src"), F.col("left").alias("dst"), "weight")
    )


def adjacency(edges: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(src, dst, weight), both directions, strongest relation per pair.

    ``edges`` is (src, dst, kind, weight) with kind import, call or cochange;
    only the weight of co-changes is read. Self loops and unknown files go.
    """
    strength = (
        F.when(F.col("kind") == "import", F.lit(IMPORT_WEIGHT))
        .when(F.col("kind") == "call", F.lit(CALL_WEIGHT))
        .otherwise(F.lit(COCHANGE_WEIGHT) * F.log1p(F.greatest(F.col("weight"), F.lit(0.0))))
    )
    rows = edges.where(F.col("src") != F.col("dst")).select(
        F.least("src", "dst").alias("left"), F.greatest("src", "dst").alias("right"),
        strength.alias("weight"),
    ).where("weight > 0")
    best = rows.groupBy("left", "right").agg(F.max("weight").alias("weight"))
    if files is not None:
        known = files.select("path")
        best = best.join(known, best.left == known.path, "left_semi")
        best = best.join(known, best.right == known.path, "left_semi")
    return symmetric(best)


def _step(frontier: DataFrame, edges: DataFrame, counts: DataFrame, total: int, rows_per_salt: int) -> DataFrame:
    """(seed, node) one edge src -> dst further; hub nodes are salted."""
    moved = salted_join(
        edges.select("src", "dst"), frontier.select("seed", F.col("node").alias("src")), "src", "dst",
        counts, total, rows_per_salt,
    )
    return moved.select("seed", F.col("dst").alias("node")).distinct()


def reach(
    edges: DataFrame, seeds: DataFrame, max_hops: int, rows_per_salt: int = ROWS_PER_SALT
) -> DataFrame:
    """(seed, node, hop): nodes within ``max_hops`` edges, smallest hop, without the seed."""
    edges = materialise(edges.select("src", "dst").distinct(), "edges")
    counts = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    total = edges.count()
    visited = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop"))
    frontier = visited
    for hop in range(1, max_hops + 1):
        fresh = _step(frontier, edges, counts, total, rows_per_salt).join(
            visited.select("seed", "node"), ["seed", "node"], "left_anti"
        )
        frontier = materialise(fresh.withColumn("hop", F.lit(hop)), f"hop{hop}")
        visited = visited.unionByName(frontier)
    return visited.where("hop > 0")


def impact_radius(depends: DataFrame, seeds: DataFrame, max_hops: int = 2, **kw) -> DataFrame:
    """(seed, node, hop) of the files that depend on each seed.

    ``depends`` is (src, dst): src imports or calls dst; it is walked backwards.
    """
    back = depends.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(back, seeds, max_hops, **kw)


def reaching(edges: DataFrame, seeds: DataFrame, max_hops: int, count: int) -> DataFrame:
    """(seed): the seeds with at least ``count`` nodes within ``max_hops`` edges, themselves left out.

    The same answer as counting ``reach``, but a seed stops where it has enough,
    so at most ``count`` rows of it are walked further. A node with more than
    ``count`` edges gives any seed that meets it enough, so ``count`` + 1 of them do.
    """
    links = edges.where(~F.col("src").eqNullSafe(F.col("dst"))).select("src", "dst").distinct()
    links = materialise(top_k(links, ["src"], [F.asc("dst")], count + 1, "_n").drop("_n"), "links")
    known = frontier = seeds.select("seed", F.col("seed").alias("node")).distinct()
    found = []
    for hop in range(1, max_hops + 1):
        step = links.join(frontier.select("seed", F.col("node").alias("src")), "src").select("seed", F.col("dst").alias("node")).distinct()
        fresh = materialise(step.join(known, ["seed", "node"], "left_anti"), f"within{hop}")
        known = known.unionByName(fresh)
        enough = materialise(known.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > count).select("seed"), f"enough{hop}")
        found.append(enough)
        if hop < max_hops:
            known = materialise(known.join(enough, "seed", "left_anti"), f"known{hop}")
            frontier = fresh.join(enough, "seed", "left_anti")
    return reduce(DataFrame.unionByName, found)


def impact_summary(radius: DataFrame) -> DataFrame:
    """(seed, direct, transitive, total) counts."""
    return radius.groupBy("seed").agg(
        F.count_if(F.col("hop") == 1).alias("direct"),
        F.count_if(F.col("hop") > 1).alias("transitive"),
        F.count(F.lit(1)).alias("total"),
    )


def personalised_pagerank(
    adjacent: DataFrame, seeds: DataFrame, damping: float = DAMPING, iterations: int = ITERATIONS,
    max_hops: int | None = None, store_every: int = STORE_EVERY,
) -> DataFrame:
    """(query_id, node, score): random walk restarted at weighted seeds, many queries at once.

    ``adjacent`` is (src, dst, weight), symmetric; ``seeds`` (query_id, node,
    weight). Seeds without edges return their mass to all seeds of the query.
    Every few rounds the scores are stored, which keeps plans short and lets
    lost executors resume there. ``max_hops`` keeps the walk near the seeds.
    """
    positive = seeds.where("weight > 0")
    sums = positive.groupBy("query_id").agg(F.sum("weight").alias("_sum"))
    restart = positive.join(sums, "query_id").select(
        "query_id", "node", (F.col("weight") / F.col("_sum")).alias("restart")
    )
    if max_hops is not None:
        adjacent = materialise(adjacent.select("src", "dst", "weight"), "adjacent")
        near = _near(adjacent, restart, max_hops)
        return _shares(_near_rounds(restart, adjacent, near, damping, max(1, iterations), store_every))
    out = adjacent.groupBy("src").agg(F.sum("weight").alias("_out"))
    walk = materialise(
        adjacent.join(out, "src").select("src", "dst", (F.col("weight") / F.col("_out")).alias("p")), "walk"
    )
    # Only seeds can lack edges; their mass follows a recurrence per query.
    has_edge = walk.select("src").distinct().withColumn("_edge", F.lit(1.0))
    flagged = restart.withColumnRenamed("node", "src").join(has_edge, "src", "left")
    loose = flagged.groupBy("query_id").agg(
        F.sum(F.when(F.col("_edge").isNull(), F.col("restart")).otherwise(0.0)).alias("_loose")
    )
    restart = materialise(restart.join(loose, "query_id"), "restart")
    return _shares(_packed_rounds(restart, walk, damping, max(1, iterations), store_every))


def _shares(scores: DataFrame) -> DataFrame:
    """Positive scores as shares of their query's total."""
    total = scores.groupBy("query_id").agg(F.sum("score").alias("_total"))
    return scores.join(total, "query_id").where("score > 0").select(
        "query_id", "node", (F.col("score") / F.col("_total")).alias("score")
    )


def _slots(restart: DataFrame) -> tuple[DataFrame, int]:
    """(query_id, pack, slot) of every query, and the number of slots of a pack."""
    numbered = materialise(ranked(restart.select("query_id").distinct(), [], [F.asc("query_id")], "_number"), "queries")
    width = max(1, min(QUERIES_PER_ROW, numbered.count()))
    number = F.col("_number") - 1
    return numbered.select("query_id", F.floor(number / width).cast("int").alias("pack"), (number % width).alias("slot")), width


def _near_rounds(restart: DataFrame, edges: DataFrame, near: DataFrame, damping: float, iterations: int, store_every: int) -> DataFrame:
    """(query_id, node, score) after all rounds of walks that keep to ``near`` (query_id, node).

    Edges are not repeated for each query. A row of a node holds, for up to
    ``QUERIES_PER_ROW`` queries, how often the node is near (``m``), the weight of
    its edges to near nodes (``o``), its restart share (``r``) and its score
    (``s``); what arrives where ``m`` is zero is dropped.
    """
    numbered, width = _slots(restart)
    near_, outs, seeds_, scores_ = ([f"{c}{i}" for i in range(width)] for c in "mors")
    zero, at = F.lit(0.0), ["pack", "node"]
    rows = near.select("query_id", "node", F.lit(1.0).alias("_m"), zero.alias("_r")).unionByName(restart.select("query_id", "node", zero.alias("_m"), F.col("restart").alias("_r")))
    slotted = lambda names, value: [F.sum(F.when(F.col("slot") == i, F.col(value)).otherwise(0.0)).alias(n) for i, n in enumerate(names)]
    inside = materialise(rows.join(numbered, "query_id").groupBy(*at).agg(*slotted(near_, "_m"), *slotted(seeds_, "_r")), "inside")
    there = edges.join(inside.select("pack", F.col("node").alias("dst"), *near_), "dst").groupBy("pack", F.col("src").alias("node")).agg(
        *[F.sum(F.col(m) * F.col("weight")).alias(o) for m, o in zip(near_, outs)]
    )
    out = [F.when(F.col(m) > 0, F.coalesce(o, zero)).otherwise(0.0).alias(o) for m, o in zip(near_, outs)]
    nodes = materialise(inside.join(there, at, "left").select(*at, *near_, *seeds_, *out), "near-nodes")
    # Only seeds can lack edges; their mass follows a recurrence per query.
    lost = [F.sum(F.when(F.col(o) > 0, 0.0).otherwise(F.col(r))).alias(f"l{i}") for i, (o, r) in enumerate(zip(outs, seeds_))]
    loose = materialise(nodes.groupBy("pack").agg(*lost), "loose")
    scores = nodes.select(*at, *outs, *[F.col(r).alias(s) for r, s in zip(seeds_, scores_)])
    held = [F.col(f"l{i}") for i in range(width)]  # mass on edgeless seeds before the round
    for step in range(1, iterations + 1):
        factor = [F.lit(1.0 - damping) + F.lit(damping) * h for h in held]
        handed = [F.when(F.col(o) > 0, F.lit(damping) * F.col(s) / F.col(o)).otherwise(0.0).alias(s) for s, o in zip(scores_, outs)]
        moved = scores.select("pack", F.col("node").alias("src"), *handed).join(edges, "src").groupBy("pack", F.col("dst").alias("node")).agg(
            *[F.sum(F.col(s) * F.col("weight")).alias(s) for s in scores_]
        )
        arrived = [(f * F.col(r) + F.col(m) * F.coalesce(s, zero)).alias(s) for f, r, m, s in zip(factor, seeds_, near_, scores_)]
        scores = nodes.join(moved, at, "left").join(loose, "pack").select(*at, *outs, *arrived)
        held = [f * F.col(f"l{i}") for i, f in enumerate(factor)]
        if step % store_every == 0:
            scores = materialise(scores, f"near{step}")
    each = F.posexplode(F.array(*scores_)).alias("slot", "score")
    return materialise(scores.select(*at, each).where("score > 0").join(numbered, ["pack", "slot"]).select("query_id", "node", "score"), "rank")


def _packed_rounds(restart: DataFrame, walk: DataFrame, damping: float, iterations: int, store_every: int) -> DataFrame:
    """(query_id, node, score) after all rounds, with the scores of up to ``QUERIES_PER_ROW`` queries in one row.

    All queries walk the same edges, so an edge is met once a round for a whole
    row of them instead of once for each. ``restart`` is (query_id, node,
    restart, _loose), ``walk`` (src, dst, p).
    """
    numbered, width = _slots(restart)
    restart = materialise(restart.join(numbered, "query_id").drop("query_id"), "packed-restart")
    slots = [f"s{i}" for i in range(width)]

    def packed(value: Column) -> DataFrame:
        return restart.select("pack", "node", *[F.when(F.col("slot") == i, value).otherwise(0.0).alias(s) for i, s in enumerate(slots)])

    scores = packed(F.col("restart")).groupBy("pack", "node").agg(*[F.sum(s).alias(s) for s in slots])
    held = F.col("_loose")  # mass on edgeless seeds before the round
    for i in range(1, iterations + 1):
        factor = F.lit(1.0 - damping) + F.lit(damping) * held
        moved = scores.withColumnRenamed("node", "src").join(walk, "src").select(
            "pack", F.col("dst").alias("node"), *[(F.lit(damping) * F.col(s) * F.col("p")).alias(s) for s in slots]
        )
        scores = moved.unionByName(packed(factor * F.col("restart"))).groupBy("pack", "node").agg(*[F.sum(s).alias(s) for s in slots])
        held = factor * F.col("_loose")
        if i % store_every == 0:
            scores = materialise(scores, f"rank{i}")
    each = F.posexplode(F.array(*slots)).alias("slot", "score")
    return materialise(scores.select("pack", "node", each).where("score > 0").join(numbered, ["pack", "slot"]).select("query_id", "node", "score"), "rank")


def push_ranks(
    adjacent: DataFrame, seeds: DataFrame, damping: float = DAMPING, epsilon: float = PUSH_EPSILON, rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """(query_id, node, score): the same walk by pushing residual mass, until no node holds more than ``epsilon``.

    All mass starts as residual at the seeds. A round lets every node above
    ``epsilon`` keep its restart share and hand the rest to its neighbours; nodes
    below wait. So a round costs what its frontier costs, a query never touches
    more than 1 / ((1 - damping) epsilon) nodes however large the graph is, and
    what is left out of its scores is at most ``epsilon`` a touched node. Hub
    nodes are salted, seeds without edges return their mass to all seeds, and
    each round is stored, so lost executors resume there.
    """
    positive = seeds.where("weight > 0").groupBy("query_id", "node").agg(F.sum("weight").alias("weight"))
    sums = positive.groupBy("query_id").agg(F.sum("weight").alias("_sum"))
    restart = materialise(positive.join(sums, "query_id").select("query_id", "node", (F.col("weight") / F.col("_sum")).alias("restart")), "restart")
    out = adjacent.groupBy("src").agg(F.sum("weight").alias("_out"), F.count(F.lit(1)).alias("n"))
    counts = materialise(out, "degrees")
    walk = materialise(adjacent.join(counts, "src").select("src", "dst", (F.col("weight") / F.col("_out")).alias("share")), "walk")
    total = counts.agg(F.sum("n")).first()[0] or 0
    state = materialise(restart.select("query_id", "node", F.lit(0.0).alias("score"), F.col("restart").alias("residual")), "push0")
    above = F.col("residual") > epsilon
    round_no = 0
    while not state.where(above).isEmpty():
        round_no += 1
        active = state.where(above).select("query_id", F.col("node").alias("src"), (F.lit(damping) * F.col("residual")).alias("mass"))
        moved = salted_join(walk, active, "src", "dst", counts.select("src", "n"), total, rows_per_salt).select(
            "query_id", F.col("dst").alias("node"), F.lit(0.0).alias("score"), (F.col("mass") * F.col("share")).alias("residual")
        )
        loose = active.join(counts.select("src"), "src", "left_anti").groupBy("query_id").agg(F.sum("mass").alias("mass"))
        back = restart.join(loose, "query_id").select("query_id", "node", F.lit(0.0).alias("score"), (F.col("mass") * F.col("restart")).alias("residual"))
        held = state.select(
            "query_id", "node", (F.col("score") + F.when(above, F.lit(1.0 - damping) * F.col("residual")).otherwise(0.0)).alias("score"),
            F.when(above, 0.0).otherwise(F.col("residual")).alias("residual"),
        )
        pushed = held.unionByName(moved).unionByName(back).groupBy("query_id", "node")
        state = materialise(pushed.agg(F.sum("score").alias("score"), F.sum("residual").alias("residual")), f"push{round_no}")
    whole = state.groupBy("query_id").agg(F.sum("score").alias("_total"))
    return state.where("score > 0").join(whole, "query_id").select("query_id", "node", (F.col("score") / F.col("_total")).alias("score"))


def _near(adjacent: DataFrame, restart: DataFrame, max_hops: int) -> DataFrame:
    """(query_id, node) within ``max_hops`` of any seed of the query."""
    near = restart.select("query_id", "node")
    frontier = near
    for hop in range(max_hops):
        step = frontier.withColumnRenamed("node", "src").join(adjacent.select("src", "dst"), "src").select(
            "query_id", F.col("dst").alias("node")
        ).distinct()
        frontier = materialise(step.join(near, ["query_id", "node"], "left_anti"), f"near{hop}")
        near = near.unionByName(frontier)
    return near


# ------------------------------------------------------------------ code graph
def call_edges(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst, symbol): calls resolved by their last dotted segment.

    ``calls`` is (path, name), ``symbols`` (path, name, is_public). A file's own
    symbols do not count.
    """
    public = symbols.where("is_public").select(F.col("name").alias("seg"), F.col("path").alias("dst")).distinct()
    made = calls.select(
        F.col("path").alias("src"), F.col("name").alias("symbol"),
        F.element_at(F.split("name", r"\."), -1).alias("seg"),
    ).distinct()
    return made.join(public, "seg").where(F.col("src") != F.col("dst")).select("src", "dst", "symbol").distinct()


def import_edges(resolved: DataFrame) -> DataFrame:
    """(src, dst) of resolved imports (path, module, resolved)."""
    return resolved.where(F.col("resolved").isNotNull()).select(
        F.col("path").alias("src"), F.col("resolved").alias("dst")
    ).distinct()


def replace_changed(current: DataFrame, changed: DataFrame, fresh: DataFrame, key: str = "path") -> DataFrame:
    """Incremental update of a per-file table: drop changed paths, add their new rows.

    Reverse views (imported_by, called_by) are queries over these tables, so
    they never need repair and the result equals a full rebuild.
    """
    kept = current.join(changed.select(key).distinct(), key, "left_anti")
    return kept.unionByName(fresh)


def lookup(edges: DataFrame, keys: DataFrame, incoming: bool = False) -> DataFrame:
    """Edges of the asked nodes: ``(node, other, ...)`` with the edge's other columns.

    ``keys`` is (node). Outgoing edges name what a node uses, ``incoming`` ones
    what uses it. Nodes without such edges give no row.
    """
    own, other = ("dst", "src") if incoming else ("src", "dst")
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    rows = edges.select(F.col(own).alias("node"), F.col(other).alias("other"), *rest)
    return rows.join(keys.select("node").distinct(), "node", "left_semi")
