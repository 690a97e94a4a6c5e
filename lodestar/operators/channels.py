"""Evidence channels per (query, document) and their normalised features."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..session import materialise
from .resolve import resolve_path_suffixes, resolve_suffix_modules
from .skew import ROWS_PER_SALT, ranked, salted_join, top_k

# --- Fixed values. ---
LITERAL_LENGTH_CAP = 80
LITERAL_LENGTH_UNIT = 40
IMPORTED_BY_FACTOR = 0.5
MAX_CANDIDATES = 300
RECENT_COMMITS = 300
FIX_SUBJECT = r"(?i)\b(fix|fixed|fixes|bug|regression|refs?\s+#|closes?\s+#)"
CHANNELS = (
    "bm25", "bm25_title", "api", "path_bm25", "defs", "defs_class", "qualified", "module",
    "literal_path", "traceback", "literal", "neighbor",
)
GROUPS = ["query_id", "channel"]
# --- End of fixed values. ---
#: Steps into which a channel's values are counted, from its best down to zero.
STEPS = 1024
#: Questions whose documents in reach are broadcast at once: at most channels x MAX_CANDIDATES each.
QUESTIONS_AT_ONCE = 256


def definition_channels(defs: DataFrame, idents: DataFrame, n: int, max_files: int | None = None) -> DataFrame:
    """(query_id, doc, channel, value) for ``defs`` and ``defs_class``.

    ``defs`` is (doc, symbol, kind). A symbol that many files define says little
    and weighs little; ``max_files`` leaves out those beyond it.
    """
    sizes = defs.groupBy("symbol").agg(F.count_distinct("doc").alias("paths"))
    if max_files is not None:
        sizes = sizes.where(F.col("paths") <= max_files)
    sizes = sizes.join(idents.select(F.col("ident").alias("symbol")).distinct(), "symbol", "left_semi")
    weight = F.log(1.0 + F.lit(float(n)) / F.col("paths")) * (1.0 + F.log(F.col("cnt").cast("double")))
    # The names asked for are stored; they are few, and the definitions are met where they lie.
    asked = materialise(
        idents.select("query_id", F.col("ident").alias("symbol"), "cnt").join(sizes, "symbol").select("query_id", "symbol", weight.alias("w")), "asked-names"
    )
    both = defs.select("doc", "symbol", "kind").join(asked, "symbol").select(
        "query_id", "doc", "w",
        F.explode(
            F.when(F.col("kind") == "class", F.array(F.lit("defs"), F.lit("defs_class"))).otherwise(
                F.array(F.lit("defs"))
            )
        ).alias("channel"),
    )
    return both.groupBy("query_id", "doc", "channel").agg(F.sum("w").alias("value"))


def qualified_channel(signals: DataFrame, qualified: DataFrame) -> DataFrame:
    """Adjacent pairs of dotted names that are a defined ``class.method``."""
    names = signals.select("query_id", F.explode("dotted").alias("d"))
    parts = F.split(F.lower("d"), r"\.")
    pairs = names.select(
        "query_id",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size(parts) - 1),
                lambda i: F.concat_ws(".", F.element_at(parts, i), F.element_at(parts, i + 1)),
            )
        ).alias("name"),
    )
    return pairs.join(qualified.select("doc", F.col("qualified").alias("name")), "name").groupBy(
        "query_id", "doc"
    ).agg(F.count(F.lit(1)).cast("double").alias("value"))


def module_channel(signals: DataFrame, files: DataFrame) -> DataFrame:
    """Dotted names and imported modules that resolve to a file."""
    names = signals.select("query_id", F.explode(F.concat("dotted", "imports")).alias("name"))
    modules = files.select(P.module_of(F.col("path")).alias("module"), F.col("doc").alias("target"))
    found = resolve_suffix_modules(names.select("name").distinct(), modules)
    return names.join(found, "name").groupBy("query_id", F.col("resolved").alias("doc")).agg(
        F.count(F.lit(1)).cast("double").alias("value")
    )


def _resolved_paths(mentions: DataFrame, files: DataFrame) -> DataFrame:
    found = resolve_path_suffixes(mentions.select("mention").distinct(), files)
    with_doc = found.join(files.select(F.col("path").alias("resolved"), "doc"), "resolved")
    return mentions.join(with_doc.select("mention", "doc"), "mention")


def literal_path_channel(signals: DataFrame, files: DataFrame) -> DataFrame:
    """How often the text names a path that is a file (longest suffix match)."""
    mentions = signals.select("query_id", F.explode("paths").alias("mention"))
    return _resolved_paths(mentions, files).groupBy("query_id", "doc").agg(
        F.count(F.lit(1)).cast("double").alias("value")
    )


def traceback_channel(signals: DataFrame, files: DataFrame) -> DataFrame:
    """1 / (1 + depth) of the innermost frame in each file; unknown frames do not count."""
    mentions = signals.select("query_id", F.posexplode("frames").alias("pos", "f")).select(
        "query_id", "pos", F.col("f.path").alias("mention")
    )
    # The frames of one text; their number is bounded by that row.
    inner = Window.partitionBy("query_id").orderBy(F.desc("pos"))
    value = F.lit(1.0) / F.row_number().over(inner)
    return (
        _resolved_paths(mentions, files).withColumn("v", value)
        .groupBy("query_id", "doc").agg(F.max("v").alias("value"))
    )


def literal_channel(literals: DataFrame, contained: DataFrame, n: int, max_files: int | None = None) -> DataFrame:
    """Verbatim literals; ``contained`` is (query_id, literal), ``literals`` (doc, literal).

    ``max_files`` leaves out literals that more files hold.
    """
    rare = literals.groupBy("literal").agg(F.count_distinct("doc").alias("paths"))
    if max_files is not None:
        rare = rare.where(F.col("paths") <= max_files)
    weight = (
        F.log(1.0 + F.lit(float(n)) / F.col("paths"))
        * F.least(F.length("literal"), F.lit(LITERAL_LENGTH_CAP)) / LITERAL_LENGTH_UNIT
    )
    found = materialise(contained.join(rare, "literal").select("query_id", "literal", weight.alias("w")), "found-literals")
    return (
        literals.select("doc", "literal").distinct().join(found, "literal")
        .groupBy("query_id", "doc").agg(F.sum("w").alias("value"))
    )


def neighbor_values(base: DataFrame, edges: DataFrame, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """(query_id, doc, value): best evidence one import edge away.

    ``base`` is (query_id, doc, value), ``edges`` (src, dst): src imports dst.
    Imported files inherit all, importing files half of the evidence.
    """
    both = edges.select(F.col("src").alias("doc"), F.col("dst").alias("other"), F.lit(1.0).alias("f")).unionByName(
        edges.select(F.col("dst").alias("doc"), F.col("src").alias("other"), F.lit(IMPORTED_BY_FACTOR).alias("f"))
    )
    both = materialise(both, "both-ways")  # asked for sizes, hot keys and the join
    counts = both.groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    joined = salted_join(both, base.where("value > 0"), "doc", "other", counts, total, rows_per_salt)
    return joined.groupBy("query_id", F.col("other").alias("doc")).agg(
        F.max(F.col("value") * F.col("f")).alias("value")
    )


def normalise(values: DataFrame, rounded: bool = False) -> DataFrame:
    """(query_id, channel, doc, value, n, rr, rank) of stored channel values.

    n is the value relative to the query's best in the channel, rr the
    reciprocal rank (value descending, document ascending). Values that are not
    positive end a channel. Groups of any length are ranked by a distributed sort.
    ``rounded`` values went through ``rounded_values`` before they were stored.
    """
    positive = values if rounded else rounded_values(values)
    rows = ranked(positive, GROUPS, [F.desc("value"), F.asc("doc")], "rank").join(_peaks(positive), GROUPS)
    return rows.select(
        *GROUPS, "doc", "value", (F.col("value") / F.col("peak")).alias("n"),
        (F.lit(1.0) / F.col("rank")).alias("rr"), "rank",
    )


def rounded_values(values: DataFrame) -> DataFrame:
    """The positive values, to six digits. Rounding costs more than reading a stored row, so it is done before storing."""
    return values.where("value > 0").withColumn("value", F.round("value", 6))


def _peaks(positive: DataFrame) -> DataFrame:
    """(query_id, channel, peak), stored, so that the join with all rows is planned by their number."""
    return materialise(positive.groupBy(*GROUPS).agg(F.max("value").alias("peak")), "peaks")


def relative(values: DataFrame, rounded: bool = False) -> DataFrame:
    """(query_id, channel, doc, n) of ``normalise`` alone: no order is needed, so nothing is sorted."""
    positive = values if rounded else rounded_values(values)
    return positive.join(_peaks(positive), GROUPS).select(*GROUPS, "doc", (F.col("value") / F.col("peak")).alias("n"))


def first_eligible(positive: DataFrame, peaks: DataFrame, eligible: DataFrame, size: int) -> DataFrame:
    """(query_id, channel, doc, value, _place): the first ``size`` rows of each channel whose document is eligible.

    Rows are counted by steps of their value relative to the peak; only those
    down to a step with enough rows are sorted, and only the first of these are
    compared with ``eligible`` (doc). Where too few of them may be answers, all
    channels are followed further down.
    """
    step = F.floor((F.lit(1.0) - F.col("value") / F.col("peak")) * STEPS).cast("int")  # falls with the value, equal values share a step
    stepped = positive.join(peaks, GROUPS).withColumn("_step", step).drop("peak")
    heights = materialise(stepped.groupBy(*GROUPS, "_step").agg(F.count(F.lit(1)).alias("_n")), "heights")
    # One row per question, channel and step.
    down = heights.withColumn("_down", F.sum("_n").over(Window.partitionBy(*GROUPS).orderBy("_step")))
    best, wanted = [F.desc("value"), F.asc("doc")], 2 * size
    while True:
        ends = materialise(down.where(F.col("_down") >= wanted).groupBy(*GROUPS).agg(F.min("_step").alias("_end")), "step-ends")
        near = stepped.join(ends, GROUPS, "left").where(F.col("_end").isNull() | (F.col("_step") <= F.col("_end"))).drop("_step", "_end")
        near = materialise(top_k(near, GROUPS, best, wanted, "_place"), "first-rows")
        answers = near.join(eligible, "doc", "left_semi").drop("_place")
        more = near.where(F.col("_place") == wanted).select(*GROUPS)
        found = answers.groupBy(*GROUPS).agg(F.count(F.lit(1)).alias("_found"))
        if more.join(found, GROUPS, "left").where(F.coalesce("_found", F.lit(0)) < size).isEmpty():
            return top_k(answers, GROUPS, best, size, "_place")
        wanted *= 4


def leading(values: DataFrame, eligible: DataFrame, size: int = MAX_CANDIDATES, rounded: bool = False) -> DataFrame:
    """(query_id, channel, doc, rr, rank) of ``normalise`` down to the ``size``-th eligible document of each channel.

    ``eligible`` is (doc). The rows kept are the first ones of their channel, so
    their ranks among each other are their ranks among all; the others are never
    sorted. No document beyond them can enter a pool of ``size`` (see ``within_reach``).
    """
    positive = values if rounded else rounded_values(values)
    best = [F.desc("value"), F.asc("doc")]
    first = first_eligible(positive, _peaks(positive), eligible, size)
    ends = materialise(first.where(F.col("_place") == size).select(*GROUPS, F.col("value").alias("_value"), F.col("doc").alias("_doc")), "ends")
    # A channel with fewer eligible documents has no end, and all of it is kept.
    ahead = F.col("_value").isNull() | (F.col("value") > F.col("_value")) | ((F.col("value") == F.col("_value")) & (F.col("doc") <= F.col("_doc")))
    kept = positive.join(ends, GROUPS, "left").where(ahead).drop("_value", "_doc")
    return ranked(kept, GROUPS, best, "rank").select(*GROUPS, "doc", (F.lit(1.0) / F.col("rank")).alias("rr"), "rank")


def _ahead(marks: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds ``_at`` to ``rows``: how many of its channel's ``marks`` (query_id, channel, values, docs) stand before each row.

    The marks lie in order, so each row finds its place in them by halving.
    """
    longest = marks.agg(F.max(F.size("values"))).first()[0] or 1
    placed = rows.join(F.broadcast(marks), GROUPS).withColumn("_at", F.lit(0))
    for bit in range(math.ceil(math.log2(longest + 1)) - 1, -1, -1):
        last = F.col("_at") + ((1 << bit) - 1)
        value, doc = F.get("values", last), F.get("docs", last)
        before = (value > F.col("value")) | ((value == F.col("value")) & F.coalesce(doc < F.col("doc"), F.lit(False)))
        placed = placed.withColumn("_at", F.col("_at") + F.when(before, F.lit(1 << bit)).otherwise(0))
    return placed.drop("values", "docs")


def in_reach(positive: DataFrame, eligible: DataFrame, size: int = MAX_CANDIDATES, at_once: int = QUESTIONS_AT_ONCE) -> DataFrame:
    """The rows of ``within_reach(normalise(positive), size, eligible)`` without sorting the others.

    The documents in reach are known from the first eligible rows of each
    channel. Their ranks are exact: all rows of a channel are counted between
    those of its documents in reach, each task adds up its own rows, and the
    counts are summed from the top. ``positive`` are stored ``rounded_values``
    with one row per question, channel and document; they are read a few times
    and never shuffled or written again. What is broadcast is bounded by
    ``at_once`` questions.
    """
    peaks = _peaks(positive)
    reach = materialise(first_eligible(positive, peaks, eligible, size).select("query_id", "doc").distinct(), "reach")
    blocks = max(1, math.ceil(peaks.select("query_id").distinct().count() / at_once))
    block = lambda rows, i: rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
    asked = reduce(DataFrame.unionByName, [block(positive, i).join(F.broadcast(block(reach, i)), ["query_id", "doc"], "left_semi") for i in range(blocks)])
    asked = materialise(asked, "asked-values")
    in_order = F.array_sort(F.collect_list(F.struct((-F.col("value")).alias("v"), F.col("doc").alias("d"))))
    marks = materialise(asked.groupBy(*GROUPS).agg(in_order.alias("m")).select(
        *GROUPS, F.transform("m", lambda s: -s["v"]).alias("values"), F.transform("m", lambda s: s["d"]).alias("docs")
    ), "marks")
    placed = [_ahead(block(marks, i), block(positive, i)).groupBy(*GROUPS, "_at").agg(F.count(F.lit(1)).alias("_n")) for i in range(blocks)]
    # At most one row per question, channel and document in reach.
    counts = materialise(reduce(DataFrame.unionByName, placed), "counts-between")
    ranks = counts.withColumn("rank", F.sum("_n").over(Window.partitionBy(*GROUPS).orderBy("_at")).cast("int"))
    number = marks.select(*GROUPS, F.posexplode("docs").alias("_at", "doc"))
    ranks = materialise(number.join(ranks, [*GROUPS, "_at"]).select(*GROUPS, "doc", "rank"), "ranks-in-reach")
    return asked.join(ranks, [*GROUPS, "doc"]).join(peaks, GROUPS).select(
        *GROUPS, "doc", "value", (F.col("value") / F.col("peak")).alias("n"), (F.lit(1.0) / F.col("rank")).alias("rr"), "rank",
    )


def union_channels(channels: dict[str, DataFrame]) -> DataFrame:
    """Long (query_id, doc, channel, value) from per-channel frames."""
    tagged = [df.select("query_id", "doc", F.lit(name).alias("channel"), "value") for name, df in channels.items()]
    return reduce(DataFrame.unionByName, tagged)


def with_neighbor(features: DataFrame, edges: DataFrame, intended: bool = False, new_ranks: int | None = None) -> DataFrame:
    """Adds the neighbor channel to normalised features.

    The base is the normalised text score (``intended`` adds definitions,
    modules and tracebacks). ``new_ranks`` lets documents without other evidence
    enter only down to that rank; by default all enter.
    """
    used = ["bm25", "defs", "module", "traceback"] if intended else ["bm25"]
    base = features.where(F.col("channel").isin(used))
    if len(used) == 1:  # one row a document already
        base = base.select("query_id", "doc", F.col("n").alias("value"))
    else:
        base = base.groupBy("query_id", "doc").agg(F.sum("n").alias("value"))
    raw = neighbor_values(base, edges)
    reached = neighbor_rows(raw)
    if new_ranks is not None:
        known = features.select("query_id", "doc").distinct().withColumn("_known", F.lit(True))
        reached = reached.join(known, ["query_id", "doc"], "left").where(F.col("_known") | (F.col("rank") <= new_ranks))
    return features.unionByName(reached.select(*features.columns))


def neighbor_rows(values: DataFrame) -> DataFrame:
    """Normalised rows of the neighbor channel from (query_id, doc, value)."""
    return normalise(materialise(values.select("query_id", "doc", F.lit("neighbor").alias("channel"), "value"), "neighbor"))


def neighbor_channel(values: DataFrame, edges: DataFrame) -> DataFrame:
    """Stored rounded (query_id, doc, channel, value) of the neighbor channel, from stored rounded channel values.

    The base is the text score relative to its best, as in ``with_neighbor``.
    """
    base = relative(values.where("channel = 'bm25'"), rounded=True).select("query_id", "doc", F.col("n").alias("value"))
    return materialise(rounded_values(neighbor_values(base, edges).select("query_id", "doc", F.lit("neighbor").alias("channel"), "value")), "neighbor")


def widen(features: DataFrame, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """One row per (query_id, doc) with <channel>_n and <channel>_rr, 0 when absent."""
    columns: list[Column] = []
    for name in channels:
        hit = F.col("channel") == name
        columns.append(F.coalesce(F.max(F.when(hit, F.col("n"))), F.lit(0.0)).alias(f"{name}_n"))
        columns.append(F.coalesce(F.max(F.when(hit, F.col("rr"))), F.lit(0.0)).alias(f"{name}_rr"))
    return features.groupBy("query_id", "doc").agg(*columns, F.max("rr").alias("best_rr"))


def within_reach(rows: DataFrame, size: int = MAX_CANDIDATES, eligible: DataFrame | None = None) -> DataFrame:
    """The rows of the documents that can enter a pool of ``size``; exact, and bounded by queries x channels x size.

    ``rows`` are ranked channel values of documents that may be answers, or
    ``eligible`` (doc) tells which of them may. A document beyond the first ``size`` of them in every channel has that many
    better ones in its best channel, so it cannot enter.
    """
    answers = rows if eligible is None else rows.join(eligible, "doc", "left_semi")
    first = top_k(answers, GROUPS, [F.asc("rank")], size, "_place")
    return rows.join(materialise(first.select("query_id", "doc").distinct(), "reach"), ["query_id", "doc"], "left_semi")


def pool(wide: DataFrame, size: int = MAX_CANDIDATES) -> DataFrame:
    """The ``size`` documents per query with the best reciprocal rank on any channel."""
    return top_k(wide, ["query_id"], [F.desc("best_rr"), F.asc("doc")], size, "pool_rank")


def candidate_files(files: DataFrame, exclude_tests: bool = True) -> DataFrame:
    """Files that may be answers: no generated ones and, by default, no tests."""
    keep = ~P.is_generated(F.col("path"))
    if exclude_tests:
        keep = keep & ~P.is_test_localizer(F.col("path"))
    return files.where(keep)


def structural(rows: DataFrame, files: DataFrame, words: DataFrame) -> DataFrame:
    """Adds path-based features; ``files`` is (doc, path, n_lines), ``words`` (query_id, word)."""
    path = F.col("path")
    stem = P.stem(path)
    facts = files.select(
        "doc", "path",
        stem.isin("__init__", "index").cast("double").alias("is_init"),
        stem.isin(P.GENERIC_STEMS).cast("double").alias("is_generic"),
        (~path.contains("/") | F.lower(P.top_dir(path)).isin(P.NON_PACKAGE_DIRS)).cast("double").alias("non_package"),
        P.depth(path).cast("double").alias("depth"),
        F.log1p(F.col("n_lines").cast("double")).alias("log_lines"),
        F.lower(stem).alias("_word"),
    )
    said = words.select("query_id", F.col("word").alias("_word"), F.lit(1.0).alias("_said")).distinct()
    return (
        rows.join(facts, "doc")
        .join(said, ["query_id", "_word"], "left")
        .withColumn("stem_in_issue", F.coalesce("_said", F.lit(0.0)))
        .drop("_word", "_said")
    )


def history_counts(commits: DataFrame) -> DataFrame:
    """(path, touches, recent, fixes) from commits(age, subject, files).

    Every commit uses up an age; the caller decides how far back history goes.
    """
    fix = F.col("subject").rlike(FIX_SUBJECT)
    rows = commits.select("age", fix.alias("is_fix"), F.explode("files").alias("path"))
    return rows.groupBy("path").agg(
        F.count(F.lit(1)).alias("touches"),
        F.count_if(F.col("age") < RECENT_COMMITS).alias("recent"),
        F.count_if("is_fix").alias("fixes"),
    )


def with_history(rows: DataFrame, history: DataFrame) -> DataFrame:
    """Adds log1p history features; ``history`` is (doc, touches, recent, fixes)."""
    joined = rows.join(history.select("doc", "touches", "recent", "fixes"), "doc", "left")
    for name, source in (("hist_touch", "touches"), ("hist_recent", "recent"), ("hist_fix", "fixes")):
        joined = joined.withColumn(name, F.log1p(F.coalesce(F.col(source), F.lit(0)).cast("double")))
    return joined.drop("touches", "recent", "fixes")
