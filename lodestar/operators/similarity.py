"""Set-similarity, containment and vector joins without nested loops."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import materialise
from .skew import next_candidate, ranked, top_k

# --- Fixed values. ---
SUPERSEDE_THRESHOLD = 0.35
SIMILAR_THRESHOLD = 0.2
FILE_BONUS = 0.2
SIMILAR_TOP = 5
SEMANTIC_BLEND = 0.3
GRAM = 3
ANCHOR = 32
# --- End of fixed values. ---
#: Tokens in a block of sets at most, and in one below which no more are made.
TOKENS_PER_BLOCK = 16_000_000
TOKENS_PER_SMALL_BLOCK = 500_000
MAX_PAIR_PARTITIONS = 2000
#: Part of the tokens any link must share that is not counted for every set (under 1, see ``_block_links``).
FREQUENT_SHARE = 0.9


def jaccard(a: Column, b: Column) -> Column:
    """|A n B| / |A u B| of two duplicate-free arrays; 0 when one is empty."""
    inter = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - inter
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(inter / union)


def distinct_sets(df: DataFrame, key: str, text: Column, *attrs: str) -> tuple[DataFrame, DataFrame]:
    """Group equal token sets: sets(set_id, tids, n, attrs) and members(set_id, key, attrs).

    Copies share one set (named by its smallest key), so a large group of copies
    costs one comparison.
    """
    rows = df.select(key, *attrs, F.array_sort(X.token_set(text)).alias("tokens")).where(F.size("tokens") > 0)
    hashed = materialise(rows.withColumn("_hash", F.sha2(F.array_join("tokens", " "), 256)), "token-sets")
    firsts = hashed.groupBy("_hash", *attrs).agg(F.min(key).alias("set_id"))
    members = materialise(hashed.select("_hash", key, *attrs).join(firsts, ["_hash", *attrs]).drop("_hash"), "members")
    sets = hashed.select(F.col(key).alias("set_id"), *attrs, "tokens").join(firsts.select("set_id"), "set_id", "left_semi")
    return number_tokens(sets, *attrs), members


def number_tokens(sets: DataFrame, *attrs: str) -> DataFrame:
    """(set_id, attrs, tids, n): tokens as numbers, rarest first, ascending.

    Numbers make the exact comparisons cheap and their order is the global
    token order of the prefix filter.
    """
    opened = materialise(sets.select("set_id", *attrs, F.explode("tokens").alias("token")), "set-tokens")
    freq = opened.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    numbered = ranked(materialise(freq, "token-df"), [], [F.asc("df"), F.asc("token")], "tid")
    rows = opened.join(numbered.select("token", "tid"), "token")
    packed = rows.groupBy("set_id", *attrs).agg(F.array_sort(F.collect_list("tid")).alias("tids"))
    return materialise(packed.withColumn("n", F.size("tids")), "sets")


def prefix_rows(sets: DataFrame, threshold: float, *attrs: str) -> DataFrame:
    """(tid, pos, set_id, n, attrs) for the rarest tokens of each set.

    Two sets with Jaccard >= t must share one of their n - ceil(t n) + 1 rarest
    tokens, so only those need to meet.
    """
    length = F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1
    return sets.select(
        "set_id", "n", *attrs, F.posexplode(F.slice("tids", 1, length.cast("int"))).alias("pos", "tid")
    )


def may_reach(threshold: float) -> Column:
    """Length and position filters for a shared token of two sets (ln, lpos, rn, rpos).

    The overlap must be at least t / (1 + t) (ln + rn). Seen from the first
    shared token only the rest of both sets can overlap, so a pair that first
    meets too late cannot reach the threshold.
    """
    need = F.lit(threshold / (1.0 + threshold)) * (F.col("ln") + F.col("rn")) - 1e-6
    rest = F.least(F.col("ln") - F.col("lpos"), F.col("rn") - F.col("rpos"))
    return (
        (F.col("ln") >= F.col("rn") * threshold - 1e-6) & (F.col("rn") >= F.col("ln") * threshold - 1e-6) & (rest >= need)
    )


def _sides(rows: DataFrame, *attrs: str) -> tuple[DataFrame, DataFrame]:
    left = rows.select("tid", *attrs, F.col("set_id").alias("l"), F.col("n").alias("ln"), F.col("pos").alias("lpos"))
    right = rows.select("tid", *attrs, F.col("set_id").alias("r"), F.col("n").alias("rn"), F.col("pos").alias("rpos"))
    return left, right


def _checked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(l, r, similarity) of candidate pairs that reach the threshold."""
    a = sets.select(F.col("set_id").alias("l"), F.col("tids").alias("lt"))
    b = sets.select(F.col("set_id").alias("r"), F.col("tids").alias("rt"))
    return (
        pairs.join(a, "l").join(b, "r").select("l", "r", jaccard(F.col("lt"), F.col("rt")).alias("similarity"))
        .where(F.col("similarity") >= threshold)
    )


def similar_sets(sets: DataFrame, threshold: float, *attrs: str, best: int | None = None) -> DataFrame:
    """(left_id, right_id, similarity) of different sets with Jaccard >= threshold.

    Both directions are returned. ``attrs`` must be equal on both sides. Sets are
    dealt into blocks, and one task compares each pair of blocks: it counts shared
    tokens in memory, so only links leave it and no candidate is ever stored.
    ``best`` leaves out links that cannot be among that many most similar ones
    of their left set, by similarity rounded to 3 digits.
    """
    groups = list(attrs) or ["_all"]
    rows = sets.select("set_id", "tids", "n", *(attrs or [F.lit(0).alias("_all")]))
    cores = sets.sparkSession.sparkContext.defaultParallelism
    total = F.sum("n")
    # Enough pairs to give every core a few, but no blocks so small that copying them costs more than comparing.
    spread = F.least(F.ceil(total / TOKENS_PER_SMALL_BLOCK), F.lit(math.ceil(math.sqrt(2 * cores))))
    sizes = materialise(rows.groupBy(*groups).agg(F.greatest(F.ceil(total / TOKENS_PER_BLOCK), spread).cast("int").alias("_blocks")), "blocks")
    pairs = sizes.agg(F.sum(F.col("_blocks").cast("bigint") * (F.col("_blocks") + 1) / 2)).first()[0] or 0
    dealt = rows.join(sizes, groups).withColumn("_own", F.pmod(F.xxhash64("set_id"), F.col("_blocks")).cast("int"))
    dealt = dealt.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    keys = [*groups, "_low", "_high"]
    met = dealt.select(
        *groups, F.least("_own", "_with").alias("_low"), F.greatest("_own", "_with").alias("_high"), "_own", "set_id", "tids", "n"
    ).repartition(max(cores, min(4 * int(pairs), MAX_PAIR_PARTITIONS)), *keys)
    kind = sets.schema["set_id"].dataType.simpleString()
    found = met.groupBy(*keys).applyInArrow(_block_links(threshold, best), f"left_id {kind}, right_id {kind}, similarity double")
    return materialise(found, "similar")


def _block_links(threshold: float, best: int | None):
    """Function from the sets of a block, or of two, to their links (see ``similar_sets``)."""

    def links(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        low, high = table["_low"][0].as_py(), table["_high"][0].as_py()
        own, n = table["_own"].to_numpy(), table["n"].to_numpy()
        tids = table["tids"].chunk(0)
        tokens, row = tids.flatten().to_numpy(), np.repeat(np.arange(len(n), dtype=np.int32), np.diff(tids.offsets.to_numpy()))
        first = np.ones(len(tokens), bool)
        first[1:] = (tokens[1:] != tokens[:-1]) | (row[1:] != row[:-1])
        tokens, row = tokens[first], row[first]
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)

        # The right block by token: its rows in ``held``, from ``starts`` to ``ends`` of each token.
        inside = own[row] == high
        order = np.argsort(tokens[inside], kind="stable")
        known, starts = np.unique(tokens[inside][order], return_index=True)
        ends = np.append(starts[1:], len(order))
        place = np.zeros(len(n), np.intp)
        place[right] = np.arange(len(right))
        held = place[row[inside][order]]
        columns = np.searchsorted(known, tokens[inside]).astype(np.int32)
        from_, to = np.searchsorted(row[inside], right), np.searchsorted(row[inside], right, side="right")

        inside = (own[row] == low) & np.isin(tokens, known)
        asked, by = np.searchsorted(known, tokens[inside]), row[inside]
        begin, end = np.searchsorted(by, left), np.searchsorted(by, left, side="right")
        weight = threshold / (1.0 + threshold)
        base, wanted = weight * n[right], np.zeros(len(known), bool)
        lefts, rights, values = [], [], []
        for i, (a, b) in enumerate(zip(begin, end)):
            size = n[left[i]]
            # The most frequent tokens (they have the highest numbers) are looked up only where the others leave a chance:
            # a link shares weight (size + other size) tokens at least, and of these at most len(common) are not counted.
            rest = b - a - int(FREQUENT_SHARE * threshold * size)
            if rest <= 0:
                continue
            rare, common = asked[a:a + rest], asked[a + rest:b]
            shared = np.bincount(np.concatenate([held[s:e] for s, e in zip(starts[rare].tolist(), ends[rare].tolist())]), minlength=len(right))
            hit = np.flatnonzero(shared - base >= weight * size - len(common) - 1e-6)
            hit = hit[(n[right[hit]] >= threshold * size - 1e-6) & (shared[hit] > 0)]
            if low == high:
                hit = hit[hit > i]
            if not len(hit):
                continue
            wanted[common] = True
            both = shared[hit] + np.array([np.count_nonzero(wanted[columns[from_[j]:to[j]]]) for j in hit])
            wanted[common] = False
            value = both / (size + n[right[hit]] - both)
            hit, value = hit[value >= threshold], value[value >= threshold]
            lefts.append(np.full(len(hit), left[i]))
            rights.append(right[hit])
            values.append(value)

        one, two, value = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((lefts, int), (rights, int), (values, float)))
        one, two, value = np.concatenate([one, two]), np.concatenate([two, one]), np.concatenate([value, value])
        if best is not None and len(one):
            order = np.lexsort((-value, one))
            one, two, value = one[order], two[order], value[order]
            starts, counts = np.unique(one, return_index=True, return_counts=True)[1:]
            # Whatever is 0.001 below the last of them is below it after rounding, too.
            last = value[starts + np.minimum(counts, best) - 1]
            kept = value >= np.repeat(last, counts) - 0.0011
            one, two, value = one[kept], two[kept], value[kept]
        ids = table["set_id"]
        return pa.table({"left_id": ids.take(pa.array(one)), "right_id": ids.take(pa.array(two)), "similarity": value})

    return links


def superseded_by(
    df: DataFrame, key: str, text: Column, category: str, threshold: float = SUPERSEDE_THRESHOLD
) -> DataFrame:
    """(old_id, new_id, similarity): the first later similar row of the same category.

    Rows arrive in key order; each new row replaces the still active rows that
    resemble it, so a row is replaced by the smallest later similar key. One
    row per replaced key comes out, however many copies there are.
    """
    sets, members = distinct_sets(df, key, text, category)
    chained = next_candidate(
        members.select("set_id", F.col(key).alias("old_id"), F.col(key).alias("cand")),
        ["set_id"], "old_id", "cand", "new_id",
    )
    same = chained.where("new_id is not null").select(
        "old_id", "new_id", F.lit(1.0).alias("similarity")
    )
    # Of the keys behind a set's newest one, only the first can replace anything; of those between its keys, every one can.
    spans = members.groupBy(F.col("set_id").alias("left_id")).agg(F.max(key).alias("_last"))
    links = similar_sets(sets, threshold, category).join(spans, "left_id")
    news = links.join(members.select(F.col("set_id").alias("right_id"), F.col(key).alias("new_id")), "right_id").where("new_id > left_id")
    cand = F.struct("new_id", "similarity")
    between = news.where("new_id <= _last").select("left_id", cand.alias("cand"))
    behind = news.where("new_id > _last").groupBy("left_id").agg(F.min(cand).alias("cand"))
    news = between.unionByName(behind).select("left_id", F.col("cand.new_id").alias("k"), "cand")
    olds = members.join(links.select("left_id").distinct(), members.set_id == F.col("left_id"), "left_semi").select(
        F.col("set_id").alias("left_id"), F.col(key).alias("k"), F.lit(None).cast(news.schema["cand"].dataType).alias("cand")
    )
    cross = (
        next_candidate(olds.unionByName(news), ["left_id"], "k", "cand", "new")
        .where("cand is null and new is not null")
        .select(F.col("k").alias("old_id"), "new.new_id", "new.similarity")
    )
    return same.unionByName(cross).groupBy("old_id").agg(
        F.min_by(F.struct("new_id", "similarity"), "new_id").alias("b")
    ).select("old_id", "b.new_id", "b.similarity")


def similar_top(
    df: DataFrame, key: str, text: Column, k: int = SIMILAR_TOP, threshold: float = SIMILAR_THRESHOLD
) -> DataFrame:
    """(key, other, similarity, rank): the k most similar other rows of each row.

    Ordered by similarity rounded to 3 digits, then newest key. Only the k + 1
    newest members of a group of equal sets can appear in an answer, because
    all members are equally similar to anything; the rest only ask.
    """
    sets, members = distinct_sets(df, key, text)
    newest = top_k(members, ["set_id"], [F.desc(key)], k + 1, "_age")
    newest = materialise(newest.select("set_id", F.col(key).alias("other")), "newest")
    same = members.join(newest, "set_id").where(F.col(key) != F.col("other")).select(
        key, "other", F.lit(1.0).alias("similarity")
    )
    links = similar_sets(sets, threshold, best=k)
    # The best k answers of a set serve all of its members.
    answers = top_k(
        links.join(newest, links.right_id == newest.set_id).select(
            "left_id", "other", F.round("similarity", 3).alias("similarity")
        ),
        ["left_id"], [F.desc("similarity"), F.desc("other")], k, "_r",
    )
    cross = members.join(answers, members.set_id == answers.left_id).select(key, "other", "similarity")
    return top_k(
        same.unionByName(cross), [key], [F.desc("similarity"), F.desc("other")], k
    )


def best_matches(
    queries: DataFrame, query_key: str, query_text: Column, memories: DataFrame, memory_key: str,
    memory_text: Column, threshold: float, tokens=X.token_set,
) -> DataFrame:
    """(query_key, memory_key, similarity) with Jaccard >= threshold, across two tables.

    The prefix filter of ``prefix_rows`` applies with one token order for both
    tables. Equal token sets are compared once, however many rows share them.
    """
    def side(df: DataFrame, key: str, text: Column, name: str) -> DataFrame:
        rows = df.select(
            F.lit(name).alias("side"), F.col(key).cast("string").alias("id"), F.array_sort(tokens(text)).alias("tokens")
        ).where(F.size("tokens") > 0)
        return rows.withColumn("set_id", F.concat("side", F.sha2(F.array_join("tokens", " "), 256)))

    members = materialise(
        side(queries, query_key, query_text, "q").unionByName(side(memories, memory_key, memory_text, "m")), "two-sided"
    )
    sets = number_tokens(members.groupBy("side", "set_id").agg(F.first("tokens").alias("tokens")), "side")
    left, right = _sides(materialise(prefix_rows(sets, threshold, "side"), "prefixes"), "side")
    met = left.where("side = 'q'").drop("side").join(right.where("side = 'm'").drop("side"), "tid")
    links = _checked(met.where(may_reach(threshold)).select("l", "r").distinct(), sets, threshold)
    kinds = [queries.schema[query_key].dataType, memories.schema[memory_key].dataType]
    return (
        links.join(members.where("side = 'q'").select(F.col("set_id").alias("l"), F.col("id").cast(kinds[0]).alias(query_key)), "l")
        .join(members.where("side = 'm'").select(F.col("set_id").alias("r"), F.col("id").cast(kinds[1]).alias(memory_key)), "r")
        .select(query_key, memory_key, "similarity")
    )


# ------------------------------------------------------------ containment join
def containing(
    needles: DataFrame, needle_key: str, needle: Column, hay: DataFrame, hay_key: str, hay_text: Column
) -> DataFrame:
    """(needle_key, hay_key) where the hay text holds the needle verbatim.

    A contained text brings its inner words along unchanged, so both sides meet
    on the needle's rarest inner word and only those pairs are compared. Needles
    without an inner word meet the hay's pieces of their own length on their
    first ``ANCHOR`` characters; up to that length, meeting is containing. Those
    under ``GRAM`` characters are left out.
    """
    word = "[A-Za-z0-9_]+"
    n = needles.select(F.col(needle_key).alias("_n"), needle.alias("_needle"))
    # The first and last word may continue in the hay text, so they are cut off.
    inner = F.regexp_replace("_needle", r"^[A-Za-z0-9_]+|[A-Za-z0-9_]+$", "")
    n = materialise(n.withColumn("_words", F.array_distinct(X.matches(inner, word))), "needles")
    with_words = n.where(F.size("_words") > 0)
    without = n.where((F.size("_words") == 0) & (F.length("_needle") >= GRAM))
    h = hay.select(F.col(hay_key).alias("_h"), hay_text.alias("_hay"))
    pairs = _meet(
        with_words.select("_n", F.explode("_words").alias("_k")),
        h.select("_h", F.explode(F.array_distinct(X.matches(F.col("_hay"), word))).alias("_k")),
    )
    size = F.least(F.length("_needle"), F.lit(ANCHOR))
    sizes = sorted(r[0] for r in without.select(size).distinct().collect())  # at most ANCHOR numbers
    sure = None
    if sizes:
        pieces = h.select("_h", F.explode(_pieces(F.col("_hay"), sizes)).alias("_k"))
        met = without.select("_n", F.substring("_needle", 1, ANCHOR).alias("_k"), F.length("_needle").alias("_size")).join(pieces, "_k")
        sure = met.where(F.col("_size") <= ANCHOR).select("_n", "_h")
        pairs = pairs.unionByName(met.where(F.col("_size") > ANCHOR).select("_n", "_h"))
    found = (
        pairs.join(n.select("_n", "_needle"), "_n")
        .join(h, "_h")
        .where(F.col("_hay").contains(F.col("_needle")))
        .select("_n", "_h")
    )
    if sure is not None:
        found = found.unionByName(sure)
    return found.select(F.col("_n").alias(needle_key), F.col("_h").alias(hay_key))


def _pieces(text: Column, sizes: list[int]) -> Column:
    """Distinct pieces of a text of each of the lengths."""
    starts = lambda n: F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
    cut = lambda n: F.transform(starts(n), lambda i: F.substring(text, i, F.lit(n)))
    return F.array_distinct(F.concat(*[cut(n) for n in sizes]))


def _meet(needle_keys: DataFrame, hay_keys: DataFrame) -> DataFrame:
    """(_n, _h) that share the needle's rarest key among the keys of the hay side."""
    wanted = needle_keys.select("_k").distinct()
    hits = hay_keys.join(wanted, "_k", "left_semi")
    df = hits.groupBy("_k").agg(F.count(F.lit(1)).alias("_df"))
    # A key missing from the hay side means that the needle is nowhere (NULL sorts first).
    rarest = (
        needle_keys.join(df, "_k", "left")
        .groupBy("_n")
        .agg(F.min_by("_k", F.struct(F.coalesce("_df", F.lit(0)), F.col("_k"))).alias("_k"))
    )
    return rarest.join(hits, "_k").select("_n", "_h")


# -------------------------------------------------------------------- vectors
def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0), lambda acc, x: acc + x,
    )


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(1e-12))


def clipped(similarity: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), similarity))


def blend_semantic(candidates: DataFrame, blend: float = SEMANTIC_BLEND) -> DataFrame:
    """Adds semantic_score and the blended score to (query_id, doc, score, similarity).

    The blend works on score / best score of the query and is scaled back.
    """
    best = F.max("score").over(Window.partitionBy("query_id"))
    semantic = clipped(F.col("similarity"))
    blended = (F.lit(1.0 - blend) * (F.col("score") / best) + F.lit(blend) * semantic) * best
    return candidates.withColumn("semantic_score", semantic).withColumn("blended", blended)


def dense_channel(chunks: DataFrame, queries: DataFrame, pool: DataFrame) -> DataFrame:
    """(query_id, doc, value): best chunk similarity for the pooled documents.

    ``chunks`` is (doc, embedding), ``queries`` (query_id, query_embedding),
    ``pool`` (query_id, doc); vectors meet only where the pool says so.
    """
    met = pool.join(queries, "query_id").join(chunks, "doc")
    value = cosine(F.col("query_embedding"), F.col("embedding"))
    return met.groupBy("query_id", "doc").agg(F.max(value).alias("value"))
