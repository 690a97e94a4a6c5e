"""Helpers that keep hot keys from landing in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..session import materialise

ROWS_PER_SALT = 4_000_000
MAX_HOT_KEYS = 10_000


def hot_keys(counts: DataFrame, key: str, total: int, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """Keys with more rows than one task should hold, and their number of salts.

    ``counts`` is (key, n). The threshold grows with ``total`` so that at most
    ``MAX_HOT_KEYS`` keys can pass it; that bound makes the broadcast safe.
    """
    limit = max(rows_per_salt, math.ceil(total / MAX_HOT_KEYS))
    return counts.where(F.col("n") > limit).select(
        key, F.ceil(F.col("n") / F.lit(rows_per_salt)).cast("int").alias("_salts")
    )


def salted_join(
    big: DataFrame, other: DataFrame, key: str, salt_by: str, counts: DataFrame, total: int,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Inner equi-join on ``key`` where ``big`` may hold very frequent keys.

    Rows of a hot key are spread over salts by a hash of ``salt_by``; the rows
    of ``other`` for that key are repeated once per salt. Without hot keys this
    is a plain join.
    """
    hot = hot_keys(counts, key, total, rows_per_salt)
    if hot.isEmpty():
        return big.join(other, key)
    hot = F.broadcast(hot)  # at most MAX_HOT_KEYS rows, see hot_keys
    salted_big = big.join(hot, key, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(salt_by), F.coalesce("_salts", F.lit(1))).cast("int")
    ).drop("_salts")
    salted_other = other.join(hot, key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))
    ).drop("_salts")
    return salted_big.join(salted_other, [key, "_salt"]).drop("_salt")


def _in_order(df: DataFrame, groups: list[str], order: list[Column]) -> DataFrame:
    """The rows sorted over the whole cluster, with ``_id`` rising in that order and ``_part``, the partition.

    Ranges are cut at sampled quantiles of groups and order, so a hot group lies
    in many partitions. Written once: sampling could cut the ranges differently
    in a second run.
    """
    keys = [F.col(g) for g in groups]
    row_bits = 33  # monotonically_increasing_id keeps the partition above these bits
    numbered = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_id", F.monotonically_increasing_id())
    return materialise(numbered, "ordered").withColumn("_part", F.shiftright("_id", row_bits))


def _with_parts(rows: DataFrame, parts: DataFrame, groups: list[str], how: str = "inner") -> DataFrame:
    """Rows ``r`` joined with per-partition values ``o`` of their group."""
    on = F.col("r._part") == F.col("o._part")
    for g in groups:
        on = on & F.col(f"r.{g}").eqNullSafe(F.col(f"o.{g}"))
    return rows.alias("r").join(parts.alias("o"), on, how)


def _over_parts(groups: list[str]) -> WindowSpec:
    # One row per group and partition it touches: bounded by the partition count.
    return Window.partitionBy(*(groups or [F.lit(1)])).orderBy("_part")


def ranked(df: DataFrame, groups: list[str], order: list[Column], out: str, number_type: str = "int") -> DataFrame:
    """Exact row numbers (from 1) within ``groups``; no group is ever held by one task.

    Where a group may hold more rows than an ``int`` can number, ask for ``long``.

    A row's number is its position in its partition, minus where its group
    starts there, plus the group's rows in earlier partitions.
    """
    spread = _in_order(df, groups, order)
    sizes = spread.groupBy(*groups, "_part").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = _over_parts(groups).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if groups:
        offsets = materialise(offsets, "offsets")  # the join with all rows is planned by their real size
    number = F.col("r._id") - F.col("o._first") + F.col("o._before") + 1
    return _with_parts(spread, offsets, groups).select(*[F.col(f"r.{c}") for c in df.columns], number.cast(number_type).alias(out))


def next_candidate(df: DataFrame, groups: list[str], key: str, candidate: str, out: str) -> DataFrame:
    """Adds the first non-null ``candidate`` after each row in ``key`` order.

    Partitions are searched side by side; a second look-ahead over the first
    candidate of each of the group's later partitions covers the rest.
    """
    spread = _in_order(df, groups, [F.col(key)])
    ahead = Window.partitionBy(*groups, "_part").orderBy("_id").rowsBetween(1, Window.unboundedFollowing)
    later = _over_parts(groups).rowsBetween(1, Window.unboundedFollowing)
    first = spread.groupBy(*groups, "_part").agg(F.min_by(candidate, F.when(F.col(candidate).isNotNull(), F.col("_id"))).alias("_found"))
    first = first.withColumn("_later", F.first("_found", ignorenulls=True).over(later))
    near = spread.withColumn("_near", F.first(candidate, ignorenulls=True).over(ahead))
    return _with_parts(near, first, groups).select(*[F.col(f"r.{c}") for c in df.columns], F.coalesce("r._near", "o._later").alias(out))


def running_sum(df: DataFrame, groups: list[str], key: str, value: str, out: str) -> DataFrame:
    """Adds the running sum of ``value`` in ``key`` order (any sortable, unique key).

    Partitions are summed side by side and each starts from the total of the
    group's earlier ones.
    """
    spread = _in_order(df, groups, [F.col(key)])
    inside = Window.partitionBy(*groups, "_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0)
    earlier = _over_parts(groups).rowsBetween(Window.unboundedPreceding, -1)
    starts = spread.groupBy(*groups, "_part").agg(F.sum(value).alias("_total"))
    starts = starts.withColumn("_start", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
    summed = spread.withColumn("_in", F.sum(value).over(inside))
    return _with_parts(summed, starts, groups).select(*[F.col(f"r.{c}") for c in df.columns], (F.col("r._in") + F.col("o._start")).alias(out))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The newest row per key, as an aggregate: hot keys shrink before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*")


def top_k(df: DataFrame, groups: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """The first ``k`` rows per group.

    The planner prunes each map task to ``k`` rows per group before the shuffle
    (window group limit), so a group of any size stays cheap.
    """
    window = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).where(F.col(out) <= k)
