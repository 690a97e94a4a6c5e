"""Mixing sources to target weights along a curriculum.

Every source has a schedule: how dense it is at each training position from 0
to 1. The integral of the schedule is the source's cumulative demand; a document
that begins at a share of its source's demand is trained at the position where
the integral reaches that share. Sources with less text than their target are
read again, up to three times. Documents are finally range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .common import pick, words_of

WEIGHTS = (5, 2, 1)
REPEATS = 3
#: Density at the knots of each weight class, piecewise linear: heavy sources fade out, light ones come in late.
KNOTS = (0.0, 0.5, 1.0)
SCHEDULES = ((1.4, 1.0, 0.6), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
#: Leading hex digits of a document's hash that cut a source into ranges for the running sum.
RANGE_DIGITS = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``(source, source_size, place, target)``: demand by weight, level-filled below ``repeats`` times each source's size.

    ``sizes`` has one row per source with its ``source_size``. Sorted by the
    level at which a source is full, the full ones are a prefix, so one running
    sum finds the common level. Sources are in code point order, null last.
    """
    names = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("place", (F.row_number().over(names) - 1).cast("int"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("place"), F.lit(len(weights))) + 1)
    rows = rows.withColumn("weight", weight.cast("double")).withColumn("cap", (repeats * F.col("source_size")).cast("double"))
    level = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("left", F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    rows = rows.withColumn("pull", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # the first source that the common level does not fill sets the level of all that follow
    open_level = F.when(F.col("left") / F.col("pull") <= F.col("cap") / F.col("weight"), F.col("left") / F.col("pull"))
    first = F.first(open_level, ignorenulls=True).over(level.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("target", F.coalesce(F.least("cap", F.col("weight") * first), F.col("cap")))
    return rows.select("source", "source_size", "place", "target")


def position(share: Column, class_: Column, knots: tuple[float, ...] = KNOTS, schedules: tuple[tuple[float, ...], ...] = SCHEDULES) -> Column:
    """Position at which a schedule's integral reaches ``share`` of its total, by inverting it piece by piece."""
    out = F.lit(None).cast("double")
    for number, dense in enumerate(schedules):
        areas = [(b - a) * (u + v) / 2 for a, b, u, v in zip(knots, knots[1:], dense, dense[1:])]
        total, reached, pieces = sum(areas), 0.0, None
        for a, b, u, v, area in zip(knots, knots[1:], dense, dense[1:], areas):
            slope = (v - u) / (b - a)
            need = share * total - reached  # area still to go inside this piece
            root = need / u if slope == 0 else (F.sqrt(F.greatest(F.lit(u * u) + 2 * slope * need, F.lit(0.0))) - u) / slope
            reached += area
            value = F.lit(a) + root
            pieces = F.when(share * total <= reached, value) if pieces is None else pieces.when(share * total <= reached, value)
        out = F.when(class_ == number, F.least(F.greatest(pieces.otherwise(float(knots[-1])), F.lit(0.0)), F.lit(1.0))).otherwise(out)
    return out


def mix(docs: DataFrame, **how) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken, positions)`` of every row.

    A source's documents are in the order of the MD5 of their doc_id, so reruns
    agree. Reading a source again and again, the mix takes each reading of a
    document whose middle lies below the target: ``copies`` readings, ``taken``
    words, at the training positions ``positions``. The running sum is cut into
    ranges of the hash, so a source of any size is many tasks. Null texts have
    no words, and a document without words is taken once at most; null sources
    are one source; rows with one doc_id follow each other by their texts'
    hashes; an empty table gives an empty result. The rows are in training
    order, range-sorted by their positions, first readings first; documents that
    are never taken come last. Options as in ``_mixed``.
    """
    placed = materialise(_mixed(docs, **how), "mix-placed")
    return placed.orderBy(*[F.get("positions", F.lit(e)).asc_nulls_last() for e in range(how.get("repeats", REPEATS))], "doc_id", "mark").drop("mark")


def _mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", range_digits: int = RANGE_DIGITS) -> DataFrame:
    """The rows of ``mix`` with ``mark``, a hash of the text."""
    rows = pick(docs, doc_id=id_col, text=text_col, source=source_col)
    rows = rows.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("key"), F.xxhash64("text").alias("mark"))
    rows = materialise(rows, "mix-sizes").withColumn("part", F.substring("key", 1, range_digits))
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    parts = materialise(parts, "mix-parts")
    goal = targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, repeats)
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("part_size").over(earlier), F.lit(0))).select("source", "part", "before")
    parts = materialise(parts.join(goal.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name"), "mix-ranges")
    parts = parts.withColumnsRenamed({"source": "of_source", "part": "of_part"})
    rows = rows.join(parts, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("part") == F.col("of_part")))
    within = Window.partitionBy("source", "part").orderBy("key", "doc_id", "mark").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    rows = rows.withColumn("start", start)
    middle = F.col("start") + F.col("size") / 2
    times = F.greatest(F.least(F.floor((F.col("target") - middle) / F.col("source_size")) + 1, F.lit(repeats)), F.lit(0))
    readings = F.when(F.col("size") == 0, F.coalesce((F.col("start") <= F.col("target")).cast("int"), F.lit(0))).otherwise(times).cast("int")
    rows = rows.withColumn("readings", readings)
    share = lambda e: (middle + e * F.col("source_size")) / F.greatest(F.col("target"), F.lit(1e-9))
    place = lambda e: F.when(e < F.col("readings"), position(share(e), F.pmod(F.col("place"), F.lit(len(weights)))))
    # a reading is taken where the curriculum places it
    placed = F.array_compact(F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), place))
    rows = rows.withColumn("positions", placed).withColumn("copies", F.size("positions"))
    return rows.select(
        "doc_id", "source", "mark", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), "positions",
    )


def mixed_documents(docs: DataFrame, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The documents in training order: each as often as it is taken, range-sorted by position; the columns of ``docs``.

    Equal rows are one document with all their readings. No group is collected:
    every taken row meets its one document and gives a row per reading.
    """
    mixed = _mixed(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how).where("copies > 0")
    places = mixed.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("mark").alias("_mark"), F.col("positions").alias("_positions"))
    own = docs.withColumns({"_own_id": docs[f"`{id_col}`"], "_own_source": docs[f"`{source_col}`"], "_own_mark": F.xxhash64(docs[f"`{text_col}`"])})
    own = own.dropDuplicates(["_own_id", "_own_source", "_own_mark"])
    same = F.col("_own_id").eqNullSafe(F.col("_id")) & F.col("_own_source").eqNullSafe(F.col("_source")) & (F.col("_own_mark") == F.col("_mark"))
    out = own.join(places, same).withColumn("_position", F.explode("_positions"))
    order = [F.col("_position"), F.col("_own_id"), F.col("_own_mark")]
    placed = out.repartitionByRange(partitions, *order) if partitions else out.repartitionByRange(*order)
    return placed.sortWithinPartitions(*order).select(*[F.col(f"`{c}`") for c in docs.columns])
