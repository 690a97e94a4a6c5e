"""Helpers the training-data operators share: batch maps, hex and word columns, components of a link table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import materialise

#: Words are maximal runs of anything but the six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]+"
SLICE_ROWS = 3_000


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named input columns, under internal names, so that no extra column can clash."""
    return df.select(*[df[f"`{source}`"].alias(name) for name, source in columns.items()])


def words_of(text: Column) -> Column:
    """Array of the words of a text; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: T.StructType) -> DataFrame:
    """Run a batch function over a table; ``make`` builds its state once per task.

    The function returns the new columns by name. Spark bounds each batch by
    rows and by bytes, so very long texts arrive in small batches; they are
    handed on in slices, and memory goes back when the task ends, as the worker
    process stays for other tasks.
    """
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                out = step(batch.slice(start, SLICE_ROWS))
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate an expensive expression once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def components(links: DataFrame, label: str) -> DataFrame:
    """Connected components of ``links(u, v)``: rows ``(node, root)`` for every linked node but the root.

    The root is a component's smallest node. Large-star and small-star rounds
    alternate until the edge set no longer changes; each round is written to the
    shared folder, so lost executors re-read it and the plan stays short. Only
    three numbers per round reach the driver. Null ends and loops are ignored.
    """
    edges = links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialise(edges, f"{label}-edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), f"{label}-edges")
        mark = F.xxhash64("u", "v")
        state = edges.agg(F.count(F.lit(1)), F.sum(mark.bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftright(mark, 32))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
