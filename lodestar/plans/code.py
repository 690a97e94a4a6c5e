"""Queries on source files derived from parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract, graph, index, resolve
from ..session import materialise
from . import sources as D


def _rows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    files = materialise(D.code_files(spark, sf), "code")
    return files, materialise(extract.extracted(files), "extracted")


def code_symbols(spark: SparkSession, sf: str) -> DataFrame:
    _files, rows = _rows(spark, sf)
    return extract.symbols(rows).select("path", "name", "kind", "parent", "is_public")


def code_definitions(spark: SparkSession, sf: str) -> DataFrame:
    files, rows = _rows(spark, sf)
    return extract.definitions(rows, files)


def code_qualified(spark: SparkSession, sf: str) -> DataFrame:
    return extract.qualified(_rows(spark, sf)[1])


def code_literals(spark: SparkSession, sf: str) -> DataFrame:
    return extract.literals(_rows(spark, sf)[1])


def code_index_symbols(spark: SparkSession, sf: str) -> DataFrame:
    files, rows = _rows(spark, sf)
    wide = extract.index_symbols(rows, files)
    return wide.select("path", F.array_join(F.array_sort("symbols"), ",").alias("symbols"))


def code_call_edges(spark: SparkSession, sf: str) -> DataFrame:
    _files, rows = _rows(spark, sf)
    return graph.call_edges(extract.calls(rows), extract.symbols(rows))


def code_import_edges(spark: SparkSession, sf: str) -> DataFrame:
    files, rows = _rows(spark, sf)
    return graph.import_edges(resolve.resolve_imports(extract.imports(rows), files))


def incremental_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Import edges after a change set: files lost their imports, were deleted, and were added.

    Only changed and added files are parsed; the SQL rebuilds the graph from scratch.
    """
    files, rows = _rows(spark, sf)
    part = F.pmod(F.regexp_extract("path", r"/p(\d+)[.]", 1).cast("long"), F.lit(7))
    edited = files.where(part == 0).select("path", F.lit("import os\n").alias("content"))
    deleted = files.where(part == 1).select("path")
    module = F.regexp_replace(F.regexp_extract("path", r"^(.*)[.]", 1), "/", ".")
    added = files.where((part == 2) & F.col("path").endswith(".py")).select(
        F.regexp_replace("path", r"/p(\d+)[.]", "/n$1.").alias("path"), F.concat(F.lit("from "), module, F.lit(" import anything\n")).alias("content")
    )
    fresh = materialise(edited.unionByName(added), "fresh")
    touched = fresh.select("path").unionByName(deleted)
    now = graph.replace_changed(files.select("path", "content"), touched, fresh)
    updated = graph.replace_changed(rows, touched, extract.extracted(fresh))
    return graph.import_edges(resolve.resolve_imports(extract.imports(updated), now))


def code_boosted_top(spark: SparkSession, sf: str) -> DataFrame:
    """Document frequency of terms in the boosted index over the derived sources."""
    files, rows = _rows(spark, sf)
    names = rows.select("path", F.transform("symbols", lambda s: s["name"]).alias("symbols"))
    idx = index.boosted_index(files.join(names, "path"))
    return idx.terms.select("term", "df")


QUERIES = {f.__name__: f for f in (
    code_symbols, code_definitions, code_qualified, code_literals, code_index_symbols, code_call_edges, code_import_edges,
    incremental_graph, code_boosted_top,
)}
