"""A repository of source files as the tables that the localizer asks, and queries on the derived sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import channels as C, extract, index, resolve, signals as S
from ..session import materialise, read_table
from . import localize as L
from . import sources as D


def repository_of(files: DataFrame, commits: DataFrame | None = None, label: str = "repository") -> L.Repository:
    """The localizer's tables of files(path, content); documents are named by their path.

    ``commits`` (age, subject, files) adds the history of each file. Sources are
    analysed once and stored; the import graph resolves every import, relative
    ones too, among the files themselves.
    """
    files = materialise(files.select("path", F.coalesce("content", F.lit("")).alias("content")), f"{label}-files")
    rows = materialise(extract.extracted(files), f"{label}-analysed")
    n_lines = F.length("content") - F.length(F.regexp_replace("content", "\n", "")) + 1
    docs = files.select(F.col("path").alias("doc"), "path", F.col("content").alias("text"), n_lines.alias("n_lines"))
    named = lambda df: df.withColumnRenamed("path", "doc")
    return L.Repository(
        docs, index.code_term_index(docs, "doc", "text", f"{label}-terms"), materialise(named(extract.definitions(rows, files)), f"{label}-defs"),
        qualified=materialise(named(extract.qualified(rows)), f"{label}-qualified"), literals=materialise(named(extract.literals(rows)), f"{label}-literals"),
        imports=materialise(resolve.import_graph(extract.module_names(rows), files), f"{label}-imports"),
        history=None if commits is None else named(C.history_counts(commits)),
    )


# --------------------------------------------------------- the derived sources
def supplier_reports(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, title, text): every supplier's report, which names one class and its method, and one module."""
    files = D.code_files(spark, sf).select("path", "content", F.regexp_extract("path", r"/p(\d+)[.]", 1).cast("bigint").alias("k"))
    n = read_table(spark, sf, "part", "p_partkey").count()
    suppliers = read_table(spark, sf, "supplier", "s_suppkey").select("s_suppkey", ((F.col("s_suppkey") * 13 + 5) % n).alias("k"))
    cls, method = F.regexp_extract("content", r"class (\w+)", 1), F.regexp_extract("content", r"    def (\w+)", 1)
    name = F.when(method != "", F.concat(cls, F.lit("."), method)).otherwise(cls)
    return suppliers.join(files, "k").select(
        F.col("s_suppkey").alias("query_id"), F.concat(F.lit("Wrong size from "), cls).alias("title"),
        F.concat(F.lit("Calling shop."), name, F.lit(" gives a wrong size.")).alias("text"),
    )


def _sources(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    files = materialise(D.code_files(spark, sf), "code")
    return files, materialise(extract.extracted(files), "extracted")


def localizer_imports(spark: SparkSession, sf: str) -> DataFrame:
    """The import graph of the derived sources, as the localizer walks it."""
    files, rows = _sources(spark, sf)
    return resolve.import_graph(extract.module_names(rows), files)


def _qualified(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    signals = materialise(S.issue_signals(supplier_reports(spark, sf)), "signals")
    return C.qualified_channel(signals, extract.qualified(rows).withColumnRenamed("path", "doc"))


def qualified_channel(spark: SparkSession, sf: str) -> DataFrame:
    """Files that define the class and method a supplier's report names."""
    return _qualified(spark, sf, _sources(spark, sf)[1]).select("query_id", "doc", "value")


def import_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence of those files one import away, in both directions."""
    files, rows = _sources(spark, sf)
    edges = resolve.import_graph(extract.module_names(rows), files)
    return C.neighbor_values(_qualified(spark, sf, rows), edges).select("query_id", "doc", "value")


QUERIES = {f.__name__: f for f in (localizer_imports, qualified_channel, import_neighbours)}
