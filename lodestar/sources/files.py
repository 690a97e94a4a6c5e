"""Source-file scans and the document cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P

# --- Fixed values. ---
GRAPH_IGNORED = """
.git __pycache__ node_modules .venv venv .idea .vscode dist build vendor target
.next .nuxt .pytest_cache .mypy_cache coverage
""".split()
INDEX_IGNORED = """
.git __pycache__ node_modules .venv venv .idea dist build vendor target .next .nuxt
""".split()
# --- End of fixed values. ---


def scan(spark: SparkSession, root: str, kind: str = "graph", max_size: int | None = None) -> DataFrame:
    """(path, mtime, size, content) of the source files below ``root``.

    The graph scan ignores the case of suffixes, the index scan does not. Names
    and sizes are filtered on the file listing, before any content is read;
    ``max_size`` (bytes) leaves out larger files.
    """
    suffixes, ignored = (P.GRAPH_SUFFIXES, GRAPH_IGNORED) if kind == "graph" else (P.INDEX_SUFFIXES, INDEX_IGNORED)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = root.rstrip("/") + "/"
    relative = F.substring_index("path", prefix, -1)
    name = F.lower(relative) if kind == "graph" else relative
    wanted = F.lit(False)
    for s in suffixes:
        wanted = wanted | name.endswith(s)
    inside = F.arrays_overlap(F.split(relative, "/"), F.array(*[F.lit(d) for d in ignored]))
    small = F.lit(True) if max_size is None else F.col("length") <= max_size
    kept = listed.where(small & wanted & ~inside)
    return kept.select(
        relative.alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"),
        F.decode("content", "UTF-8").alias("content"),
    )


def changed_since(listing: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose (path, mtime, size) is not in the cache: only these need analysis."""
    return listing.join(cache.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_anti")


def refreshed(listing: DataFrame, cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cache rows still valid for the listing plus freshly analysed rows."""
    kept = cache.join(listing.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_semi")
    return kept.unionByName(fresh)


def snapshot_docs(tree: DataFrame, analysed: DataFrame) -> DataFrame:
    """Documents of many commits: tree(commit, path, sha) with analysed(sha, ...).

    A blob is analysed once however many commits and paths share it.
    """
    wanted = F.lit(False)
    for s in P.GRAPH_SUFFIXES:
        wanted = wanted | F.lower("path").endswith(s)
    return tree.where(wanted).join(analysed, "sha")


def blobs_to_analyse(tree: DataFrame, cache: DataFrame) -> DataFrame:
    return tree.select("sha").distinct().join(cache.select("sha"), "sha", "left_anti")
