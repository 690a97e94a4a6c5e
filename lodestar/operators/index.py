"""Corpus statistics and inverted indexes as plain tables."""

from __future__ import annotations

import os
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import paths as P
from ..functions import text as X
from ..session import in_pieces, materialise, read_if_there, shared_dir

# --- Fixed values: term weights of the two weighted indexes. ---
FILENAME_BOOST = 5
SYMBOL_BOOST = 3
DIRECTORY_BOOST = 2
CONTENT_BOOST = 1
LEGACY_SYMBOL_WEIGHT = 3
LEGACY_IDENTIFIER_WEIGHT = 1
INDEX_MAX_AGE_SECONDS = 3600
# --- End of fixed values. ---
#: Text that one task tokenises and counts.
CHARS_PER_PIECE = 8_000_000


@dataclass
class CorpusIndex:
    """postings(term, doc, tf, dl), terms(term, df), n documents, average length."""

    postings: DataFrame
    terms: DataFrame
    n: int
    avgdl: float
    total_postings: int

    @property
    def documents(self) -> DataFrame:
        return self.postings.groupBy("doc").agg(F.first("dl").alias("dl"))

    def idf(self) -> DataFrame:
        return self.terms.withColumn("idf", idf(F.col("df"), self.n))


def idf(df: Column, n: int | Column) -> Column:
    """ln((N - df + 0.5) / (df + 0.5) + 1); never negative."""
    n = F.lit(float(n)) if isinstance(n, (int, float)) else n
    return F.log((n - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))


def term_frequencies(rows: DataFrame, doc: str, weight: Column | None = None) -> DataFrame:
    """(term, doc, tf, dl) from token rows.

    The rows are expected to come from a frame partitioned by ``doc``: then the
    count per (doc, term) and the length per document need no further shuffle.
    """
    tf = F.sum(weight) if weight is not None else F.count(F.lit(1))
    counted = rows.groupBy(F.col(doc).alias("doc"), "term").agg(tf.cast("bigint").alias("tf"))
    return counted.withColumn("dl", F.sum("tf").over(Window.partitionBy("doc")))


def finish(postings: DataFrame, label: str) -> CorpusIndex:
    """Store the postings and derive the term and corpus statistics from them."""
    stored = materialise(postings, f"{label}-postings")
    return from_postings(stored, label)


def from_postings(stored: DataFrame, label: str) -> CorpusIndex:
    terms = materialise(stored.groupBy("term").agg(F.count(F.lit(1)).alias("df")), f"{label}-terms")
    n, total, rows = stored.agg(
        F.count_distinct("doc"), F.sum("tf").cast("double"), F.count(F.lit(1))
    ).first()
    avgdl = (total / n) if n else 0.0
    return CorpusIndex(stored, terms, n or 0, avgdl, rows or 0)


def code_token_index(docs: DataFrame, doc: str, text: str, label: str = "tokens") -> CorpusIndex:
    """Index over the bag of code tokens of ``text``."""
    rows = X.code_token_rows(in_pieces(docs, doc, CHARS_PER_PIECE, F.length(text)), F.col(text), doc)
    return finish(term_frequencies(rows, doc), label)


def code_term_index(docs: DataFrame, doc: str, text: str, label: str = "terms") -> CorpusIndex:
    """Index over whole identifiers and their sub-tokens."""
    rows = X.code_term_rows(in_pieces(docs, doc, CHARS_PER_PIECE, F.length(text)), F.col(text), doc)
    return finish(term_frequencies(rows, doc), label)


def boosted_rows(files: DataFrame) -> DataFrame:
    """(path, term, weight): name x5, folders x2, symbols x3, content x1.

    ``files`` has path, symbols (array) and content. One exploded array of
    (text, weight) pairs per file keeps this a single pass over the rows.
    """
    folder = F.coalesce(P.directory(F.col("path")), F.lit(""))
    fields = F.array(
        F.struct(P.stem(F.col("path")).alias("text"), F.lit(FILENAME_BOOST).alias("weight")),
        F.struct(folder.alias("text"), F.lit(DIRECTORY_BOOST).alias("weight")),
        F.struct(F.array_join("symbols", " ").alias("text"), F.lit(SYMBOL_BOOST).alias("weight")),
        F.struct(F.col("content").alias("text"), F.lit(CONTENT_BOOST).alias("weight")),
    )
    parts = files.select("path", F.explode(fields).alias("f")).select("path", "f.text", "f.weight")
    return X.code_token_rows(parts, F.col("text"), "path", "weight")


def boosted_index(files: DataFrame, label: str = "boosted") -> CorpusIndex:
    rows = boosted_rows(files.repartition("path"))
    return finish(term_frequencies(rows, "path", F.col("weight")), label)


def legacy_postings(files: DataFrame, max_symbols: int | None = None, max_identifiers: int | None = None) -> DataFrame:
    """(term, doc, tf, dl) from all symbols and identifiers of each file.

    The two limits keep the first values in sorted order, for indexes of a
    fixed size; by default every name is indexed.
    """
    symbols = F.array_distinct("symbols")
    idents = F.array_except("identifiers", "symbols")
    if max_symbols is not None:
        symbols = F.slice(F.array_sort(symbols), 1, max_symbols)
    if max_identifiers is not None:
        idents = F.slice(F.array_sort(idents), 1, max_identifiers)
    sized = files.select("path", symbols.alias("s"), idents.alias("i")).withColumn(
        "dl",
        (F.size("s") * LEGACY_SYMBOL_WEIGHT + F.size("i") * LEGACY_IDENTIFIER_WEIGHT).cast("bigint"),
    )
    tagged = F.concat(
        F.transform("s", lambda t: F.struct(t.alias("term"), F.lit(LEGACY_SYMBOL_WEIGHT).alias("tf"))),
        F.transform("i", lambda t: F.struct(t.alias("term"), F.lit(LEGACY_IDENTIFIER_WEIGHT).alias("tf"))),
    )
    return sized.select("path", "dl", F.explode(tagged).alias("t")).select(
        "t.term", F.col("path").alias("doc"), F.col("t.tf").cast("bigint").alias("tf"), "dl"
    )


def legacy_index(files: DataFrame, label: str = "legacy", **limits: int | None) -> CorpusIndex:
    """Symbol (3) / identifier (1) index; every file counts for N and the mean."""
    stored = materialise(legacy_postings(files, **limits), f"{label}-postings")
    terms = materialise(stored.groupBy("term").agg(F.count(F.lit(1)).alias("df")), f"{label}-terms")
    n = files.count()
    total, rows = stored.agg(F.sum("tf").cast("double"), F.count(F.lit(1))).first()
    return CorpusIndex(stored, terms, n, (total or 0.0) / n if n else 0.0, rows)


# ------------------------------------------------------- save / load / refresh
def save_index(index: CorpusIndex, path: str) -> None:
    """Write an index; ``meta`` goes last, so a half-written index is never loaded."""
    spark = index.postings.sparkSession
    index.postings.write.mode("overwrite").parquet(os.path.join(path, "postings"))
    index.terms.write.mode("overwrite").parquet(os.path.join(path, "terms"))
    meta = [(index.n, index.avgdl, index.total_postings, time.time())]
    spark.createDataFrame(
        meta, "n bigint, avgdl double, total_postings bigint, built_at double"
    ).coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "meta"))


def load_index(spark: SparkSession, path: str, max_age: float | None = None) -> CorpusIndex | None:
    """The stored index, or None when it is missing or too old; an unreadable one raises."""
    meta = read_if_there(spark, os.path.join(path, "meta"))
    if meta is None:
        return None
    n, avgdl, total, built = meta.first()
    if max_age is not None and time.time() - built >= max_age:
        return None
    return CorpusIndex(
        spark.read.parquet(os.path.join(path, "postings")), spark.read.parquet(os.path.join(path, "terms")), n, avgdl, total
    )


def _current(spark: SparkSession, name: str, max_age: float) -> str | None:
    """Folder of the newest stored version of ``name``, or None when it is missing or old."""
    pointers = read_if_there(spark, os.path.join(shared_dir(spark), "indexes", f"{name}.current"))
    newest = None if pointers is None else pointers.orderBy(F.desc("built_at"), "folder").first()
    return newest["folder"] if newest and time.time() - newest["built_at"] < max_age else None


def _publish(spark: SparkSession, name: str, folder: str) -> None:
    """Point ``name`` at a complete version; frames on older versions stay readable.

    Pointers are added, never overwritten, so a reader always sees one, and two
    builders leave two of which the newest counts.
    """
    spark.createDataFrame([(folder, time.time())], "folder string, built_at double").coalesce(1).write.mode(
        "append"
    ).parquet(os.path.join(shared_dir(spark), "indexes", f"{name}.current"))


def _new_version(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), "indexes", f"{name}-{uuid.uuid4().hex}")


def get_or_build_table(spark: SparkSession, name: str, build, max_age: float = INDEX_MAX_AGE_SECONDS) -> DataFrame:
    """Reuse the derived table stored under ``name`` while it is fresh, else build and store it."""
    folder = _current(spark, name, max_age)
    if folder is None:
        folder = _new_version(spark, name)
        build().write.parquet(folder)
        _publish(spark, name, folder)
    return spark.read.parquet(folder)


def get_or_build(spark: SparkSession, name: str, build, max_age: float = INDEX_MAX_AGE_SECONDS) -> CorpusIndex:
    """The same for an index."""
    folder = _current(spark, name, max_age)
    found = load_index(spark, folder) if folder else None
    if found is None:
        folder = _new_version(spark, name)
        save_index(build(), folder)
        _publish(spark, name, folder)
        found = load_index(spark, folder)
    return found
