"""The operators of this package on the given tables, each over its whole table."""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table, shared_dir
from . import (
    byte_bpe, importance, licenses, mixing, packing, prefix_trie, quality_rules, secret_ledger, simhash, statements, token_counts, token_files, toxicity,
    vantage_points,
)


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents", "doc_id", "text")


def op1_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity score and nearest labelled examples of every document."""
    docs = _documents(spark, sf)
    return toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf, "labels", "doc_id", "toxic")))


def op2_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes and byte-level tokens of every document."""
    return token_counts.token_counts(_documents(spark, sf), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op3_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack_documents(_documents(spark, sf), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048)


def op4_token_files(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of every document, written to token files and read back from them."""
    folder = os.path.join(shared_dir(spark), "token-files", uuid.uuid4().hex)
    manifest = token_files.write(_documents(spark, sf), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.read(spark, folder, manifest)


def op5_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and weakly supervised verdict of every document."""
    judged = quality_rules.judge(_documents(spark, sf))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op6_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Words of every document that the mix takes, in training order."""
    mixed = mixing.mix(read_table(spark, sf, "documents", "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_licenses(spark: SparkSession, sf: str) -> DataFrame:
    """Licences whose wording stands in every document."""
    return licenses.licenses(_documents(spark, sf))


def op8_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(_documents(spark, sf))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_vantage_points(spark: SparkSession, sf: str) -> DataFrame:
    """Ten nearest vectors of every hundredth one, among all."""
    table = read_table(spark, sf, "embeddings", "vec_id", "embedding")
    return vantage_points.nearest(table, table.where(F.col("vec_id") % 100 == 0), k=10)


def op10_secret_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets of every document, through a ledger that starts empty."""
    ledger = os.path.join(shared_dir(spark), "secret-ledgers", uuid.uuid4().hex)
    return secret_ledger.digest(secret_ledger.scan(_documents(spark, sf), ledger))


def op11_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of every document's ids, and of the bytes that these decode to."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(_documents(spark, sf), ranks, public_tokenizers.PATTERN)
    decoded = byte_bpe.decode(encoded, ranks)
    return decoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("content", 256).alias("decoded_sha256"),
    )


def op12_importance(spark: SparkSession, sf: str) -> DataFrame:
    """A quarter of the documents, drawn towards the word pairs of the benchmark."""
    drawn = importance.resample(_documents(spark, sf), read_table(spark, sf, "benchmark", "text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations, each branched off the first of its hundred."""
    lists = prefix_trie.turn_lists(read_table(spark, sf, "conversations", "conv_id", "turn", "role", "text"))
    shared = F.crc32(F.col("conv_id").cast("string")) % 6
    return prefix_trie.prefix_trie(prefix_trie.branched(lists, 100, shared.cast("int"), 5))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_token_counts, op3_best_fit_packing, op4_token_files, op5_quality_rules, op6_mixing, op7_licenses, op8_simhash,
        op9_vantage_points, op10_secret_ledger, op11_byte_bpe, op12_importance, op13_prefix_trie,
    )
}
STATEMENTS = statements.STATEMENTS
