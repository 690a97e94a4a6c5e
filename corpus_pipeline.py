"""The corpus pipeline: five stages over ``documents``, each on all its predecessor kept.

1. toxicity: documents scored as toxic go.
2. near-duplicates: of each SimHash component the smallest doc_id stays.
3. secrets: every finding is replaced by its kind in brackets, and n_chars follows; all documents stay.
4. mixing: documents are repeated or left out so that sources come near their targets, in training order.
5. packing: the documents become pieces of token sequences.

Every stage is written and read again by its caller, so an executor lost in one
stage does not reach back into the others.
"""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import mixing, packing, secret_ledger, simhash, toxicity
from lodestar.session import materialise, read_table, shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from the labelled ones among ``docs``."""
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.without_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.representatives(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the secrets in their texts; the ledger of a run starts empty."""
    ledger = os.path.join(shared_dir(spark), "secret-ledgers", uuid.uuid4().hex)
    return secret_ledger.redact(docs, ledger, length_col="n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES = [
    ("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("secrets", redact_secrets),
    ("mixing", mix_sources), ("packing", pack_sequences),
]
#: Scores, fingerprints and tokens have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; what each keeps is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = materialise(docs, f"stage-{name}")
    return docs
