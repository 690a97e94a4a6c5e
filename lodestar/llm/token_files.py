"""Token-id files: each document compressed on its own with one shared zstandard dictionary, and an index of offsets.

A folder holds ``dictionary.zdict`` and shards. A shard is: the magic, the
SHA-256 of the dictionary and the width of an id; the compressed documents one
after another; the index (doc_id, whether it is null, offset, compressed size,
number of ids, as little-endian arrays); and a footer with the index's offset,
the number of documents and the magic. A short document is read with one seek
and without its neighbours. Shards are in ascending doc_id order, nulls first.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .common import pick
from .token_ids import encoder, library

MAGIC = b"LODETOK1"
HEADER = "<8s32sB"
FOOTER = "<QQ8s"
#: Documents in a shard (shards are streamed, never held whole), documents the dictionary is fitted on, bytes taken of one, and its size.
SHARD_DOCS = 16_384
SAMPLE_DOCS = 2_000
SAMPLE_BYTES = 16_384
DICTIONARY_BYTES = 65_536
LEVEL = 3

_INDEX = (("doc_id", "<i8"), ("is_null", "u1"), ("offset", "<u8"), ("size", "<u4"), ("n_tokens", "<u8"))


def _filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """Arrow's file system for a folder as Spark names it."""
    if "://" not in uri and not uri.startswith("file:"):
        uri = f"file://{uri}"
    return pa.fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri))


def _put(uri: str, write) -> None:
    """Write a file under a passing name and give it its name at the end, so that a lost or repeated task leaves whole files."""
    fs, path = _filesystem(uri)
    passing = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(passing) as out:
        write(out)
    fs.move(passing, path)


def fit_dictionary(docs: DataFrame, tokenizer_path: str, width: int, sample_docs: int = SAMPLE_DOCS) -> bytes:
    """A dictionary trained on the serialised ids of a bounded sample chosen by a hash of doc_id; empty if there is too little."""
    total = docs.count()
    share = min(1.0, sample_docs / max(total, 1))
    drawn = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).select("text")

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = encoder(tokenizer_path)
        for batch in batches:
            ids = [np.frombuffer(b, "<u4").astype(f"<u{width}").tobytes()[:SAMPLE_BYTES] for b in kept.encode(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.binary())], names=["ids"])

    got = [bytes(r["ids"]) for r in drawn.mapInArrow(sample, "ids binary").where(F.length("ids") > 0).limit(2 * sample_docs).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, got).as_bytes() if got else b""
    except zstandard.ZstdError:  # the library finds the sample too small or too even
        return b""


def _codec(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Encode every text, append ``end_id``, write the shards and return the manifest.

    Null and empty texts hold the end id alone; rows with the same doc_id are
    documents of their own, in the order of their texts' hashes. Manifest:
    ``(shard, path, n_docs, n_tokens)``. An empty table gives no shard.
    """
    spark = docs.sparkSession
    docs = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    width = 2 if max(library(tokenizer_path).get_vocab_size(True), end_id + 1) <= 65_536 else 4
    dictionary = fit_dictionary(docs, tokenizer_path, width)
    fs, path = _filesystem(folder)
    fs.create_dir(path, recursive=True)
    _put(f"{folder}/dictionary.zdict", lambda out: out.write(dictionary))
    shards = max(spark.sparkContext.defaultParallelism, -(-docs.count() // shard_docs))
    last = np.array([end_id], dtype="<u4").tobytes()

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        target = f"{folder}/shard-{number:08d}.ltok"
        kept = encoder(tokenizer_path)
        pack = zstandard.ZstdCompressor(level=LEVEL, **_codec(dictionary))
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        docs_tokens = [0, 0]

        def body(out) -> None:
            out.write(struct.pack(HEADER, MAGIC, hashlib.sha256(dictionary).digest(), width))
            at, columns = struct.calcsize(HEADER), {name: [] for name, _ in _INDEX}
            for batch in chain([first], batches):
                for name, ids in zip(batch.column("doc_id").to_pylist(), kept.encode(batch.column("text"))):
                    ids = np.frombuffer(ids + last, dtype="<u4")
                    frame = pack.compress(ids.astype(f"<u{width}").tobytes())
                    out.write(frame)
                    for key, value in zip(columns, (name or 0, name is None, at, len(frame), len(ids))):
                        columns[key].append(value)
                    at += len(frame)
                    docs_tokens[1] += len(ids)
            docs_tokens[0] = len(columns["doc_id"])
            for name, kind in _INDEX:
                out.write(np.array(columns[name]).astype(kind).tobytes())
            out.write(struct.pack(FOOTER, at, docs_tokens[0], MAGIC))

        _put(target, body)
        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([target]), pa.array([docs_tokens[0]]), pa.array([docs_tokens[1]])], names=["shard", "path", "n_docs", "n_tokens"])

    placed = docs.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    return materialise(placed.mapInArrow(shard, "shard long, path string, n_docs long, n_tokens long"), "token-manifest")


class Shard:
    """Reads documents of one shard by position."""

    def __init__(self, path: str, dictionary: bytes):
        fs, name = _filesystem(path)
        self.file = fs.open_input_file(name)
        size = self.file.size()
        self.file.seek(size - struct.calcsize(FOOTER))
        index_at, n, magic = struct.unpack(FOOTER, self.file.read(struct.calcsize(FOOTER)))
        self.file.seek(0)
        head, digest, self.width = struct.unpack(HEADER, self.file.read(struct.calcsize(HEADER)))
        if magic != MAGIC or head != MAGIC:
            raise ValueError(f"{path} is not a token file")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError(f"{path} was written with another dictionary")
        self.file.seek(index_at)
        self.index = {name: np.frombuffer(self.file.read(n * np.dtype(kind).itemsize), dtype=kind) for name, kind in _INDEX}
        self.unpack = zstandard.ZstdDecompressor(**_codec(dictionary))
        self.length = n

    def ids(self, position: int) -> np.ndarray:
        """Ids of a document, read with one seek."""
        self.file.seek(int(self.index["offset"][position]))
        raw = self.unpack.decompress(self.file.read(int(self.index["size"][position])))
        return np.frombuffer(raw, dtype=f"<u{self.width}").astype("<u4")


def _dictionary(folder: str) -> bytes:
    fs, path = _filesystem(folder)
    with fs.open_input_file(f"{path}/dictionary.zdict") as f:
        return f.read()


def read(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document of the shards, read from the files.

    ``start`` counts the ids of all documents before it. One task reads whole
    shards; only the manifest's token counts are summed in order.
    """
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", "shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dictionary = None
        for frame in frames:
            for path, base in zip(frame["path"], frame["base"]):
                dictionary = _dictionary(folder) if dictionary is None else dictionary
                shard = Shard(path, dictionary)
                counts = shard.index["n_tokens"].astype(np.int64)
                crc = [zlib.crc32(shard.ids(i).tobytes()) for i in range(shard.length)]
                names = pd.array(shard.index["doc_id"], dtype="Int64")
                names[shard.index["is_null"].astype(bool)] = pd.NA
                yield pd.DataFrame({"doc_id": names, "start": base + np.cumsum(counts) - counts, "n_tokens": counts, "ids_crc32": crc})

    return placed.repartition(spark.sparkContext.defaultParallelism * 2, "shard").mapInPandas(load, schema)
