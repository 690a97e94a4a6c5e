"""Importance resampling of documents towards a target distribution of hashed n-grams.

A document's separators are normalised and it is scanned once; the CRC-32 of its
text up to the end of each word is stored. The CRC of any n-gram follows from
two of these: appending L bytes to a text shifts its CRC by a linear map over
GF(2), so shifting the CRC before the n-gram by the n-gram's length and adding it
to the CRC after it cancels everything before. Counts of the corpus and weights
of documents both come from the stored CRCs; the texts are not read again.

A feature's gain is the logarithm of its bucket's share in the target against
its share in the corpus; a document's weight is its mean gain. Documents are
drawn without replacement by weight plus Gumbel noise from a hash of the id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import ranked
from ..session import materialise
from .common import SLICE_ROWS, map_batches, pick

#: ASCII letters in lower case, digits and all bytes of other characters make words; everything else separates.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Base-64 digits of a byte length: n-grams up to 2^36 bytes.
DIGITS, DIGIT_BITS = 6, 6
CRC_POLYNOMIAL = 0xEDB88320
#: n-grams handled at a time.
STEP_GRAMS = 400_000


@lru_cache(maxsize=1)
def shift_tables() -> np.ndarray:
    """Flat tables ``[digit place][digit][byte place][byte]`` of the map that appends that many zero bytes to a CRC."""

    def table(columns: np.ndarray) -> np.ndarray:
        """Images of the four bytes of a CRC under the map whose images of single bits are ``columns``."""
        out = np.zeros((4, 256), dtype=np.uint32)
        for byte in range(4):
            for bit in range(8):
                out[byte, 1 << bit:2 << bit] = out[byte, :1 << bit] ^ columns[8 * byte + bit]
        return out

    def apply(t: np.ndarray, crcs: np.ndarray) -> np.ndarray:
        return t[0, crcs & 255] ^ t[1, crcs >> 8 & 255] ^ t[2, crcs >> 16 & 255] ^ t[3, crcs >> 24]

    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    one = bits.copy()
    for _ in range(8):
        one = (one >> 1) ^ np.where(one & 1, np.uint32(CRC_POLYNOMIAL), np.uint32(0))
    tables = np.zeros((DIGITS, 1 << DIGIT_BITS, 4, 256), dtype=np.uint32)
    for place in range(DIGITS):
        step, columns = table(one), bits
        for digit in range(1 << DIGIT_BITS):
            tables[place, digit] = table(columns)
            columns = apply(step, columns)
        one = columns  # 64 steps of this place are one of the next
    return tables.ravel()


def shifted(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC after as many zero bytes as its length says."""
    tables, crcs = shift_tables(), crcs.astype(np.uint32)
    for place in range(DIGITS):
        rest = lengths >> DIGIT_BITS * place
        some = slice(None) if place == 0 else np.flatnonzero(rest)
        if place and not len(some):
            break
        at = (((rest[some] & (1 << DIGIT_BITS) - 1) + (place << DIGIT_BITS)) << 10).astype(np.int64)
        c = crcs[some]
        crcs[some] = tables[at + (c & 255)] ^ tables[at + 256 + (c >> 8 & 255)] ^ tables[at + 512 + (c >> 16 & 255)] ^ tables[at + 768 + (c >> 24)]
    return crcs


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, crcs, lengths)`` of every row: per word the CRC of the normalised text up to its end, and its bytes.

    Both arrays are little-endian unsigned 32-bit integers. A null or empty text
    has no words; texts are scanned whole; repeated rows and null ids stay, other
    columns are ignored, and an empty table gives no rows.
    """
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("crcs", T.BinaryType()), T.StructField("lengths", T.BinaryType()),
    ])

    def step(batch: pa.RecordBatch) -> dict:
        counts, crcs, lengths = [], [], []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            words = (text or b"").translate(_WORD_BYTES).split()
            counts.append(len(words))
            lengths.append(np.fromiter(map(len, words), dtype="<u4", count=len(words)).tobytes())
            parts = words[:1] + [b" " + w for w in words[1:]]
            running = accumulate(parts, lambda crc, part: crc32(part, crc), initial=0)
            next(running)
            crcs.append(np.fromiter(running, dtype="<u4", count=len(words)).tobytes())
        return {"doc_id": batch.column("doc_id"), "n_words": counts, "crcs": crcs, "lengths": lengths}

    return map_batches(pick(docs, doc_id=id_col, text=text_col), lambda: step, schema)


class Grams:
    """Buckets of all n-grams of a batch of scanned documents, from their stored CRCs."""

    def __init__(self, batch: pa.RecordBatch, buckets: int):
        self.buckets = buckets
        self.words = batch.column("n_words").to_numpy(zero_copy_only=False)
        self.first = np.cumsum(self.words) - self.words
        self.ends = np.frombuffer(b"".join(batch.column("crcs").to_pylist()), dtype="<u4")
        lengths = np.frombuffer(b"".join(batch.column("lengths").to_pylist()), dtype="<u4").astype(np.int64)
        self.bytes_before = np.concatenate(([0], np.cumsum(lengths + 1)))

    def of(self, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Number of the document and bucket of every n-gram, a bounded number at a time."""
        counts = np.maximum(self.words - (n - 1), 0)
        ends = np.cumsum(counts)
        for start in range(0, int(counts.sum()), STEP_GRAMS):
            place = np.arange(start, min(start + STEP_GRAMS, int(ends[-1])))
            owner = np.searchsorted(ends, place, side="right")
            at = place - (ends - counts)[owner] + self.first[owner]
            # the CRC before a word: that of the word before, and a blank; nothing at the start of a document
            before = shifted(self.ends[at - 1], np.ones(len(at), dtype=np.int64)) ^ np.uint32(crc32(b" "))
            before[at == self.first[owner]] = 0
            size = self.bytes_before[at + n] - self.bytes_before[at] - 1
            crc = self.ends[at + n - 1] ^ shifted(before, size)
            yield owner, (crc % np.uint32(self.buckets)).astype(np.int64)


def bucket_counts(scanned: DataFrame, sizes: tuple[int, ...] = (1, 2), buckets: int = 10_000) -> DataFrame:
    """``(bucket, n)``: features of a scanned table by bucket; each task hands on at most one row a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                grams = Grams(batch.slice(start, SLICE_ROWS), buckets)
                for n in sizes:
                    for _, found in grams.of(n):
                        counts += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used], pa.int64())], names=["bucket", "n"])

    return scanned.select("n_words", "crcs", "lengths").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Thousandths of each bucket's log ratio, target to corpus, both smoothed by one; at most ``buckets`` rows reach the driver."""
    spark = corpus.sparkSession
    total = {name: counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] for name, counts in (("S", corpus), ("T", target))}
    both = spark.range(buckets).withColumnRenamed("id", "bucket").join(corpus.withColumnRenamed("n", "s"), "bucket", "left")
    both = both.join(target.withColumnRenamed("n", "t"), "bucket", "left").select("bucket", *[F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in "st"])
    ratio = (F.col("t") + 1) * F.lit(float(total["S"] + buckets)) / ((F.col("s") + 1) * F.lit(float(total["T"] + buckets)))
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, gain in both.select("bucket", F.floor(1000 * F.ln(ratio))).collect():
        out[bucket] = gain
    return out


def weights(scanned: DataFrame, gain: np.ndarray, sizes: tuple[int, ...] = (1, 2)) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)``: the floored mean gain of each document's features, 0 without any."""
    schema = T.StructType([scanned.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]])

    def step(batch: pa.RecordBatch) -> dict:
        grams = Grams(batch, len(gain))
        features, total = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows, dtype=np.int64)
        for n in sizes:
            features += np.maximum(grams.words - (n - 1), 0)
            for owner, found in grams.of(n):
                # sums of integers far below 2^53, so exact
                total += np.bincount(owner, weights=gain[found], minlength=batch.num_rows).astype(np.int64)
        return {"doc_id": batch.column("doc_id"), "n_words": grams.words, "n_features": features, "weight": total // np.maximum(features, 1)}

    return map_batches(scanned, lambda: step, schema)


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate, from a hash of seed and id; a null id reads as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, sizes: tuple[int, ...] = (1, 2), buckets: int = 10_000, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score, rank)`` of every row; ``rank`` is null where a document is not drawn.

    Of the documents of at least ``min_words`` words, ``percent`` in a hundred
    (rounded down) are drawn: highest score first, ties to the smaller id, null
    ids last, then by features and weight. Null and empty texts have no features
    and weight 0; repeated rows are ranked one by one; an empty target leaves all
    features unseen there, and an empty corpus gives no rows. Other columns are
    ignored. The ranks come from one sort over the whole cluster.
    """
    scanned = materialise(scan(docs, id_col, text_col), "prefix-crcs")
    aimed = scan(target.select(target[f"`{target_text_col}`"].alias("text")).withColumn("doc_id", F.lit(None).cast("long")))
    counted = [materialise(bucket_counts(s, sizes, buckets), "bucket-counts") for s in (scanned, aimed)]
    scored = weights(scanned, gains(*counted, buckets), sizes).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = materialise(scored.withColumn("_fits", F.col("n_words") >= min_words), "importance")
    drawn = scored.where("_fits").count() * percent // 100
    order = [F.col("_fits").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    placed = ranked(scored, [], order, "rank", "long")
    return placed.select(
        "doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("_fits") & (F.col("rank") <= drawn), F.col("rank")).alias("rank"),
    )
