"""Near-duplicates by 64-bit SimHash fingerprints and Golay-code fuzzy hashing.

A fingerprint is cut into segments of 23, 23 and 18 bits. With two differing
bits or fewer, some segment is equal (pigeonhole) and the next one differs in at
most two bits. Balls of radius one around two words at distance two share a
point, and the perfect binary Golay code decodes that point to one codeword:
so the codeword indices of all points of a ball (one or six of them) are keys
under which the two segments meet. One key is (equal segment, codeword index of
the next segment), so a fingerprint has 3 to 18 keys. Fingerprints that meet are
verified by their exact distance.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .common import components, map_batches, pick

SHINGLE = 3
MAX_BITS = 2
SEED = 42
#: Buckets with more distinct fingerprints are linked through their shared radius-one points instead of by pairs.
PAIRED_BUCKET = 48
#: Generator polynomial of the binary Golay code (23, 12, 7); a fixed value.
GOLAY = 0b101011100011
SEGMENTS = ((0, 23), (23, 23), (46, 18))

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE = (np.arange(8, dtype=np.int64) * 256)[None, :]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text; null and blank texts give zero.

    A-Z are lower-cased, words are split at ASCII white space, shingles count as
    often as they occur, and a text shorter than a shingle is one shingle.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())], dtype="<u8")
    seen = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _BYTE).ravel(), minlength=2048).reshape(8, 256)
    ones = (seen @ _BITS).ravel()
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` for every row; ``fp`` is the fingerprint as a signed long."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def make():
        def step(batch: pa.RecordBatch) -> dict:
            values = [fingerprint(t, shingle) for t in batch.column("text").to_pylist()]
            return {"doc_id": batch.column("doc_id"), "fp": np.array(values, dtype=np.uint64).view(np.int64)}
        return step

    return map_batches(pick(docs, doc_id=id_col, text=text_col), make, schema)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders by the generator of the low 12 and the high 11 bits, and the error pattern of each remainder."""
    def remainder(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GOLAY << (bit - 11)
        return word

    low = np.array([remainder(w) for w in range(4096)], dtype=np.int64)
    high = np.array([remainder(w << 12) for w in range(2048)], dtype=np.int64)
    errors = np.zeros(2048, dtype=np.int64)
    for weight in (1, 2, 3):
        for places in combinations(range(23), weight):
            pattern = sum(1 << p for p in places)
            errors[remainder(pattern)] = pattern
    return low, high, errors


def codeword_index(words: np.ndarray) -> np.ndarray:
    """Twelve message bits of the codeword nearest to each 23-bit word (always within three bits)."""
    low, high, errors = _tables()
    return (words ^ errors[low[words & 4095] ^ high[words >> 12]]) >> 11


def ball_indices(words: np.ndarray) -> np.ndarray:
    """Sorted codeword indices of the 24 words within one bit of each word, as rows (with repeats)."""
    flips = np.concatenate(([0], 1 << np.arange(23, dtype=np.int64)))
    return np.sort(codeword_index(words[:, None] ^ flips[None, :]), axis=1)


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of signed fingerprints: fingerprints within two bits share at least one key."""
    unsigned = fps.view(np.uint64)
    parts = [((unsigned >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    rows, keys = [], []
    for i, exact in enumerate(parts):
        index = ball_indices(parts[(i + 1) % 3])
        fresh = np.ones(index.shape, dtype=bool)
        fresh[:, 1:] = index[:, 1:] != index[:, :-1]
        row, column = np.nonzero(fresh)
        rows.append(row)
        keys.append((i << 36) | (exact[row] << 12) | index[row, column])
    return np.concatenate(rows), np.concatenate(keys)


def keyed(fps: DataFrame) -> DataFrame:
    """``(fp, key)``: 3 to 18 rows for each distinct fingerprint."""
    def make():
        def step(batch: pa.RecordBatch) -> dict:
            values = batch.column("fp").to_numpy(zero_copy_only=False)
            rows, keys = fuzzy_keys(values)
            return {"fp": values[rows], "key": keys}
        return step

    return map_batches(fps.select("fp"), make, T.StructType([T.StructField("fp", T.LongType()), T.StructField("key", T.LongType())]))


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def links(distinct_fps: DataFrame) -> DataFrame:
    """Links ``(u, v)`` that connect exactly the fingerprints within two bits of each other.

    Buckets of up to PAIRED_BUCKET fingerprints give their verified pairs.
    Larger ones would give a square: their fingerprints are grouped by the 65
    points within one bit instead. Two fingerprints share such a point exactly
    if they differ in two bits or fewer, so a star per point keeps every
    component, at a cost that grows with the fingerprints alone.
    """
    keys = materialise(keyed(distinct_fps), "simhash-keys")
    sizes = materialise(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-buckets")
    members = keys.join(sizes, "key")
    cold = members.where(F.col("n") <= PAIRED_BUCKET)
    pairs = (
        cold.select("key", F.col("fp").alias("u")).join(cold.select("key", F.col("fp").alias("v")), "key")
        .where(F.col("u") < F.col("v")).where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS)
        .select("u", "v")
    )
    hot = members.where(F.col("n") > PAIRED_BUCKET).select("fp").distinct()
    flips = F.transform(F.sequence(F.lit(-1), F.lit(63)), lambda b: F.when(b < 0, F.col("fp")).otherwise(
        F.col("fp").bitwiseXOR(_bit(F.greatest(b, F.lit(0))))))
    points = hot.select("fp", F.explode(flips).alias("point"))
    stars = points.groupBy("point").agg(F.min("fp").alias("u"), F.max("fp").alias("top")).where("u <> top").select("point", "u")
    shared = points.join(stars, "point").where("fp <> u").select("u", F.col("fp").alias("v"))
    return pairs.unionByName(shared).distinct()


def _groups(marked: DataFrame) -> DataFrame:
    """``(fp, first_id, root)`` of every distinct fingerprint; ``first_id`` is the smallest doc_id of its rows."""
    nodes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-nodes")
    roots = components(links(nodes), "simhash")
    return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row, whole groups whatever their size.

    Equal fingerprints are one node, so copies never meet as pairs. The
    component is named by its smallest non-null doc_id. Null, empty and blank
    texts share fingerprint zero and are linked like any other; repeated rows
    stay repeated; an empty table gives an empty result; other columns are
    ignored.
    """
    marked = materialise(fingerprints(docs, id_col, text_col, shingle), "simhash")
    named = _groups(marked)
    names = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = materialise(named.join(names, "root").select("fp", "component_id"), "simhash-components")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that remain when one document of each near-duplicate group stays (all columns kept).

    The row of a group's smallest doc_id stays, once, also if it is repeated; a
    group without any doc_id keeps one of its rows. Rows are told apart by doc_id
    and text, so every group keeps its own row, whatever ids other groups have.
    """
    doc_id, text = docs[f"`{id_col}`"], docs[f"`{text_col}`"]
    shown = doc_id.cast("string")
    # the length makes id and text unambiguous; equal ids and texts are always in one group
    mark = F.sha2(F.concat(F.coalesce(F.concat(F.length(shown), F.lit(":"), shown), F.lit("-")), F.coalesce(text, F.lit(""))), 256)
    rank = F.struct(doc_id.isNull().alias("none"), doc_id.alias("id"), mark.alias("mark"))
    marked = materialise(fingerprints(docs.select(rank.alias("doc_id"), text.alias("text"))), "simhash")
    found = _groups(marked).groupBy("root").agg(F.min("first_id").alias("first")).select(F.col("first.mark").alias("_keep"))
    return docs.withColumn("_mark", mark).join(found, F.col("_mark") == F.col("_keep"), "left_semi").dropDuplicates(["_mark"]).drop("_mark")
