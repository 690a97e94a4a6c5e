"""The prefix trie of conversations, from vertical bitmaps.

Conversations are range-sorted by id and read in shards. In a shard every
(position, turn) has a posting: the bitset of the conversations with that turn
there. A depth-first walk intersects a node's bitset with the postings of the
next position; each intersection is a child, its set bits are the members, and
the members whose turns are used up end there. Nodes are named by a chained
hash of their turns, so the shards' nodes meet in one aggregation; since shards
are ranges of ids, the shards' lists of ends follow one another in order.

Sums over subtrees need no walk of the merged trie. Every node has an owner, its
smallest member; a conversation's own nodes are the lower end of its path. So the
sum over a node's subtree is the sum of what all its members own, less what the
node's owner owns above the node.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import materialise
from .common import pick

#: A shard ends with the conversation that reaches one of these.
SHARD_CONVERSATIONS = 4_096
SHARD_TURNS = 50_000
KEY_BYTES = 16
EMPTY_LIST = hashlib.sha256(b"").hexdigest()

NODES = T.StructType([
    T.StructField("key", T.BinaryType()), T.StructField("parent_key", T.BinaryType()), T.StructField("depth", T.LongType()),
    T.StructField("chars", T.LongType()), T.StructField("n", T.LongType()), T.StructField("members", T.ArrayType(T.LongType())), T.StructField("ends", T.StringType()),
])


def turn_lists(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, turns)``: each conversation's turns in order, as ``(turn, key, chars)``.

    Null turns come first; equal turn numbers are ordered by the turn's key, so
    reruns agree; repeated rows are turns of their own. Null roles and texts are
    empty. Rows without an id belong to no conversation and are left out; other
    columns are ignored. A key is half a SHA-256 of role and text, so texts are
    neither shuffled nor held; one conversation is handled by one task, as a
    text would be.
    """
    rows = pick(conversations, conv_id=id_col, turn=turn_col, role=role_col, text=text_col).where("conv_id is not null")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    turn = F.struct("turn", F.substring(digest, 1, KEY_BYTES).alias("key"), F.length(text).cast("long").alias("chars"))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn")).groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))


def branched(lists: DataFrame, group: int, shared: Column, most: int) -> DataFrame:
    """Conversations rebuilt as branches of the first of their ``group``: its first turns, then their own after as many.

    ``shared`` is the number of turns taken (at most ``most``), from ``conv_id``; all are taken
    where there are fewer, none where the first conversation is absent. A rebuilt
    conversation may be without turns. At most ``group`` rows join with one.
    """
    heads = lists.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("_head"), F.slice("turns", 1, most).alias("_first"))
    own = lists.withColumn("_h", shared).withColumn("_of", F.col("conv_id") - F.col("conv_id") % group)
    joined = own.join(heads, F.col("_of") == F.col("_head"), "left")
    rest = F.slice("turns", F.col("_h") + 1, F.size("turns"))
    return joined.select("conv_id", F.when(F.col("_first").isNull(), rest).otherwise(F.concat(F.slice("_first", F.lit(1), F.col("_h")), rest)).alias("turns"))


def _members(bits: int, ids: list[int]) -> list[int]:
    out = []
    while bits:
        low = bits & -bits
        out.append(ids[low.bit_length() - 1])
        bits ^= low
    return out


def shard_nodes(ids: list[int], turns: list[list[tuple[bytes, int]]]) -> Iterator[tuple]:
    """Rows of ``NODES`` for one shard; ``ids`` ascend and ``turns`` holds the (key, characters) of each one's turns."""
    postings, lengths = defaultdict(int), defaultdict(int)
    for i, own in enumerate(turns):
        lengths[len(own)] |= 1 << i
        for position, (key, _) in enumerate(own):
            postings[position, key] |= 1 << i
    stack = [(0, (1 << len(ids)) - 1, hashlib.sha256(b"").digest()[:KEY_BYTES], None, 0)]
    while stack:
        depth, bits, key, parent, chars = stack.pop()
        ended = bits & lengths.get(depth, 0)
        ends = ",".join(map(str, _members(ended, ids))) if ended else None
        yield key, parent, depth, chars, bits.bit_count(), _members(bits, ids), ends
        rest = bits & ~ended
        while rest:
            turn, size = turns[(rest & -rest).bit_length() - 1][depth]
            child = bits & postings[depth, turn]
            rest &= ~child
            stack.append((depth + 1, child, hashlib.sha256(key + turn).digest()[:KEY_BYTES], key, size))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    arrow = to_arrow_schema(NODES)

    def rows(ids: list[int], turns: list) -> pa.RecordBatch:
        columns = zip(*shard_nodes(ids, turns))
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

    ids, turns, held = [], [], 0
    for batch in batches:
        for conv_id, own in zip(batch.column("conv_id").to_pylist(), batch.column("turns").to_pylist()):
            ids.append(conv_id)
            turns.append([(t["key"], t["chars"]) for t in own])
            held += len(own)
            if len(ids) >= SHARD_CONVERSATIONS or held >= SHARD_TURNS:
                yield rows(ids, turns)
                ids, turns, held = [], [], 0
    if ids:
        yield rows(ids, turns)


def _list_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's lists, read in order; one running digest is held, whatever a key's size."""
    current, digest = None, None
    for batch in batches:
        keys, digests = [], []
        for key, ends in zip(batch.column("key").to_pylist(), batch.column("ends").to_pylist()):
            if key == current:
                digest.update(b"," + ends.encode())
                continue
            if digest:
                keys.append(current)
                digests.append(digest.hexdigest())
            current, digest = key, hashlib.sha256(ends.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], names=["key", "ends_sha256"])
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([current], pa.binary()), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])


def prefix_trie(lists: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations ``(conv_id, turns)``; ids are unique.

    ``conv_id`` (smallest member) and ``depth`` name a node; ``parent_conv_id`` is
    null at the root; ``n_convs`` counts members, ``n_children`` children,
    ``n_leaves`` childless nodes of the subtree, ``saved_tokens`` the characters
    that sharing saves in the subtree (every node's last text, times its members
    but one), ``ends_sha256`` the digest of the ascending, comma-joined ids of
    members without further turns (of nothing, where there are none).
    Conversations without turns are members of the root alone; copies share all
    nodes; without any conversation there is no node.
    """
    ordered = lists.repartitionByRange("conv_id").sortWithinPartitions("conv_id")
    parts = materialise(ordered.mapInArrow(_shards, NODES), "trie-shards")

    merged = parts.groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.max("depth").alias("depth"), F.max("chars").alias("chars"),
        F.sum("n").alias("n_convs"), F.min(F.element_at("members", 1)).alias("owner"),
    )
    merged = materialise(merged, "trie-nodes")
    children = merged.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    # values of a conversation's own nodes, and those above each, stay within its own path
    above = Window.partitionBy("owner").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    nodes = merged.join(children, "key", "left").select(
        "key", "depth", "n_convs", "owner", F.coalesce("n_children", F.lit(0)).alias("n_children"), ((F.col("n_convs") - 1) * F.col("chars")).alias("_value"),
    ).withColumn("_above", F.coalesce(F.sum("_value").over(above), F.lit(0)))
    nodes = materialise(nodes, "trie-counts")
    owned = nodes.groupBy("owner").agg(F.sum("_value").alias("_saved"), F.sum((F.col("n_children") == 0).cast("long")).alias("_leaves"))

    # members of shared nodes: with what each owns, and with the deepest node on its path that another one owns
    shared = nodes.where("n_convs > 1").select("key", "depth", "owner")
    paths = parts.select("key", "members").join(shared, "key").select("key", "depth", "owner", F.explode("members").alias("member"))
    paths = materialise(paths, "trie-paths")
    sums = paths.join(owned.withColumnRenamed("owner", "member"), "member").groupBy("key").agg(F.sum("_saved").alias("_saved"), F.sum("_leaves").alias("_leaves"))
    tops = paths.where("owner <> member").groupBy(F.col("member").alias("owner")).agg(F.max("depth").alias("_top"), F.max_by("owner", "depth").alias("_parent"))

    listed = parts.where("ends is not null").select("key", "ends", F.element_at("members", 1).alias("_first"))
    digests = listed.repartition("key").sortWithinPartitions("key", "_first").drop("_first").mapInArrow(_list_digests, "key binary, ends_sha256 string")
    parent = F.when(F.col("depth") == 0, F.lit(None)).when(F.col("_top") == F.col("depth") - 1, F.col("_parent")).otherwise(F.col("owner"))
    return nodes.join(sums, "key", "left").join(digests, "key", "left").join(tops, "owner", "left").select(
        F.col("owner").alias("conv_id"), "depth", parent.cast("long").alias("parent_conv_id"), "n_convs", "n_children",
        F.coalesce("_leaves", F.lit(1)).alias("n_leaves"), F.coalesce(F.col("_saved") - F.col("_above"), F.lit(0)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_LIST)).alias("ends_sha256"),
    )
