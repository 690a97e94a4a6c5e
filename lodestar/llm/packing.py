"""Best-fit packing into fixed token sequences with certified bin counts.

Pieces are dealt to bounded partitions, each packed best-fit decreasing. Dual
feasible functions give a lower bound for every partition: where the bins meet
it, the partition is certified optimal. Bins with room in the other partitions,
and the emptiest bin of each (its rounding gap), give their pieces back; these
are exchanged into fewer, newly mixed partitions and packed again, until the
total meets the bound over all pieces or a round saves nothing.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialise
from .common import map_batches, pick
from .token_ids import encoder

CAPACITY = 2048
#: Pieces packed together in one task; narrow rows, so a group stays within some MB.
PARTITION_PIECES = 40_000
ROUNDS = 4


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of every document's ids with the end id.

    Longer documents are cut into full pieces, the rest goes first. Null and
    empty texts are one piece that holds the end id; repeated rows are documents
    of their own.
    """
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ])
    end, width = np.array([end_id], dtype="<u4").tobytes(), 4 * capacity

    def make():
        kept = encoder(tokenizer_path)

        def step(batch: pa.RecordBatch) -> dict:
            doc, number, start, length, crc = [], [], [], [], []
            names = batch.column("doc_id").to_pylist()
            for name, ids in zip(names, kept.encode(batch.column("text"))):
                ids += end
                at, stop, k = 0, len(ids) % width or width, 0
                while at < len(ids):
                    doc.append(name)
                    number.append(k)
                    start.append(at // 4)
                    length.append((stop - at) // 4)
                    crc.append(zlib.crc32(ids[at:stop]))
                    at, stop, k = stop, stop + width, k + 1
            return {"doc_id": doc, "piece": number, "start": start, "length": length, "ids_crc32": crc}

        return step

    return map_batches(pick(docs, doc_id=id_col, text=text_col), make, schema)


def lower_bound(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that pieces need at least; ``counts[s]`` pieces have size ``s``.

    The largest bound of the dual feasible functions that, for each threshold
    up to half the capacity, drop sizes below it and raise those above capacity
    minus threshold to full bins.
    """
    sizes = np.arange(capacity + 1)
    number = np.cumsum(counts[::-1])[::-1]  # pieces of at least a size
    volume = np.cumsum((counts * sizes)[::-1])[::-1]
    low = np.arange(capacity // 2 + 1)
    high = capacity - low
    above = np.concatenate((number, [0]))[high + 1]
    between = volume[low] - np.concatenate((volume, [0]))[high + 1]
    return int((above - (-between // capacity)).max(initial=0))


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, and the fill of each bin; the fullest bin with room takes the next largest piece."""
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    fill: list[int] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]  # open bins by free space
    spaces = 0  # bit s is set if some open bin has s free
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = spaces >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            at = with_room[free].pop()
            if not with_room[free]:
                spaces &= ~(1 << free)
        else:
            free, at = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = at, fill[at]
        fill[at] += size
        left = free - size
        if left:
            with_room[left].append(at)
            spaces |= 1 << left
    return bins, offsets, np.array(fill, dtype=np.int64)


_PACKED = "doc_id {id}, piece int, start long, length long, ids_crc32 long, part long, bin long, offset long, gap boolean"


def _round(rows: DataFrame, parts: int, number: int, capacity: int) -> DataFrame:
    """One packing round; bins of a partition that missed its bound, and its emptiest bin, are marked by ``gap``."""
    # the row number keeps repeated rows apart; the rows are read from written files, so it is the same in every attempt
    key = F.pmod(F.xxhash64(F.monotonically_increasing_id(), "doc_id", "piece", F.lit(number)), F.lit(parts))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        lengths = group["length"].to_numpy(dtype=np.int64)
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        certified = len(fill) == lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        room = (capacity - fill)[bins]
        gap = (room > 0) if not certified else bins == int(np.argmin(fill))
        return group.assign(bin=bins, offset=offsets, gap=gap & (room > 0))

    out = rows.select("doc_id", "piece", "start", "length", "ids_crc32").withColumn("part", key + F.lit(number << 36))
    return out.groupBy("part").applyInPandas(pack, _PACKED.format(id=kind))


def pack(rows: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; offsets of a sequence are gapless from 0.

    ``rows`` has the columns of ``pieces``. Partitions hold about
    ``partition_pieces`` pieces whatever the key distribution, since pieces are
    dealt by a hash of row number and name; only counts reach the driver. An empty
    table gives an empty result.
    """
    rows = materialise(rows, "pieces")
    total = rows.count()
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in counts.items():
        histogram[size] = n
    bound = lower_bound(histogram, capacity)
    settled, settled_bins, open_rows, loose, previous, previous_bins, number = None, 0, rows, total, None, 0, 0
    whole = F.col("offset") == 0

    def number_of(test):
        return F.count(F.when(test, 1))

    while True:
        packed = materialise(_round(open_rows, max(1, -(-loose // partition_pieces)), number, capacity), "packed")
        state = packed.agg(number_of(whole).alias("bins"), number_of(F.col("gap")).alias("loose"), number_of(whole & F.col("gap")).alias("loose_bins")).first()
        number, kept = number + 1, packed
        if previous is not None and state["bins"] >= previous_bins:
            kept, done = previous, True  # the exchange saved nothing
        else:
            done = settled_bins + state["bins"] <= bound or number >= rounds or state["loose_bins"] < 2
        if not done:
            kept = packed.where(~F.col("gap"))
            settled_bins += state["bins"] - state["loose_bins"]
            previous, previous_bins, loose = packed.where("gap"), state["loose_bins"], state["loose"]
            open_rows = previous
        settled = kept if settled is None else settled.unionByName(kept)
        if done:
            break
    sequence = (F.call_function("shiftleft", F.col("part"), F.lit(20)) + F.col("bin")).alias("sequence_id")
    return settled.select("doc_id", "piece", "start", "length", "ids_crc32", sequence, "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Tokenise, cut and pack whole documents; see ``pieces`` and ``pack`` for the edge cases."""
    return pack(pieces(docs, tokenizer_path, end_id, capacity, id_col, text_col), capacity, **how)
