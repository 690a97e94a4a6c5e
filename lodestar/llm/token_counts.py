"""Token counts of whole texts by rank-synchronous merging over ragged arrays.

The different pieces of a batch are cut into pre-tokens; all pre-tokens lie end
to end in one array of symbols with the number of the sequence beside each. In
every round each sequence finds its lowest-ranked neighbouring pair and all
sequences apply theirs at once, wherever it occurs from the left. A sequence
leaves the array when no pair has a rank; its symbols are its tokens.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, pick
from .token_ids import STEP_TEXTS, Cache, cut

#: Pre-token pattern of byte-level tokenizers; a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters merged at a time.
MERGE_SYMBOLS = 2_000_000
NO_RANK = np.iinfo(np.int64).max


class Merges:
    """Byte symbols and pair ranks of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or spec["pre_tokenizer"].get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError(f"{path} is not a plain byte-level pair tokenizer")
        vocab = spec["model"]["vocab"]
        # printable Latin-1 bytes stand for themselves, the others are numbered from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in set(shown)]
        names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.byte_id = np.array([vocab[names[b]] for b in range(256)], dtype=np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], NO_RANK)


@lru_cache(maxsize=2)
def merges_of(path: str) -> Merges:
    return Merges(path)


def surviving(sequences: list[bytes], merges: Merges) -> np.ndarray:
    """Number of tokens of each byte sequence (none for an empty one)."""
    lengths = np.fromiter(map(len, sequences), dtype=np.int64, count=len(sequences))
    left = lengths.copy()
    symbols = merges.byte_id[np.frombuffer(b"".join(sequences), dtype=np.uint8)]
    owner = np.repeat(np.arange(len(sequences)), lengths)
    while len(symbols) > 1:
        inside = owner[:-1] == owner[1:]
        rank = np.full(len(symbols), NO_RANK)
        rank[:-1][inside] = merges.ranks(symbols[:-1][inside], symbols[1:][inside])
        starts = np.flatnonzero(np.concatenate(([True], ~inside)))
        lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(symbols))))
        going = lowest != NO_RANK
        symbols, owner, rank, lowest = symbols[going], owner[going], rank[going], lowest[going]
        if not len(symbols):
            break
        hit = rank == lowest
        # in a run of overlapping hits (equal symbols) every second one is taken, from the left
        place = np.arange(len(hit))
        first = hit & ~np.concatenate(([False], hit[:-1]))
        run = np.maximum.accumulate(np.where(first, place, 0))
        take = hit & ((place - run) % 2 == 0)
        symbols[take] = merges.merged[rank[take]]
        gone = np.concatenate(([False], take[:-1]))
        left -= np.bincount(owner[gone], minlength=len(left))
        symbols, owner = symbols[~gone], owner[~gone]
    return left


class Counter:
    """Token counts of texts; each different piece between blanks is merged once and kept in a bounded cache."""

    def __init__(self, path: str):
        self.merges = merges_of(path)
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("|".join(map(regex.escape, self.merges.specials)) or r"(?!)")
        self.cache = Cache()

    def count(self, texts: pa.StringArray | list[str | None]) -> list[int]:
        """Tokens of each text; null and empty texts have none."""
        texts = pc.fill_null(pa.array(texts, type=pa.string()) if isinstance(texts, list) else texts, "")
        out: list[int] = []
        for start in range(0, len(texts), STEP_TEXTS):
            part = texts.slice(start, STEP_TEXTS)
            found = cut(part, "space", self.merges.specials)
            counts = np.array(self.cache.resolve(found.strings, self.plain), dtype=np.int64)
            totals = np.add.reduceat(counts[found.codes], found.ends[:-1])  # every text has a piece
            if found.whole:
                totals[found.whole] = self.plain([part[i].as_py() for i in found.whole])
            out += totals.tolist()
        return out

    def plain(self, texts: list[str]) -> list[int]:
        """Counts without the cache: special strings are one token each, the rest is cut into pre-tokens."""
        counts = np.zeros(len(texts), dtype=np.int64)
        sequences, owner, size = [], [], 0

        def merge() -> None:
            np.add.at(counts, owner, surviving(sequences, self.merges))

        for i, text in enumerate(texts):
            found = len(self.special.findall(text)) if any(s in text for s in self.merges.specials) else 0
            counts[i] += found
            for part in self.special.split(text) if found else [text]:
                raw = [t.encode() for t in self.pattern.findall(part)]
                sequences += raw
                owner += [i] * len(raw)
                size += len(part)
                if size >= MERGE_SYMBOLS:
                    merge()
                    sequences, owner, size = [], [], 0
        if sequences:
            merge()
        return counts.tolist()


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """The counter of a file, kept with its cache from task to task of a worker process."""
    return Counter(path)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row, without any shuffle.

    Null texts count as empty (0 bytes, 0 tokens); special strings inside a text
    are one token each, as the library reads them by default; repeated rows stay
    repeated and other columns are ignored.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def make():
        kept = counter(tokenizer_path)

        def step(batch: pa.RecordBatch) -> dict:
            return {"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes"), "n_tokens": kept.count(batch.column("text"))}

        return step

    rows = pick(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return map_batches(rows, make, schema).withColumn("over_limit", F.col("n_tokens") > limit)
