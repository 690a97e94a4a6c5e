"""Byte-level BPE encoding and decoding with a rank file.

Two tiers resolve the pre-tokens of a text. A minimal perfect hash over the
vocabulary answers whole pre-tokens that are tokens themselves; it numbers every
token without gaps and takes about three bits a token, and one comparison with
the numbered token tells whether the pre-token really is it. Misses are merged
by rank: their bytes are linked in a list, a heap holds the pairs by rank and
place, and pairs that changed since they were pushed are passed over.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable
from functools import cached_property, lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, pick
from .token_counts import PATTERN
from .token_ids import Cache, Encoder

#: Bits of a hash level for each key that reaches it.
BITS_PER_KEY = 1.5
MAX_LEVELS = 64
#: Bytes of a pre-token from which its links are kept in arrays.
SHORT = 1_000
#: Pre-tokens of one text, and ids of one sequence, handled at a time.
STEP_TOKENS = 100_000
STEP_IDS = 250_000


class PerfectHash:
    """A minimal perfect hash of different byte strings: levels of bits, each for the keys that collided before.

    A key's number is the count of set bits before its own. Strings that are not
    keys get -1 or some number, so callers compare with the key of that number.
    """

    def __init__(self, keys: list[bytes]):
        self.seed, self.levels = 0, []
        while not self._build(self._hashes(keys)):
            self.seed += 1  # two keys with one 64-bit hash

    def _hashes(self, keys: list[bytes]) -> np.ndarray:
        return np.fromiter((xxhash.xxh3_64_intdigest(k, self.seed) for k in keys), dtype=np.uint64, count=len(keys))

    @staticmethod
    def _places(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        """Place of each hash in a level: the hash is mixed anew for every level."""
        mixed = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * level)
        return ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(size)).astype(np.int64)

    def _build(self, hashes: np.ndarray) -> bool:
        self.levels, before = [], 0
        while len(hashes):
            if len(self.levels) == MAX_LEVELS:
                return False
            size = -(-int(len(hashes) * BITS_PER_KEY) // 64) * 64 or 64
            places = self._places(hashes, len(self.levels), size)
            alone = np.bincount(places, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view("<u8")
            counts = np.bitwise_count(words).astype(np.int64)
            self.levels.append((size, words, before + np.cumsum(counts) - counts))
            before += int(counts.sum())
            hashes = hashes[~alone[places]]
        return True

    def numbers(self, keys: list[bytes]) -> np.ndarray:
        """The number of each key; strings that are not keys may have any, or -1."""
        hashes, out = self._hashes(keys), np.full(len(keys), -1)
        going = np.arange(len(keys))
        for level, (size, words, before) in enumerate(self.levels):
            places = self._places(hashes[going], level, size)
            word, bit = words[places >> 6], (places & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            lower = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[going[hit]] = (before[places >> 6] + lower)[hit]
            going = going[~hit]
        return out


class Vocabulary:
    """Tokens of a rank file: the bytes of every id, the perfect hash, and the pairs that merge; the last two when first asked for."""

    def __init__(self, path: str):
        self.path = path
        known = sorted(self._ranks().items(), key=lambda item: item[1])
        if len([token for token, _ in known if len(token) == 1]) != 256:
            raise ValueError(f"{path} lacks single bytes")
        self.sizes = np.full(known[-1][1] + 1, -1)
        self.sizes[[rank for _, rank in known]] = [len(token) for token, _ in known]
        self.flat = np.frombuffer(b"".join(token for token, _ in known), dtype=np.uint8)
        filled = np.maximum(self.sizes, 0)
        self.starts = np.cumsum(filled) - filled

    def _ranks(self) -> dict[bytes, int]:
        with open(self.path, "rb") as f:
            return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}

    @cached_property
    def numbered(self) -> tuple[PerfectHash, list[bytes], np.ndarray]:
        """The perfect hash, and the token and id of each of its numbers."""
        ranks = self._ranks()
        tokens = list(ranks)
        hashed = PerfectHash(tokens)
        token_at, id_at = [b""] * len(tokens), np.zeros(len(tokens), dtype=np.int64)
        for token, at in zip(tokens, hashed.numbers(tokens).tolist()):
            token_at[at], id_at[at] = token, ranks[token]
        return hashed, token_at, id_at

    @cached_property
    def merges(self) -> tuple[list[int], list[dict[int, int]]]:
        """The id of every byte and, for every left id, the right ids that merge with it and the rank of the joined token."""
        ranks, none = self._ranks(), {}
        pairs: list[dict[int, int]] = [none] * len(self.sizes)
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    if pairs[left] is none:
                        pairs[left] = {}
                    pairs[left][right] = rank
        return [ranks[bytes([b])] for b in range(256)], pairs

    def whole(self, words: list[bytes]) -> np.ndarray:
        """Ids of byte strings that are tokens, -1 for the others."""
        hashed, token_at, id_at = self.numbered
        at = hashed.numbers(words)
        same = np.fromiter((a >= 0 and token_at[a] == w for a, w in zip(at.tolist(), words)), dtype=bool, count=len(words))
        return np.where(same, id_at[at], -1)

    def merged(self, word: bytes) -> list[int]:
        """Ids of a byte string after all merges, lowest rank first and from the left among equals."""
        (byte_id, pairs), n = self.merges, len(word)
        # short words are by far the most: plain lists are faster, arrays smaller
        ids = list(map(byte_id.__getitem__, word))
        after, before = (range(1, n + 1), range(-1, n - 1))
        after, before = (list(after), list(before)) if n < SHORT else (array("q", after), array("q", before))
        # an entry is rank * n + place, so entries order by rank, then place
        heap = [r * n + i for i, (a, b) in enumerate(zip(ids, islice(ids, 1, None))) if (r := pairs[a].get(b)) is not None]
        heapify(heap)
        while heap:
            rank, i = divmod(heappop(heap), n)
            j, a = after[i], ids[i]
            if a < 0 or j == n or pairs[a].get(ids[j]) != rank:
                continue  # one side was merged since
            ids[i], ids[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := pairs[rank].get(ids[k])) is not None:
                    heappush(heap, r * n + i)
            h = before[i]
            if h >= 0 and (r := pairs[ids[h]].get(rank)) is not None:
                heappush(heap, r * n + h)
        return [x for x in ids if x >= 0]

    def bytes_of(self, ids: bytes) -> bytes:
        """The joined bytes of little-endian 32-bit ids; an id outside the vocabulary is an error."""
        out = []
        numbers = np.frombuffer(ids, dtype="<u4").astype(np.int64)
        for at in range(0, len(numbers), STEP_IDS):
            part = numbers[at:at + STEP_IDS]
            if part.max() >= len(self.sizes) or (self.sizes[part] < 0).any():
                raise ValueError("an id is not in the vocabulary")
            size = self.sizes[part]
            ends = np.cumsum(size)
            out.append(self.flat[np.repeat(self.starts[part] - (ends - size), size) + np.arange(ends[-1])].tobytes())
        return b"".join(out)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file; one per worker process."""
    return Vocabulary(path)


class ByteEncoder(Encoder):
    """Ids of texts by rank merges; pieces between blanks are encoded once and kept in the bounded cache.

    Only the standard pattern is known to part texts at blanks; with another
    one texts are read whole.
    """

    def __init__(self, path: str, pattern: str):
        self.vocabulary, self.pattern = vocabulary(path), regex.compile(pattern)
        self.kind, self.specials, self.cache = "space" if pattern == PATTERN else "whole", [], Cache()

    def tokens(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of different pre-tokens: the perfect hash first, the heap for what it does not hold."""
        words = list(words)
        raw = [w.encode() for w in words]
        ids = self.vocabulary.whole(raw)
        single = ids.astype("<u4").tobytes()
        out = {w: single[i:i + 4] for w, i in zip(words, range(0, len(single), 4))}
        for i in np.flatnonzero(ids < 0).tolist():
            out[words[i]] = array("I", self.vocabulary.merged(raw[i])).tobytes()
        return out

    def separate(self, pieces: list[str]) -> list[bytes]:
        parts = list(map(self.pattern.findall, pieces))
        known = self.tokens(dict.fromkeys(chain.from_iterable(parts)))
        return [b"".join([known[t] for t in part]) for part in parts]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [b"".join(self._steps(text)) for text in texts]

    def _steps(self, text: str) -> Iterable[bytes]:
        found = (m.group() for m in self.pattern.finditer(text))
        while step := list(islice(found, STEP_TOKENS)):
            known = self.tokens(dict.fromkeys(step))
            yield b"".join([known[t] for t in step])


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> ByteEncoder:
    """The encoder of a file, kept with its cache from task to task of a worker process."""
    return ByteEncoder(path, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids, n_tokens)`` for every row, without any shuffle; ``ids`` are little-endian unsigned 32-bit integers.

    Every match of the pattern is encoded separately and nothing is special.
    Null and empty texts have no ids; an empty table gives no rows; repeated
    rows and null ids stay as they are, and other columns are ignored. Very long
    texts are encoded whole, a bounded number of pre-tokens at a time.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("ids", T.BinaryType())])

    def make():
        kept = encoder(ranks_path, pattern)
        return lambda batch: {"doc_id": batch.column("doc_id"), "ids": list(kept.encode(batch.column("text")))}

    encoded = map_batches(pick(docs, doc_id=id_col, text=text_col), make, schema)
    return encoded.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, ids, content)``: the bytes that the ids of every row stand for.

    Bytes, not text: a part of an encoded text may end inside a character. Null
    ids give empty bytes; ids outside the vocabulary raise; repeated rows stay,
    other columns are ignored and an empty table gives no rows.
    """
    schema = T.StructType([
        T.StructField("doc_id", encoded.schema[id_col].dataType), T.StructField("ids", T.BinaryType()), T.StructField("content", T.BinaryType()),
    ])

    def make():
        kept = vocabulary(ranks_path)

        def step(batch: pa.RecordBatch) -> dict:
            return {**{n: batch.column(n) for n in ("doc_id", "ids")}, "content": [kept.bytes_of(i or b"") for i in batch.column("ids").to_pylist()]}

        return step

    return map_batches(pick(encoded, doc_id=id_col, ids=ids_col), make, schema)
