"""Byte-level BPE, importance resampling and the prefix trie against brute force."""

from __future__ import annotations

import base64
import hashlib
import json
import math
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm import byte_bpe, importance, prefix_trie

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = "aé中\U0001f600 \t\n  　\x02\x1c.,'12½<|endoftext|>sŚ"


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_numbers_every_key_once():
    keys = [hashlib.md5(str(i).encode()).digest()[: i % 16 + 1] for i in range(3000)]
    keys = list(dict.fromkeys(keys))
    for some in ([], keys[:1], keys):
        assert sorted(byte_bpe.PerfectHash(some).numbers(some).tolist()) == list(range(len(some)))
    vocabulary = byte_bpe.vocabulary(RANKS)
    assert vocabulary.whole([b" the", b"qqzzqq", b""]).tolist()[1:] == [-1, -1]
    hashed, tokens, _ = vocabulary.numbered
    assert sum(size for size, _, _ in hashed.levels) < 3.2 * len(tokens)


def test_ids_equal_the_library(spark, library):
    rng = random.Random(4)
    texts = ["".join(rng.choices(ODD, k=rng.randrange(1, 60))) for _ in range(600)]
    texts += ["", None, "don't  stop\n\n now ", "x" * 30_000, "ab" * 20_000, " ".join(["word"] * 50_000), "<|endoftext|>"]
    rows = [(i if i else None, t, "clash") for i, t in enumerate(texts)] + [(1, texts[1], "clash")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    encoded = byte_bpe.encode(docs, RANKS)
    assert encoded.columns == ["doc_id", "ids", "n_tokens"]
    got = byte_bpe.decode(encoded, RANKS).collect()
    assert len(got) == len(rows)
    want = Counter((i, np.array(library.encode_ordinary(t or ""), dtype="<u4").tobytes(), (t or "").encode()) for i, t, _ in rows)
    assert Counter((r.doc_id, bytes(r.ids), bytes(r.content)) for r in got) == want
    assert byte_bpe.decode(byte_bpe.encode(docs.limit(0), RANKS), RANKS).count() == 0


def test_other_patterns_are_read_whole(spark, library):
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"\S+|\s+"
    plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    docs = spark.createDataFrame([(1, "some  words, and\nmore words")], "doc_id long, text string")
    (row,) = byte_bpe.encode(docs, RANKS, pattern).collect()
    assert np.frombuffer(row.ids, dtype="<u4").tolist() == plain.encode_ordinary("some  words, and\nmore words")


def test_decoding_refuses_unknown_ids():
    vocabulary = byte_bpe.vocabulary(RANKS)
    assert vocabulary.bytes_of(b"") == b""
    with pytest.raises(ValueError):
        vocabulary.bytes_of(np.array([50_256], dtype="<u4").tobytes())


def test_crcs_cancel_by_shifting():
    rng = random.Random(2)
    heads = [rng.randbytes(rng.choice([0, 1, 5, 70, 5000])) for _ in range(200)]
    tails = [rng.randbytes(rng.choice([0, 1, 63, 64, 65, 4096, 300_000])) for _ in range(200)]
    got = importance.shifted(np.array([crc32(h) for h in heads], dtype=np.uint32), np.array([len(t) for t in tails]))
    assert [int(g) ^ crc32(t) for g, t in zip(got, tails)] == [crc32(h + t) for h, t in zip(heads, tails)]


def words_of(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def features_of(text):
    w = words_of(text)
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def plain_resample(docs, target, percent, min_words, buckets, seed):
    corpus = Counter(crc32(f.encode()) % buckets for _, t in docs for f in features_of(t))
    aimed = Counter(crc32(f.encode()) % buckets for t in target for f in features_of(t))
    S, T = sum(corpus.values()), sum(aimed.values())
    gain = [math.floor(1000 * math.log((aimed[b] + 1) * (S + buckets) / ((corpus[b] + 1) * (T + buckets)))) for b in range(buckets)]
    rows = []
    for i, t in docs:
        found = [gain[crc32(f.encode()) % buckets] for f in features_of(t)]
        weight = sum(found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(words_of(t)), len(found), weight, score, None])
    fit = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    for place, r in enumerate(fit[: len(fit) * percent // 100], 1):
        r[5] = place
    return sorted(map(tuple, rows), key=repr)


def test_resampling_equals_brute_force(spark):
    rng = random.Random(9)
    vocabulary = ["Alpha", "beta", "ÉTÉ", "中文", "x1", "the", "of", "sun" * 40]
    docs = [(i, "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(rng.randrange(0, 60)))) for i in range(200)]
    docs += [(None, docs[5][1]), (3, docs[3][1]), (3, "other words " * 20), (500, None), (501, ""), (502, " .,! "), (503, "the sun " * 40_000), (None, None)]
    target = ["beta beta x1", None, "", "中文 of the"]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, n_words int, bucket int").repartition(3)
    aims = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(frame, aims, 25, 20, buckets=97, seed=7).collect()
    assert sorted(map(tuple, got), key=repr) == plain_resample(docs, target, 25, 20, 97, 7)
    # an empty target, and an empty corpus
    got = importance.resample(frame, aims.limit(0), 25, 20, buckets=97).collect()
    assert sorted(map(tuple, got), key=repr) == plain_resample(docs, [], 25, 20, 97, 7)
    assert importance.resample(frame.limit(0), aims, buckets=97).count() == 0


def test_resampling_takes_other_names(spark):
    frame = spark.createDataFrame([("a", "one two")], "name string, body string")
    (row,) = importance.resample(frame, spark.createDataFrame([("two",)], "said string"), 100, 1, id_col="name", text_col="body", target_text_col="said").collect()
    assert (row.doc_id, row.n_words, row.n_features, row["rank"]) == ("a", 2, 3, 1)


def plain_trie(rows):
    """Nodes of the rebuilt conversations, by dictionaries."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns, key=lambda t: t[:2])] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
        ends[built[c]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    return sorted(
        (members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p in members
    )


def built_trie(conversations):
    lists = prefix_trie.turn_lists(conversations)
    return prefix_trie.prefix_trie(prefix_trie.branched(lists, 100, (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int"), 5))


def random_conversations(rng, n):
    rows = []
    for c in rng.sample([i for i in range(1, 420) if i != 200], n) + [200]:
        for turn in range(rng.randrange(0, 8)):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None])))
    return rows


@pytest.mark.parametrize("limits", [(4096, 50_000), (7, 50_000), (1, 1), (4096, 20)])
def test_trie_equals_brute_force(spark, monkeypatch, limits):
    rng = random.Random(limits[0])
    rows = random_conversations(rng, 150)
    rows += [(700, None, "user", "late"), (700, 0, "user", "a"), (701, 3, "user", "x" * 5000), (None, 1, "user", "lost")]
    rows += [(c, t, "user", f"same {t}") for c in range(800, 900) for t in range(9)]
    schema = "conv_id long, turn int, role string, text string, key int, members int"
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], schema).repartition(5)
    # the limits travel with the functions, as the workers may have imported the module before
    monkeypatch.setattr(prefix_trie, "SHARD_CONVERSATIONS", limits[0])
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", limits[1])
    assert sorted(map(tuple, built_trie(frame).collect()), key=lambda r: (r[0], r[1])) == plain_trie(rows)


def test_long_conversations(spark):
    rows = [(c, t, "user", "long") for c in (900, 1000) for t in range(5000)]
    lists = prefix_trie.turn_lists(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))
    nodes = {r.depth: r for r in prefix_trie.prefix_trie(lists).collect()}
    assert len(nodes) == 5001 and all(r.conv_id == 900 and r.n_convs == 2 and r.n_leaves == 1 for r in nodes.values())
    assert all(r.saved_tokens == 4 * (5001 - max(d, 1)) for d, r in nodes.items())


def test_trie_without_conversations_or_turns(spark):
    schema = "conv_id long, turn int, role string, text string"
    assert built_trie(spark.createDataFrame([], schema)).count() == 0
    lists = spark.createDataFrame([(4, []), (9, [])], T.StructType([
        T.StructField("conv_id", T.LongType()), prefix_trie.turn_lists(spark.createDataFrame([], schema)).schema["turns"],
    ]))
    (root,) = prefix_trie.prefix_trie(lists).collect()
    assert tuple(root) == (4, 0, None, 2, 0, 1, 0, hashlib.sha256(b"4,9").hexdigest())


def test_repeated_turns_and_negative_ids(spark):
    rows = [(-205, 1, "user", "a"), (-200, 0, "user", "b"), (-200, 1, "user", "c"), (-205, 2, "user", "d"), (7, 1, "u", "x"), (7, 1, "u", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    assert sorted(map(tuple, built_trie(frame).collect())) == [tuple(r) for r in json.loads(json.dumps(plain_trie(rows)))]
