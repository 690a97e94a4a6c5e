import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestar.llm import packing, token_counts, token_files
from lodestar.llm.token_ids import Encoder, library

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = [" ", "  ", "\n", "\t", "\xa0", "　", "a", "the", "The", " the", "'s", "é", "é", "中", "👍", "1", "²", "_", "--", "<|endoftext|>",
         "<|end", "\x1c", "\x85", "​", "aaaa", "\r\n", "word. Next", "word.\nNext", ", ", ".\n", "é,", "3.", "\x02", "X, ", "Σ", "ΑΣ", "İ"]


def texts(n=3000, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 30))) for _ in range(n)] + ["", " " * 3000, "a" * 3000, "x " * 50_000]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_equal_the_library(path):
    cases = texts()
    want = [e.ids for e in library(path).encode_batch(cases, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in Encoder(path).encode(cases)] == want


def test_cache_generations(monkeypatch):
    monkeypatch.setattr("lodestar.llm.token_ids.CACHE_PIECES", 5)
    monkeypatch.setattr("lodestar.llm.token_ids.STEP_TEXTS", 7)
    monkeypatch.setattr("lodestar.llm.token_ids.GATHER_PIECES", 11)
    cases = texts(300, 2)
    want = [e.ids for e in library(BYTE).encode_batch(cases, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in Encoder(BYTE).encode(cases)] == want


def test_counts_equal_the_library(spark):
    cases = texts()
    want = [len(e.ids) for e in library(BYTE).encode_batch(cases, add_special_tokens=False)]
    assert token_counts.Counter(BYTE).count(cases) == want
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate([*cases[:50], None])] + [(0, None, "x", 1)], "doc_id long, text string, n_tokens string, n_bytes int")
    rows = [(r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(docs, BYTE, limit=20).collect()]
    assert sorted(rows) == sorted([(i, len(t.encode()), n, n > 20) for i, (t, n) in enumerate(zip(cases[:50], want))] + [(50, 0, 0, False), (0, 0, 0, False)])
    assert token_counts.token_counts(docs.limit(0), BYTE).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_bound_and_packing(sizes):
    lengths = np.array(sizes, dtype=np.int64)
    bins, offsets, fill = packing.best_fit_decreasing(lengths, 20)
    used = {}
    for b, o, s in zip(bins.tolist(), offsets.tolist(), sizes):
        used.setdefault(b, []).append((o, s))
    for cells in used.values():
        at = 0
        for o, s in sorted(cells):
            assert o == at
            at += s
        assert at <= 20
    bound = packing.lower_bound(np.bincount(lengths, minlength=21), 20)

    def best(left, rooms):
        if not left:
            return len(rooms)
        tries = [best(left[1:], rooms[:i] + [r - left[0]] + rooms[i + 1:]) for i, r in enumerate(rooms) if r >= left[0] and r not in rooms[:i]]
        return min([*tries, best(left[1:], [*rooms, 20 - left[0]])])

    optimum = best(sorted(sizes, reverse=True)[:7], [])
    if len(sizes) <= 7:
        assert bound <= optimum <= len(fill)


def check_packed(rows, capacity):
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for cells in used.values():
        at = 0
        for o, s in sorted(cells):
            assert o == at
            at += s
        assert at <= capacity
    return len(used)


def test_exchange_between_partitions(spark):
    rng = np.random.default_rng(5)
    lengths = [int(x) for x in rng.integers(1, 400, 900)]
    rows = spark.createDataFrame([(i % 700, 0, 0, s, 1) for i, s in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    apart = check_packed(packing.pack(rows, 1000, partition_pieces=30, rounds=1).collect(), 1000)
    got = packing.pack(rows, 1000, partition_pieces=30, rounds=4).collect()
    assert sorted(r["length"] for r in got) == sorted(lengths)
    together = check_packed(got, 1000)
    bound = packing.lower_bound(np.bincount(lengths, minlength=1001), 1000)
    assert bound <= together < apart and together <= bound + 2


def test_packed_documents(spark):
    long = "word other " * 3000
    rows = [(1, "a b"), (2, None), (2, ""), (None, "x"), (4, long), (4, long)]
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, bin int")
    got = packing.pack_documents(docs, BYTE, 0, 2048).collect()
    check_packed(got, 2048)
    ids = {t: [*library(BYTE).encode(t or "", add_special_tokens=False).ids, 0] for _, t in rows}
    for doc_id, text in rows:
        whole = ids[text]
        first = len(whole) % 2048 or 2048
        cuts = [(0, first), *[(a, a + 2048) for a in range(first, len(whole), 2048)]]
        want = [(k, a, b - a, zlib.crc32(np.array(whole[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(cuts)]
        mine = [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got if r["doc_id"] == doc_id]
        assert set(want) <= set(mine)
    assert len(got) == 4 + 2 * len(cuts)
    assert packing.pack_documents(docs.limit(0), BYTE).count() == 0


def test_token_files_round_trip(spark, tmp_path):
    cases = [*texts(200, 4), None]
    rows = [((i * 7) % 150 if i % 20 else None, t) for i, t in enumerate(cases)]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, shard int")
    folder = f"file://{tmp_path}/files"
    manifest = token_files.write(docs, folder, WORD, 1, shard_docs=40)
    got = token_files.read(spark, folder, manifest).collect()
    want = sorted(((i is not None, i or 0), zlib.crc32(np.array([*library(WORD).encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())) for i, t in rows)
    assert sorted(((r["doc_id"] is not None, r["doc_id"] or 0), r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    in_order = [(r["doc_id"] is not None, r["doc_id"] or 0) for r in sorted(got, key=lambda r: r["start"])]
    assert in_order == sorted(in_order)
    with pytest.raises(ValueError):
        token_files.Shard(manifest.first()["path"], b"other")
    empty = token_files.write(docs.limit(0), f"file://{tmp_path}/none", WORD, 1)
    assert token_files.read(spark, f"file://{tmp_path}/none", empty).count() == 0
