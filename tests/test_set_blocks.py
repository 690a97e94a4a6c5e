"""Similar sets compared block by block."""

import itertools
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as X
from lodestar.operators import similarity


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    words = [f"w{i:03d}" for i in range(90)]
    rows = []
    for i in range(120):
        base = words[:8] if i % 4 == 0 else rng.sample(words, rng.randint(1, 30))
        rows.append((i, " ".join(base + ["everywhere"] + ([rng.choice(words)] if i % 8 else [])), "x" if i % 5 else "y"))
    return rows


def small_blocks(monkeypatch):
    monkeypatch.setattr(similarity, "TOKENS_PER_BLOCK", 300)
    monkeypatch.setattr(similarity, "TOKENS_PER_SMALL_BLOCK", 100)


def jaccard(a, b):
    return len(a & b) / len(a | b)


def half_up(x):
    return float(Decimal(repr(x)).quantize(Decimal("0.001"), ROUND_HALF_UP))


@pytest.mark.parametrize("threshold, attrs", [(0.2, []), (0.35, ["cat"]), (1.0, [])])
def test_links_of_blocks_by_brute_force(spark, monkeypatch, texts, threshold, attrs):
    small_blocks(monkeypatch)
    df = spark.createDataFrame(texts, "id bigint, text string, cat string")
    sets, _members = similarity.distinct_sets(df, "id", F.col("text"), *attrs)
    tids = {(r["set_id"], r["cat"] if attrs else ""): set(r["tids"]) for r in sets.collect()}
    want = {}
    for (a, b) in itertools.permutations(tids, 2):
        if a[1] == b[1] and jaccard(tids[a], tids[b]) >= threshold:
            want[a[0], b[0]] = jaccard(tids[a], tids[b])
    got = {(r["left_id"], r["right_id"]): r["similarity"] for r in similarity.similar_sets(sets, threshold, *attrs).collect()}
    assert got == want


def test_best_links_of_blocks_keep_every_answer(spark, monkeypatch, texts):
    df = spark.createDataFrame(texts, "id bigint, text string, cat string")
    want = sorted(tuple(r) for r in similarity.similar_top(df, "id", F.col("text"), k=3).collect())
    small_blocks(monkeypatch)
    got = sorted(tuple(r) for r in similarity.similar_top(df, "id", F.col("text"), k=3).collect())
    sets = {i: set(t.split()) - set(X.SIMILARITY_STOPWORDS) for i, t, _c in texts}
    brute = []
    for i in sets:
        found = sorted((-half_up(jaccard(sets[i], sets[j])), -j) for j in sets if j != i and jaccard(sets[i], sets[j]) >= 0.2)
        brute += [(i, -j, -s, r) for r, (s, j) in enumerate(found[:3], 1)]
    assert want == sorted(brute)
    assert got == want


def test_pairs_of_blocks_store_no_candidates(spark, monkeypatch):
    stored = {}
    keep = similarity.materialise
    monkeypatch.setattr(similarity, "materialise", lambda df, label, *by: stored.setdefault(label, keep(df, label, *by)))
    rows = [(i, "all common words here " + " ".join(f"own{c}{i:03d}" for c in "abcdefghijklmnop")) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, text string")
    sets, _members = similarity.distinct_sets(df, "id", F.col("text"))
    assert similarity.similar_sets(sets, 0.2).count() == 0
    assert "prefixes" not in stored  # what the token join met on


def test_superseded_looks_ahead_once_a_set(spark, monkeypatch):
    """Copies of many similar texts in turn: rows sorted for the look-ahead stay near the rows, not the pairs."""
    seen = []
    ahead = similarity.next_candidate
    monkeypatch.setattr(similarity, "next_candidate", lambda df, *rest: (seen.append(df.count()), ahead(df, *rest))[1])
    # 12 texts, alike at 0.6 or more, in 8 blocks of copies: every text is followed by another one.
    rows = [(12 * turn + k, f"aaa bbb ccc ddd eee fff ggg own{k:02d}", "x") for turn in range(8) for k in range(12)]
    df = spark.createDataFrame(rows, "id bigint, text string, cat string")
    got = {r["old_id"]: (r["new_id"], round(r["similarity"], 6)) for r in similarity.superseded_by(df, "id", F.col("text"), "cat").collect()}
    assert got == {i: (i + 1, round(7 / 9, 6)) for i in range(95)}
    # Each pair of texts in both directions with the copies of both would be 12 * 11 * 16 rows.
    assert seen[0] == 96 and seen[1] <= 12 * 11 * 8 + 96
