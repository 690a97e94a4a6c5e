"""Keyed streaming ingestion: running counts and replaced decisions, batch by batch and across restarts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestar.functions.text import SIMILARITY_STOPWORDS
from lodestar.streaming.common import drain
from lodestar.streaming.decisions import REPLACED, DecisionIngest, first_stream, keyed_state, meeting_tokens, promoted_stream

SCHEMA = "seq bigint, project string, commit_hash string, message string, files array<string>"
WORDS = "postgres sqlite storage signing oauth flow cache queue search layout".split()


def commits(rng, n):
    rows = []
    for seq in range(n):
        message = rng.choice([f"migrate {' '.join(rng.sample(WORDS, rng.randrange(1, 6)))}", "fix: the same old crash in the parser code", "feat: more", "docs: words"])
        rows.append((seq, rng.choice(["p", "q"]), f"c{seq}", message, ["a/x.py"]))
    return rows


def expected(rows, threshold=0.35):
    """Decisions of each project in order; each replaces the active ones that resemble it."""
    active, replaced = {}, {}
    for seq, project, _, message, _ in rows:
        if not message.startswith("migrate"):
            continue
        tokens = {"decision", *message.split()} - set(SIMILARITY_STOPWORDS)
        for old, other in list(active.get(project, {}).items()):
            similarity = len(tokens & other) / len(tokens | other)
            if similarity >= threshold:
                replaced[project, old] = (seq, round(similarity, 9))
                del active[project][old]
        active.setdefault(project, {})[seq] = tokens
    return replaced


def write(spark, rows, folder, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def stream(spark, folder, per_batch=None):
    reader = spark.readStream.schema(SCHEMA)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    return reader.parquet(f"{folder}/in")


def outcome(decided, replaced):
    counts = {r.seq: r.reason for r in decided.collect()}
    return counts, {(r.project, r.old_seq): (r.new_seq, round(r.similarity, 9)) for r in replaced.collect()}


def test_three_batches_with_restarts_equal_one(spark, tmp_path):
    rows = commits(random.Random(3), 90)
    shuffled = rows[:]
    random.Random(1).shuffle(shuffled)
    write(spark, shuffled, tmp_path / "once", "in")
    decided, replaced = DecisionIngest(spark, str(tmp_path / "once" / "job")).run(stream(spark, tmp_path / "once"))
    once = outcome(decided, replaced)
    assert once[1] == expected(rows) and len(once[0]) == 90
    assert replaced.count() == len(once[1])  # each is replaced once
    for part in range(3):  # a new job object each time, as after a restart
        write(spark, rows[part * 30:part * 30 + 30], tmp_path / "thrice", "in")
        ingest = DecisionIngest(spark, str(tmp_path / "thrice" / "job"), common=("migrate", "decision"))
        parts = ingest.run(stream(spark, tmp_path / "thrice", 1))
        assert parts[0].count() == part * 30 + 30
    assert outcome(*parts) == once
    # running again without new commits changes nothing
    assert outcome(*ingest.run(stream(spark, tmp_path / "thrice", 1))) == once


def test_counts_run_on_across_batches(spark, tmp_path):
    for part in range(2):
        write(spark, [(part * 2 + i, "p", f"c{part}{i}", "fix: one recurring message", []) for i in range(2)], tmp_path, "in")
        decided, _ = DecisionIngest(spark, str(tmp_path / "job")).run(stream(spark, tmp_path, 1))
    assert [(r.seq, r.promoted, r.reason) for r in decided.orderBy("seq").collect()] == [
        (0, False, "insufficient signal"), (1, False, "insufficient signal"), (2, True, "recurring pattern (3 occurrences)"), (3, True, "recurring pattern (4 occurrences)"),
    ]


@pytest.mark.parametrize("common", [(), ("alpha", "w1")])
def test_similar_sets_always_meet(spark, common):
    rng = random.Random(5)
    sets = [sorted(rng.sample(["alpha", *[f"w{i}" for i in range(12)]], rng.randrange(1, 9))) for _ in range(60)]
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "i int, s array<string>")
    filed = {r.i: set(r.t) for r in frame.select("i", meeting_tokens(F.col("s"), 0.35, common).alias("t")).collect()}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.35:
                assert filed[i] & filed[j]


def test_many_counters_and_marks_share_a_key(spark, tmp_path):
    rows = [(i, "p", f"c{i}", None if i % 9 == 0 else f"fix: message {i % 5}", []) for i in range(60)]
    for part in range(2):
        write(spark, rows[part * 30:part * 30 + 30], tmp_path, "in")
        with keyed_state(spark):
            counted = drain(promoted_stream(stream(spark, tmp_path, 1), buckets=1), f"{tmp_path}/counted")
    seen, expected_reasons = {}, {}
    for seq, _, _, message, _ in rows:
        seen[message] = seen.get(message, 0) + 1
        if message:
            expected_reasons[seq] = f"recurring pattern ({seen[message]} occurrences)" if seen[message] >= 3 else "insufficient signal"
    assert {r.seq: r.reason for r in counted.collect() if r.message} == expected_reasons and counted.count() == 60

    for part, pairs in enumerate([[("p", 1, 5, 0.5), ("p", 1, 4, 0.4), ("p", 2, 5, 0.6), ("q", 1, 6, 0.7)], [("p", 1, 9, 1.0), ("p", 3, 9, 0.9)]]):
        spark.createDataFrame(pairs, REPLACED).coalesce(1).write.mode("append").parquet(f"{tmp_path}/pairs")
        with keyed_state(spark):
            first = drain(first_stream(spark.readStream.schema(REPLACED).parquet(f"{tmp_path}/pairs"), buckets=1), f"{tmp_path}/first")
    assert sorted(map(tuple, first.collect())) == [("p", 1, 4, 0.4), ("p", 2, 5, 0.6), ("p", 3, 9, 0.9), ("q", 1, 6, 0.7)]
