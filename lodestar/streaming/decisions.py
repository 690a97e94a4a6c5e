"""Commit ingestion with keyed state: promotion by running counts, and decisions that replace earlier ones.

The cost of a batch does not grow with what came before: a commit meets the
counter of its own message prefix, a decision the active decisions under its own
tokens, a replaced decision its own mark. Counters and marks lie in maps, many
under one key (``BUCKETS`` a project), since starting on a key costs far more
than an entry of its map. State lives in the state store under each stream's
checkpoint, so a restarted job goes on where it stopped.

Commits arrive in the order of ``seq`` from batch to batch; inside a batch they
may lie in any order. A batch's rows of one key are held by one task, so the
size of a batch is what bounds it (``maxFilesPerTrigger`` of the source).
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as X
from ..operators.similarity import SUPERSEDE_THRESHOLD
from ..operators.store import decide_commits, message_prefix
from .common import drain

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
KEYED_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

COUNTED = "seq bigint, project string, commit_hash string, message string, files array<string>, n bigint"
REPLACED = "project string, old_seq bigint, new_seq bigint, similarity double"
#: Keys over which a project's counters, and its marks, are dealt.
BUCKETS = 4096


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams started inside keep their state in a store with keyed access."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, KEYED_STORE)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


class RunningCount(StatefulProcessor):
    """Numbers the commits of each counter of a key in order, across batches."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "counter string", "n bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        counters, known, before = batch.groupby("counter", sort=False), self.seen.exists(), {}
        for counter, size in counters.size().items():
            found = self.seen.getValue((counter,)) if known else None
            before[counter] = found[0] if found else 0
            self.seen.updateValue((counter,), (before[counter] + int(size),))
        yield batch.assign(n=counters.cumcount() + 1 + batch["counter"].map(before))[["seq", "project", "commit_hash", "message", "files", "n"]]

    def close(self) -> None:
        pass


class ActiveDecisions(StatefulProcessor):
    """Under one token: the active decisions, and which of them a new one resembles enough to replace."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.active = handle.getMapState("active", "seq bigint", "tokens string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stored = {k[0]: frozenset(v[0].split(" ")) for k, v in self.active.iterator()}
        active, found = dict(stored), []
        for seq, text in pd.concat(list(rows)).sort_values("seq")[["seq", "tokens"]].itertuples(index=False):
            tokens = frozenset(text.split(" "))
            replaced = []
            for old, other in active.items():
                shared = len(tokens & other)
                similarity = shared / (len(tokens) + len(other) - shared)
                if old < seq and similarity >= self.threshold:
                    replaced.append((old, similarity))
            for old, similarity in replaced:
                found.append((key[0], old, int(seq), similarity))
                del active[old]
            active[int(seq)] = tokens
        for old in stored.keys() - active.keys():
            self.active.removeKey((old,))
        for seq in active.keys() - stored.keys():
            self.active.updateValue((seq,), (" ".join(sorted(active[seq])),))
        yield pd.DataFrame(found, columns=["project", "old_seq", "new_seq", "similarity"])

    def close(self) -> None:
        pass


class FirstReplacement(StatefulProcessor):
    """A decision is replaced once, by the first that resembles it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getMapState("done", "old_seq bigint", "by bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("new_seq").drop_duplicates("old_seq")
        if self.done.exists():
            batch = batch[[not self.done.containsKey((int(old),)) for old in batch["old_seq"]]]
        for old, new in batch[["old_seq", "new_seq"]].itertuples(index=False):
            self.done.updateValue((int(old),), (int(new),))
        yield batch[["project", "old_seq", "new_seq", "similarity"]]

    def close(self) -> None:
        pass


def _bucketed(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def promoted_stream(commits: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Decided commits of a stream (seq, project, commit_hash, message, files); a commit counts itself and all before it."""
    # a missing message is a counter of its own
    counter = F.coalesce(F.concat(F.lit(":"), message_prefix(F.col("message"))), F.lit(""))
    counted = _bucketed(commits.withColumn("counter", counter), "counter", buckets).groupBy("project", "bucket").transformWithStateInPandas(
        RunningCount(), COUNTED, "append", "none",
    )
    return decide_commits(counted, "seq")


def meeting_tokens(tokens: Column, threshold: float, common: tuple[str, ...]) -> Column:
    """The tokens under which a set must be filed so that any set resembling it meets it.

    Of n tokens in one fixed order, sets with Jaccard >= t share one of the first
    n - ceil(t n) + 1. ``common`` tokens come last in that order, so few sets are
    filed under them; any list gives the same result.
    """
    n = F.size(tokens)
    ordered = F.array_sort(F.transform(tokens, lambda t: F.struct(t.isin(*common).alias("c"), F.xxhash64(t).alias("h"), t.alias("t")))) if common else F.array_sort(
        F.transform(tokens, lambda t: F.struct(F.lit(False).alias("c"), F.xxhash64(t).alias("h"), t.alias("t")))
    )
    return F.transform(F.slice(ordered, F.lit(1), (n - F.ceil(F.lit(threshold) * n - 1e-9) + 1).cast("int")), lambda s: s["t"])


def replaced_stream(decided: DataFrame, threshold: float = SUPERSEDE_THRESHOLD, category: str = "decision", common: tuple[str, ...] = ()) -> DataFrame:
    """(project, old_seq, similarity) pairs of decisions and the later ones that resemble them, of a stream of decided commits.

    A decision is the promoted commit of ``category``; its content's token set
    is compared. Pairs may come more than once; see ``first_stream``.
    """
    tokens = F.array_sort(X.token_set(F.col("content")))
    rows = decided.where(F.col("promoted") & (F.col("classification") == category)).select("seq", "project", tokens.alias("set")).where(F.size("set") > 0)
    filed = rows.select("project", "seq", F.array_join("set", " ").alias("tokens"), F.explode(meeting_tokens(F.col("set"), threshold, common)).alias("token"))
    return filed.groupBy("project", "token").transformWithStateInPandas(ActiveDecisions(threshold), REPLACED, "append", "none")


def first_stream(pairs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(project, old_seq, new_seq, similarity): one row per replaced decision."""
    return _bucketed(pairs, "old_seq", buckets).groupBy("project", "bucket").transformWithStateInPandas(FirstReplacement(), REPLACED, "append", "none")


class DecisionIngest:
    """Three streams in a row, each with its own checkpoint and table in ``folder``: decided commits, pairs, replacements."""

    def __init__(self, spark: SparkSession, folder: str, threshold: float = SUPERSEDE_THRESHOLD, common: tuple[str, ...] = ()):
        self.spark, self.folder, self.threshold, self.common = spark, folder, threshold, common

    def _step(self, stream: DataFrame, name: str) -> DataFrame:
        with keyed_state(self.spark):
            return drain(stream, os.path.join(self.folder, name))

    def _again(self, table: DataFrame, name: str) -> DataFrame:
        return self.spark.readStream.schema(table.schema).parquet(os.path.join(self.folder, name, "out"))

    def run(self, commits: DataFrame) -> tuple[DataFrame, DataFrame]:
        """All available commits through all three; returns what the first and last hold by now."""
        decided = self._step(promoted_stream(commits), "decided")
        pairs = self._step(replaced_stream(self._again(decided, "decided"), self.threshold, common=self.common), "pairs")
        return decided, self._step(first_stream(self._again(pairs, "pairs")), "replaced")
