"""Fusing features into one score, the reading plan and its calibration."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import ranked, top_k

# --- Fixed values. ---
TIER_SHARES = (0.3, 0.7)
TIER_LABELS = ("high", "medium", "low")
TARGET_HIT = 0.85
READ_CAP = 10
HOLDOUT_PART = 3
EVIDENCE_LABELS = (
    ("traceback", "in traceback"),
    ("literal", "contains quoted message"),
    ("literal_path", "path named in issue"),
    ("module", "module named in issue"),
    ("defs", "defines issue symbol"),
    ("qualified", "defines Class.method"),
    ("bm25_title", "matches title"),
    ("bm25", "matches issue text"),
    ("api", "API names match"),
    ("path_bm25", "path matches"),
    ("neighbor", "imports/imported by a match"),
)
NO_EVIDENCE = "weak lexical match"
# --- End of fixed values. ---

# Our own starting weights; ``operators.ml`` fits others to labelled data.
DEFAULT_WEIGHTS = {
    "bm25_n": 2.0, "bm25_rr": 1.0, "bm25_title_n": 0.5, "bm25_title_rr": 0.25, "api_n": 0.5,
    "path_bm25_n": 0.3, "defs_n": 1.0, "defs_rr": 0.5, "defs_class_n": 0.3, "qualified_n": 0.8,
    "module_n": 0.8, "literal_path_n": 1.0, "traceback_rr": 1.5, "literal_n": 1.5,
    "literal_rr": 0.5, "neighbor_n": 0.3, "stem_in_issue": 0.3, "is_init": -0.2,
    "is_generic": -0.1, "non_package": -0.3, "hist_touch": 0.02, "hist_fix": 0.02,
}


def linear_score(weights: dict[str, float], bias: float = 0.0) -> Column:
    total = F.lit(float(bias))
    for name, weight in weights.items():
        total = total + F.lit(float(weight)) * F.coalesce(F.col(name), F.lit(0.0))
    return total


def tree_score(model: dict) -> Column:
    """Sum of the trees as nested conditions, all inside the generated code.

    ``model`` holds feature names and trees of [feature, threshold, left, right]
    nodes with numbers as leaves; a missing feature counts as 0.
    """
    names = model["features"]

    def node(n) -> Column:
        if not isinstance(n, list):
            return F.lit(float(n))
        feature, threshold, left, right = n
        value = F.coalesce(F.col(names[feature]), F.lit(0.0))
        return F.when(value <= F.lit(float(threshold)), node(left)).otherwise(node(right))

    total = F.lit(0.0)
    for tree in model["trees"]:
        total = total + node(tree)
    return total


def tree_score_udf(model: dict):
    """The same sum as an Arrow-batched function, for ensembles too large to compile.

    Call it with the model's feature columns in order.
    """

    @F.pandas_udf("double")
    def score(*features: pd.Series) -> pd.Series:
        x = np.column_stack([f.fillna(0.0).to_numpy(dtype=float) for f in features])

        def walk(n, rows):
            if not isinstance(n, list):
                total[rows] += n
                return
            left = x[rows, n[0]] <= n[1]
            walk(n[2], rows[left])
            walk(n[3], rows[~left])

        total = np.zeros(len(x))
        for tree in model["trees"]:
            walk(tree, np.arange(len(x)))
        return pd.Series(total)

    return score


def rank_scores(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows per query by score, then path, both descending."""
    return top_k(scored, ["query_id"], [F.desc("score"), F.desc("path")], k)


def why(available: set[str]) -> Column:
    """Up to three reasons: channels the row leads, then channels at half of the best."""
    lead, half = [], []
    for name, label in EVIDENCE_LABELS:
        if f"{name}_rr" in available:
            lead.append(F.when(F.col(f"{name}_rr") == 1.0, F.lit(label)))
            half.append(F.when(F.col(f"{name}_n") >= 0.5, F.lit(label)))
    reasons = F.slice(F.array_distinct(F.array_compact(F.array(*lead, *half))), 1, 3)
    return F.when(F.size(reasons) > 0, F.array_join(reasons, ", ")).otherwise(F.lit(NO_EVIDENCE))


# ----------------------------------------------------------------- reading plan
def margins(scored: DataFrame) -> DataFrame:
    """(query_id, margin, n): lead of the best score; margin is NULL for one result."""
    two = top_k(scored, ["query_id"], [F.desc("score"), F.asc("doc")], 2, "_r")
    best = F.max(F.when(F.col("_r") == 1, F.col("score")))
    second = F.max(F.when(F.col("_r") == 2, F.col("score")))
    lead = two.groupBy("query_id").agg((best - second).alias("margin"))
    sizes = scored.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return lead.join(sizes, "query_id")


def reading_plan(margin_rows: DataFrame, tiers: list[dict]) -> DataFrame:
    """Adds confidence, read_first and expected_hit from the first tier that fits.

    A plan has a handful of tiers, sorted by falling ``min_margin``, so the
    lookup is an expression. A single result counts as an infinite lead.
    """
    margin = F.coalesce(F.col("margin"), F.lit(float("inf")))
    plan = None
    for tier in tiers:
        value = F.struct(
            F.lit(tier["label"]).alias("confidence"),
            F.lit(int(tier["read_first"])).alias("read_first"),
            F.lit(float(tier["expected_hit"])).alias("expected_hit"),
        )
        fits = margin >= F.lit(float(tier["min_margin"]))
        plan = F.when(fits, value) if plan is None else plan.when(fits, value)
    chosen = margin_rows.withColumn("_plan", plan)
    return chosen.select(
        "query_id", F.round("margin", 4).alias("margin"), F.col("_plan.confidence").alias("confidence"),
        F.least(F.col("_plan.read_first"), F.col("n")).cast("int").alias("read_first"),
        F.col("_plan.expected_hit").alias("expected_hit"),
    )


def gold_ranks(scored: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, gold_rank): best rank of a right document; ranked rows only."""
    return (
        scored.join(gold, ["query_id", "doc"], "left_semi")
        .groupBy("query_id").agg(F.min("rank").alias("gold_rank"))
    )


def tier_table(
    results: DataFrame, target: float = TARGET_HIT, cap: int = READ_CAP,
    shares: tuple[float, ...] = TIER_SHARES, labels: tuple[str, ...] = TIER_LABELS, tie: str = "query_id",
) -> DataFrame:
    """Tiers from held-out results(query_id, margin, gold_rank), one row per tier.

    Results sorted by falling margin are cut at the given shares; read_first is
    the smallest k whose hit rate meets the target. Empty tiers vanish.
    """
    n = results.count()
    placed = ranked(results, [], [F.desc("margin"), F.asc(tie)], "_i")
    cuts = [round(n * s) for s in shares]
    label = F.lit(labels[-1])
    for cut, name in reversed(list(zip(cuts, labels))):
        label = F.when(F.col("_i") <= cut, F.lit(name)).otherwise(label)
    hit = lambda k: F.coalesce(F.col("gold_rank") <= k, F.lit(False)).cast("double")
    grouped = placed.withColumn("label", label).groupBy("label").agg(
        F.min("margin").alias("_low"), F.max("_i").alias("_last"), F.count(F.lit(1)).alias("n"),
        *[F.avg(hit(k)).alias(f"_h{k}") for k in range(1, cap + 1)],
    )
    read = F.lit(cap)
    rate = F.col(f"_h{cap}")
    for k in range(cap, 0, -1):
        enough = F.col(f"_h{k}") >= F.lit(target)
        rate = F.when(enough, F.col(f"_h{k}")).otherwise(rate)
        read = F.when(enough, F.lit(k)).otherwise(read)
    return grouped.select(
        "label",
        F.when(F.col("_last") < n, F.round("_low", 4)).otherwise(F.lit(0.0)).alias("min_margin"),
        read.alias("read_first"), F.round(rate, 3).alias("expected_hit"),
        F.round("_h1", 3).alias("hit_at_1"), "n",
    )


def fit_tiers(results: DataFrame, target: float = TARGET_HIT, tie: str = "query_id") -> list[dict]:
    """The tiers as plain rows (at most three), pooled when they do not separate."""
    tiers = _sorted(tier_table(results, target, tie=tie))
    if any(a["read_first"] > b["read_first"] for a, b in zip(tiers, tiers[1:])):
        tiers = _sorted(tier_table(results, target, shares=(), labels=("low",), tie=tie))
    return tiers


def _sorted(table: DataFrame) -> list[dict]:
    order = {name: i for i, name in enumerate(TIER_LABELS)}
    return sorted((r.asDict() for r in table.collect()), key=lambda t: order[t["label"]])


def holdout_check(results: DataFrame, newest: list[Column], target: float = TARGET_HIT) -> DataFrame:
    """One row: the plan fitted on the older two thirds, scored on the newest third."""
    n = results.count()
    n_test = n // HOLDOUT_PART
    placed = ranked(results, [], newest, "_age")
    tiers = fit_tiers(placed.where(F.col("_age") > n_test).drop("_age"), target)
    test = placed.where(F.col("_age") <= n_test).withColumn("n", F.lit(1 << 30))
    planned = reading_plan(test, tiers).join(test.select("query_id", "gold_rank"), "query_id")
    observed = F.avg(F.coalesce(F.col("gold_rank") <= F.col("read_first"), F.lit(False)).cast("double"))
    return planned.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("expected_hit"), 3).alias("claimed"),
        F.round(observed, 3).alias("observed"), F.round(F.avg("read_first"), 1).alias("avg_files"),
    )
