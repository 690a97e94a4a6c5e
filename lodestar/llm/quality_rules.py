"""Quality by weak supervision: rules vote or abstain, and their agreement tells how far each is to be believed.

All documents give one narrow row of counts. Each rule turns the counts into a
vote (1 good, -1 bad, 0 abstains). Documents are counted by pattern of votes (at
most three to the power of the number of rules), and expectation-maximisation on
the patterns estimates how often each rule votes what on good and on bad
documents, for one kind of defect after another. A document stays if the
probability that it has none of the defects is high enough, so one doubtful
count does not reject it and several together do.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import SPACE, let, pick, words_of

VOTES = (1, 0, -1)
ROUNDS = 200
KEEP_FROM = 0.5
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """SQL conditions over the counts, and the defect they tell of; where neither or both hold, the rule abstains."""

    name: str
    defect: str
    good: str
    bad: str


#: Every defect shows in two counts or more, so that its rules can confirm each other.
RULES = (
    Rule("symbols", "symbols", "n_symbols <= 0.02 * n_words", "n_symbols > 0.1 * n_words"),
    Rule("symbol_runs", "symbols", "n_symbol_runs <= 0.01 * n_words", "n_symbol_runs > 0.05 * n_words"),
    Rule("bare_symbols", "symbols", "n_bare_symbols <= 0.02 * n_words", "n_bare_symbols > 0.08 * n_words"),
    Rule("word_length", "symbols", "word_chars BETWEEN 3 * n_words AND 6.5 * n_words", "word_chars < 2 * n_words OR word_chars > 7 * n_words"),
    Rule("repeated_lines", "repeats", "n_dup_lines <= 0.1 * n_lines", "n_dup_lines > 0.4 * n_lines"),
    Rule("repeated_words", "repeats", "n_repeat_words <= 0.15 * n_words", "n_repeat_words > 0.4 * n_words"),
    Rule("distinct_words", "repeats", "n_distinct_words >= 0.4 * n_words", "n_distinct_words < 0.25 * n_words"),
    Rule("capitals", "shouting", "n_capitals <= 0.1 * word_chars", "n_capitals > 0.3 * word_chars"),
    Rule("exclamations", "shouting", "n_shouts <= 0.02 * n_words", "n_shouts > 0.2 * n_words"),
)


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice, from the sorted window hashes of one text."""
    def window(i: Column) -> Column:
        return F.struct(F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1)).alias("h"), i.alias("p"))

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1), p + 3) - p))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def twice(hashes: Column) -> Column:
        found = F.filter(hashes, lambda w, i: (w["h"] == F.get(hashes, i - 1)["h"]) | (w["h"] == F.get(hashes, i + 1)["h"]))
        return let(F.sort_array(F.transform(found, lambda w: w["p"])), covered)

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - 2), window)
    return F.when(F.size(words) >= 3, let(F.sort_array(windows), twice)).otherwise(0)


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts per row, without a shuffle: ``doc_id`` and the columns the rules read."""
    docs = pick(docs, doc_id=id_col, text=text_col)
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    by_words = let(words_of(F.col("text")), lambda w: F.struct(F.size(w).alias("n_words"), F.size(F.array_distinct(w)).alias("n_distinct_words"), _repeat_words(w).alias("n_repeat_words")))
    by_lines = let(lines, lambda w: F.struct(F.size(w).alias("n_lines"), (F.size(w) - F.size(F.array_distinct(w))).alias("n_dup_lines")))
    rows = docs.select(
        "doc_id", by_words.alias("w"), by_lines.alias("l"), F.length(F.regexp_replace(text, SPACE, "")).alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).alias("n_symbols"),
        (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))).alias("n_capitals"),
        F.regexp_count(text, F.lit(rf"(?<![^\x20\x09-\x0D]){SYMBOLS}+(?![^\x20\x09-\x0D])")).alias("n_bare_symbols"),
        F.regexp_count(text, F.lit(SYMBOLS + "{3,}")).alias("n_symbol_runs"), (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).alias("n_shouts"),
    )
    names = {n: n for n in ("word_chars", "n_symbols", "n_symbol_runs", "n_bare_symbols", "n_capitals", "n_shouts")}
    names |= {n: f"w.{n}" for n in ("n_words", "n_distinct_words", "n_repeat_words")} | {n: f"l.{n}" for n in ("n_lines", "n_dup_lines")}
    return rows.select("doc_id", *[F.col(c).cast("long").alias(n) for n, c in names.items()])


def vote(rule: Rule) -> Column:
    return F.coalesce(F.expr(f"({rule.good})").cast("int"), F.lit(0)) - F.coalesce(F.expr(f"({rule.bad})").cast("int"), F.lit(0))


def expectation_maximisation(patterns: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """Share of documents without a defect, and for each of its rules the chance of each vote without and with it.

    Starts from a rare defect and rules that are mostly right, and keeps that
    order: no rule may vote good more often on documents with the defect, or bad
    more often on those without, so that the two kinds cannot change places.
    """
    n = len(next(iter(patterns), ()))
    good = 0.9
    table = [{1: (0.9, 0.25), 0: (0.08, 0.15), -1: (0.02, 0.6)} for _ in range(n)]
    total = sum(patterns.values())
    for _ in range(rounds if total else 0):
        weight = [{v: [1.0, 1.0] for v in VOTES} for _ in range(n)]  # one imagined document of each kind smooths
        mass = [1.0, 1.0]
        for pattern, number in patterns.items():
            p = posterior(pattern, good, table)
            for kind, share in enumerate((p, 1 - p)):
                mass[kind] += share * number
                for j, v in enumerate(pattern):
                    weight[j][v][kind] += share * number
        before, good = good, max(0.5, mass[0] / sum(mass))
        table = []
        for w in weight:
            share = {v: [w[v][k] / sum(w[u][k] for u in VOTES) for k in (0, 1)] for v in VOTES}
            for v, best in ((1, 0), (-1, 1)):  # keep the order of the two kinds
                if share[v][1 - best] > share[v][best]:
                    share[v] = [sum(share[v]) / 2] * 2
            table.append({v: tuple(share[v]) for v in VOTES})
        if abs(before - good) < 1e-9:
            break
    return good, table


def posterior(pattern: tuple[int, ...], good: float, table: list[dict[int, tuple[float, float]]]) -> float:
    """Chance that a document with these votes is without the defect."""
    odds = math.log(good) - math.log(1 - good) + sum(math.log(t[v][0]) - math.log(t[v][1]) for v, t in zip(pattern, table))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep_from: float = KEEP_FROM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, ``base_failed``, ``posterior`` and ``kept`` of every row.

    ``base_failed``: fewer than 50 words, or more than half of them in repeated
    windows; such documents are not kept. Null and empty texts have no words.
    Repeated rows stay repeated and count as often; an empty table gives an
    empty result; other columns are ignored. Only the patterns, at most
    ``3 ** len(rules)`` rows, reach the driver.
    """
    rows = materialise(counts(docs, id_col, text_col), "quality-counts")
    votes = [vote(r).alias(f"vote_{i}") for i, r in enumerate(rules)]
    seen = rows.select(*votes).groupBy(*[f"vote_{i}" for i in range(len(rules))]).count().collect()
    sound = F.lit(1.0)
    for defect in dict.fromkeys(r.defect for r in rules):
        mine = [i for i, r in enumerate(rules) if r.defect == defect]
        patterns: Counter[tuple[int, ...]] = Counter()
        for r in seen:
            patterns[tuple(r[i] for i in mine)] += r["count"]
        good, table = expectation_maximisation(patterns)
        odds = F.lit(math.log(good) - math.log(1 - good))
        for i, chances in zip(mine, table):
            value = {v: math.log(chances[v][0]) - math.log(chances[v][1]) for v in VOTES}
            odds = odds + F.when(vote(rules[i]) > 0, value[1]).when(vote(rules[i]) < 0, value[-1]).otherwise(value[0])
        sound = sound / (1 + F.exp(-odds))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("posterior", sound).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("posterior") >= keep_from))
