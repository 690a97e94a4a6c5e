"""Evidence taken from the text of a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X

# --- Fixed values: weights and patterns. Word characters are Unicode letters, digits, "_". ---
PATH_WEIGHT = 5.0
MODULE_WEIGHT = 4.0
SYMBOL_WEIGHT = 3.0
SYMBOL_PART_WEIGHT = 2.0
EXCEPTION_WEIGHT = 2.0
WORD_RUN = r"[\p{L}\p{N}_]+"
DOTTED_NAME = (
    r"(?:^|[^\p{L}\p{N}_])([A-Za-z_][\p{L}\p{N}_]*(?:\.[A-Za-z_][\p{L}\p{N}_]*)+)"
)
EXCEPTION_NAME = r"^[A-Z][A-Za-z0-9_]*(?:Error|Exception|Warning)$"
QUOTED = "[`'\"]([^`'\"]{3,120})[`'\"]"
MENTIONED_PATH = (
    r"(?<![A-Za-z0-9_])([A-Za-z0-9_./\\-]+\."
    r"(?:c|cpp|cs|go|h|java|js|jsx|kt|py|rb|rs|ts|tsx))(?![A-Za-z0-9_])"
)
SOURCE_PATH = r"(?i)[\w./\\-]+\.(?:pyi?|jsx?|mjs|cjs|tsx?|go|rs|java|cs)\b"
PYTHON_FRAME = r'File "([^"]+\.py)", line (\d+), in (\w+)'
TEST_RUN_FRAME = r"(?m)^([\w./\\-]+\.py):(\d+):"
GENERIC_FRAME = (
    r"(?i)([\w./\\-]+\.(?:pyi?|jsx?|mjs|cjs|tsx?|go|rs|java|cs)):(\d+)(?::\d+)?"
)
FROM_IMPORT = r"(?m)^\s*(?:>>>\s*)?from\s+([\w.]+)\s+import\s+([\w, ()*]+)"
PLAIN_IMPORT = r"(?m)^\s*(?:>>>\s*)?import\s+([\w., ]+)"
# --- End of fixed values. ---


def word_runs(text: Column) -> Column:
    """Identifiers of length >= 3 as written: whole word runs with an ASCII start."""
    return F.filter(
        X.matches(text, WORD_RUN), lambda w: w.rlike("^[A-Za-z_]") & (F.length(w) >= 3)
    )


def dotted_names(text: Column) -> Column:
    return X.matches(text, DOTTED_NAME, 1)


def mentioned_paths(text: Column) -> Column:
    return F.transform(X.matches(text, MENTIONED_PATH, 1), lambda p: P.normal(p))


def dotted_modules(text: Column) -> Column:
    """Dotted names that are no file names."""
    ends = r"\.(" + "|".join(s[1:] for s in P.INDEX_SUFFIXES) + ")$"
    return F.filter(dotted_names(text), lambda d: ~F.lower(d).rlike(ends))


def exceptions(text: Column) -> Column:
    return F.filter(X.matches(text, r"[A-Za-z0-9_]+"), lambda w: w.rlike(EXCEPTION_NAME))


def quoted_words(text: Column) -> Column:
    """Words of quoted snippets of at most four words, lower case."""
    short = F.filter(X.matches(text, QUOTED, 1), lambda q: F.size(F.split(F.trim(q), r"\s+")) <= 4)
    return F.transform(
        F.flatten(F.transform(short, lambda q: F.split(split_marks(q), "[^A-Za-z0-9]+"))),
        lambda w: F.lower(w),
    )


def split_marks(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, r"\\", "/"), "(?<=[a-z0-9])(?=[A-Z])", "_")


def symbols(text: Column) -> Column:
    """Lower-case identifiers that look like code: underscore, capital or quoted."""
    quoted = quoted_words(text)
    marked = F.filter(
        word_runs(text),
        lambda w: ~F.lower(w).isin(X.QUERY_STOPWORDS)
        & (w.contains("_") | w.rlike("^[A-Z]") | F.array_contains(quoted, F.lower(w))),
    )
    return F.transform(marked, lambda w: F.lower(w))


def weighted_terms(queries: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, term, weight): every kind of evidence adds its weight.

    Words too general to decide count 0.35 times.
    """
    body = F.col(text)
    pieces = F.flatten(
        F.array(
            F.array(F.struct(body.alias("v"), F.lit(1.0).alias("w"), F.lit(True).alias("split"))),
            _weighted(F.transform(mentioned_paths(body), lambda p: P.without_suffix(p)), PATH_WEIGHT, True),
            _weighted(dotted_modules(body), MODULE_WEIGHT, True),
            _weighted(symbols(body), SYMBOL_WEIGHT, False),
            _weighted(symbols(body), SYMBOL_PART_WEIGHT, True),
            _weighted(exceptions(body), EXCEPTION_WEIGHT, False),
            _weighted(exceptions(body), EXCEPTION_WEIGHT, True),
        )
    )
    parts = queries.select("query_id", F.explode(pieces).alias("p")).select("query_id", "p.*")
    words = F.when(
        F.col("split"), F.split(split_marks(F.col("v")), "[^A-Za-z0-9]+")
    ).otherwise(F.array("v"))
    terms = (
        parts.select("query_id", "w", F.explode(words).alias("term"))
        .withColumn("term", F.trim(F.lower("term")))
        .where((F.length("term") >= 3) & ~F.col("term").isin(X.QUERY_STOPWORDS))
    )
    factor = F.when(F.col("term").isin(X.LOW_SIGNAL_TERMS), X.LOW_SIGNAL_FACTOR).otherwise(1.0)
    return terms.groupBy("query_id", "term").agg(F.sum(F.col("w") * factor).alias("weight"))


def _weighted(values: Column, weight: float, split: bool) -> Column:
    return F.transform(
        values,
        lambda v: F.struct(v.alias("v"), F.lit(weight).alias("w"), F.lit(split).alias("split")),
    )


def _frames(text: Column, pattern: str, func_group: int | None) -> Column:
    found = F.transform(X.matches(text, pattern, 1), lambda p: P.slashed(p))
    funcs = X.matches(text, pattern, func_group) if func_group else F.transform(found, lambda p: F.lit(""))
    return F.transform(
        F.arrays_zip(found.alias("path"), funcs.alias("func")),
        lambda s: F.struct(s["path"].alias("path"), s["func"].alias("func")),
    )


def frames(text: Column) -> Column:
    """Stack frames (path, func), outermost first; generic ones only for new paths."""
    known = F.concat(_frames(text, PYTHON_FRAME, 3), _frames(text, TEST_RUN_FRAME, None))
    known_paths = F.transform(known, lambda f: f["path"])
    extra = F.filter(
        _frames(text, GENERIC_FRAME, None), lambda f: ~F.array_contains(known_paths, f["path"])
    )
    return F.concat(known, extra)


def snippet_imports(text: Column) -> Column:
    """Modules named by import lines of quoted code."""
    bases = X.matches(text, FROM_IMPORT, 1)
    lists = X.matches(text, FROM_IMPORT, 2)
    named = F.flatten(
        F.transform(
            F.arrays_zip(bases.alias("m"), lists.alias("n")),
            lambda s: F.concat(
                F.array(s["m"]),
                F.transform(
                    F.filter(F.split(s["n"], r"[,\s()]+"), lambda x: (x != "") & (x != "*")),
                    lambda x: F.concat(s["m"], F.lit("."), x),
                ),
            ),
        )
    )
    plain = F.filter(
        F.transform(
            F.flatten(F.transform(X.matches(text, PLAIN_IMPORT, 1), lambda l: F.split(l, ","))),
            lambda x: F.element_at(F.split(F.trim(x), " "), 1),
        ),
        lambda x: x != "",
    )
    return F.concat(named, plain)


def issue_paths(text: Column) -> Column:
    return F.transform(
        X.matches(text, SOURCE_PATH), lambda p: F.regexp_replace(P.slashed(p), r"^[./]+", "")
    )


def identifier_rows(queries: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, ident, cnt): identifiers of length >= 3, lower case."""
    rows = queries.select("query_id", F.explode(X.matches(F.col(text), X.IDENTIFIER)).alias("i"))
    return (
        rows.where(F.length("i") >= 3)
        .groupBy("query_id", F.lower("i").alias("ident"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def issue_signals(queries: DataFrame) -> DataFrame:
    """One row per query with all list-valued signals (title and text given)."""
    text = F.col("text")
    return queries.select(
        "query_id", "title",
        dotted_names(text).alias("dotted"),
        issue_paths(text).alias("paths"),
        frames(text).alias("frames"),
        snippet_imports(text).alias("imports"),
        X.normalised_lower(text).alias("text_lower"),
    )
