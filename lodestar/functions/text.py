"""Tokenisers and text predicates as Column expressions and row generators.

The tokenisers explode early and normalise each token with ordinary column
functions, which keeps the work inside generated code; no Python is involved.
All character classes are ASCII: accented letters separate tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- Fixed values: word lists, patterns and limits that define the results. ---
SIMILARITY_STOPWORDS = """
the and for with from this that have will should would could been when where
which while about into onto issue ticket please need needs want wants make makes
using use uses add adds fix fixes update updates feature features decision
architectural change commit merge branch
""".split()

KEYWORD_STOPWORDS = """
the and for with from this that have will should would could been when where
which while about into onto issue ticket please need needs want wants make makes
using use uses add adds fix fixes update updates feature features
""".split()

QUERY_STOPWORDS = """
the and for with from this that have will should would could been when where
which while about into onto issue ticket please need needs want wants make makes
using use uses add adds fix fixes fixed bug bugs update updates feature features
error fails failed failure test tests
""".split()

CODE_STOPWORDS = """
a an and are as at be been but by can could do does for from has have how i if
in into is it its itself me my no not of on or our out so than that the their
them then there these they this to too up us was we were what when where which
while who will with would you your self cls none true false return def class
import pass else elif try except raise finally lambda yield assert del global
print should also just like get set new use used using work works way want
issue bug fix error problem expected actual result results case example following
""".split()

LOW_SIGNAL_TERMS = """
model models file files test tests core utils base common helper helpers config
settings index main app apps type types
""".split()

LOW_SIGNAL_FACTOR = 0.35
MIN_CODE_TOKEN = 3
MIN_LITERAL = 12
MAX_LITERAL = 300

CAMEL_BOUNDARY = "(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
CAMEL_DIGIT_BOUNDARY = "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"
SET_TOKEN = "[a-z_][a-z0-9_]{2,}"
KEYWORD_TOKEN = "[a-z_][a-z0-9_]{3,}"
INDEX_IDENTIFIER = "[a-zA-Z_][a-zA-Z0-9_]{3,}"
FORMAT_HOLE = r"%[-#0 +]*\d*(?:\.\d+)?[sdrfi]|\{[^{}]*\}"
TICKET_ID = r"(?i)(?:ticket|issue|PR)\s*#?\s*(\d+)"

REVERT_WORDS = ("revert", "rollback", "undo")
DECISION_WORDS = ("refactor:", "migrate", "replace", "switch to", "breaking:")
FAILED_WORDS = ("fix:", "hotfix", "workaround")
BREAKING_WORDS = ("breaking:", "revert", "rollback")
PATTERN_PREFIXES = ("feat:", "perf:")
NOISE_PREFIXES = ("docs:", "chore:", "style:", "test:", "ci:")
SEMANTIC_PREFIXES = ("feat:", "fix:", "perf:", "refactor:")
# --- End of fixed values. ---


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of ``pattern`` (the given group) as an array."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    """True when ``text`` contains one of ``words``."""
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


def any_prefix(text: Column, prefixes: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for prefix in prefixes:
        hit = hit | text.startswith(prefix)
    return hit


# ---------------------------------------------------------------- tokenisers
def code_token_rows(df: DataFrame, text: Column, *keys: str, out: str = "term") -> DataFrame:
    """Bag of code tokens, one row each (camel and snake parts, length >= 3)."""
    pieces = F.split(F.regexp_replace(text, CAMEL_BOUNDARY, "_"), "[^A-Za-z0-9]+")
    return (
        df.select(*keys, F.explode(pieces).alias(out))
        .where(F.length(out) >= MIN_CODE_TOKEN)
        .withColumn(out, F.lower(out))
        .where(~F.col(out).isin(SIMILARITY_STOPWORDS))
    )


def code_term_rows(df: DataFrame, text: Column, *keys: str, out: str = "term") -> DataFrame:
    """Whole identifiers plus their sub-tokens, one row each.

    A compound identifier yields its lower-case self (length >= 3) and all its
    parts; parts shorter than 2, stop words and numbers are left out.
    """
    idents = df.select(*keys, F.explode(matches(text, IDENTIFIER)).alias("_ident"))
    marked = F.regexp_replace("_ident", CAMEL_DIGIT_BOUNDARY, "_")
    parts = F.split(F.regexp_replace(marked, "^_+|_+$", ""), "_+")
    split = idents.select(*keys, "_ident", parts.alias("_parts"))
    whole_first = F.when(
        (F.size("_parts") > 1) & (F.length("_ident") >= 3),
        F.concat(F.array("_ident"), F.col("_parts")),
    ).otherwise(F.concat(F.array(F.lit(None).cast("string")), F.col("_parts")))
    rows = split.select(*keys, F.posexplode(whole_first).alias("_pos", "_raw"))
    term = F.lower("_raw")
    keep_part = (
        (F.length("_raw") >= 2) & ~term.isin(CODE_STOPWORDS) & ~F.col("_raw").rlike("^[0-9]+$")
    )
    return rows.where(
        F.col("_raw").isNotNull() & ((F.col("_pos") == 0) | keep_part)
    ).select(*keys, term.alias(out))


def code_term_count(text: Column) -> Column:
    """How many rows ``code_term_rows`` gives for a text; 0 for null."""
    def terms(ident: Column) -> Column:
        parts = F.split(F.regexp_replace(F.regexp_replace(ident, CAMEL_DIGIT_BOUNDARY, "_"), "^_+|_+$", ""), "_+")
        kept = F.filter(parts, lambda p: (F.length(p) >= 2) & ~F.lower(p).isin(CODE_STOPWORDS) & ~p.rlike("^[0-9]+$"))
        return F.size(kept) + F.when((F.size(parts) > 1) & (F.length(ident) >= 3), 1).otherwise(0)

    counts = F.transform(matches(text, IDENTIFIER), terms)
    return F.coalesce(F.aggregate(counts, F.lit(0).cast("long"), lambda total, n: total + n), F.lit(0).cast("long"))


def set_token_rows(
    df: DataFrame, text: Column, *keys: str, pattern: str = SET_TOKEN,
    stopwords: list[str] | None = None, out: str = "term",
) -> DataFrame:
    """Distinct lower-case tokens of each row, as needed by the set similarities."""
    stop = SIMILARITY_STOPWORDS if stopwords is None else stopwords
    tokens = F.array_distinct(matches(F.lower(text), pattern))
    return df.select(*keys, F.explode(tokens).alias(out)).where(~F.col(out).isin(stop))


def token_set(text: Column, pattern: str = SET_TOKEN, stopwords: list[str] | None = None) -> Column:
    """The same token set as an array column (empty, never NULL)."""
    stop = SIMILARITY_STOPWORDS if stopwords is None else stopwords
    found = F.array_distinct(matches(F.lower(text), pattern))
    kept = F.array_except(found, F.array(*[F.lit(w) for w in stop]))
    return F.coalesce(kept, F.array().cast("array<string>"))


def keyword_set(text: Column) -> Column:
    return token_set(text, KEYWORD_TOKEN, KEYWORD_STOPWORDS)


def index_identifiers(text: Column) -> Column:
    """Lower-case identifiers of length >= 4, distinct."""
    return F.array_distinct(F.transform(matches(text, INDEX_IDENTIFIER), lambda x: F.lower(x)))


def query_token_rows(df: DataFrame, text: Column, *keys: str, out: str = "term") -> DataFrame:
    """Query-side tokens: camel and snake parts, length >= 3, larger stop list."""
    marked = F.regexp_replace(F.regexp_replace(text, r"\\", "/"), "(?<=[a-z0-9])(?=[A-Z])", "_")
    return (
        df.select(*keys, F.explode(F.split(marked, "[^A-Za-z0-9]+")).alias(out))
        .where(F.length(out) >= MIN_CODE_TOKEN)
        .withColumn(out, F.lower(out))
        .where(~F.col(out).isin(QUERY_STOPWORDS))
    )


def expanded_token_set(text: Column) -> Column:
    """Set tokens plus their snake parts and letter runs (length >= 3)."""
    base = token_set(text)
    snake = F.filter(F.flatten(F.transform(base, lambda t: F.split(t, "_"))), lambda p: F.length(p) >= 3)
    runs = F.filter(
        F.flatten(F.transform(base, lambda t: F.regexp_extract_all(t, F.lit("[a-z]+"), F.lit(0)))),
        lambda p: F.length(p) >= 3,
    )
    return F.array_union(F.array_union(base, snake), runs)


# ------------------------------------------------------------- small scalars
def title_of(text: Column) -> Column:
    """First non-blank line, stripped, at most 240 characters."""
    return F.left(F.regexp_extract(text, r"^\s*([^\r\n]*?)[ \t]*(?:[\r\n]|$)", 1), F.lit(240))


def literal_fragment(value: Column) -> Column:
    """Longest constant part of a message, or NULL when it is no usable literal.

    The value must be a single line of 12 to 300 characters; the kept part is
    lower case, at least 12 long and holds a space.
    """
    parts = F.split(value, FORMAT_HOLE)
    longest = F.aggregate(
        parts, F.lit(""),
        lambda best, part: F.when(F.length(part) > F.length(best), part).otherwise(best),
    )
    frag = F.lower(F.trim(longest))
    ok = (
        F.length(value).between(MIN_LITERAL, MAX_LITERAL)
        & ~F.trim(value).contains("\n")
        & (F.length(frag) >= MIN_LITERAL)
        & frag.contains(" ")
    )
    return F.when(ok, frag)


def ticket_id(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, TICKET_ID, 1), F.lit("")).cast("bigint")


def classify_commit(message: Column) -> Column:
    """avoid / decision / failed / pattern / noise, first rule that matches."""
    low = F.trim(F.lower(message))
    return (
        F.when(any_of(low, REVERT_WORDS), "avoid")
        .when(any_of(low, DECISION_WORDS), "decision")
        .when(any_of(low, FAILED_WORDS), "failed")
        .when(any_prefix(low, PATTERN_PREFIXES), "pattern")
        .otherwise("noise")
    )


def normalised_lower(text: Column) -> Column:
    """Lower case with every whitespace run turned into one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def compact(text: Column, budget: int, marker: str = "\n... evidence compacted ...\n") -> Column:
    """Head two thirds, marker, tail third when ``text`` is over ``budget``."""
    usable = max(0, budget - len(marker))
    head = max(1, usable * 2 // 3)
    return F.when(F.length(text) <= budget, text).otherwise(
        F.concat(F.left(text, F.lit(head)), F.lit(marker), F.right(text, F.lit(usable - head)))
    )
