"""Evidence cards: the text windows that best match a question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

# --- Fixed values. ---
WINDOW_LINES = 12
STRIDE = 6
WINDOWS_PER_FILE = 4
MAX_OUTLINE = 40
LINE_CUT = 140
# --- End of fixed values. ---


def window_scores(best: DataFrame, docs: DataFrame, query_terms: DataFrame) -> DataFrame:
    """(query_id, doc, start, hits) for every 12-line window of the answered documents.

    ``best`` is (query_id, doc), ``docs`` (doc, text), ``query_terms``
    (query_id, term). A term counts once per window.
    """
    lines = best.select("query_id", "doc").join(docs, "doc").select(
        "query_id", "doc", F.split("text", r"\r?\n").alias("lines")
    )
    last = F.greatest(F.size("lines") - WINDOW_LINES, F.lit(0))
    windows = lines.select("query_id", "doc", F.explode(F.sequence(F.lit(0), last, F.lit(STRIDE))).alias("start"))
    numbered = lines.select("query_id", "doc", last.alias("_last"), F.posexplode("lines").alias("line_no", "line"))
    terms = X.code_term_rows(numbered, F.col("line"), "query_id", "doc", "line_no", "_last").join(
        query_terms.select("query_id", "term").distinct(), ["query_id", "term"]
    )
    block = F.floor(F.col("line_no") / STRIDE) * STRIDE
    placed = terms.select(
        "query_id", "doc", "term", "_last", F.explode(F.array(block, block - STRIDE)).alias("start")
    ).where((F.col("start") >= 0) & (F.col("start") <= F.col("_last")))
    hits = placed.groupBy("query_id", "doc", F.col("start").cast("int").alias("start")).agg(
        F.count_distinct("term").alias("hits")
    )
    return windows.join(hits, ["query_id", "doc", "start"], "left").fillna(0, ["hits"])


def pick_windows(scored: DataFrame) -> DataFrame:
    """(query_id, doc, starts): up to four windows that do not overlap, best first.

    Ties prefer the later window. The greedy choice folds over the windows of
    one document, whose number is bounded by that document.
    """
    ordered = F.sort_array(F.collect_list(F.struct("hits", "start")), asc=False)
    picked = F.aggregate(
        "ordered",
        F.array().cast("array<int>"),
        lambda acc, w: F.when(
            (F.size(acc) < WINDOWS_PER_FILE)
            & F.forall(acc, lambda s: F.abs(s - w["start"]) >= WINDOW_LINES),
            F.concat(acc, F.array(w["start"])),
        ).otherwise(acc),
    )
    return scored.groupBy("query_id", "doc").agg(ordered.alias("ordered")).select(
        "query_id", "doc", F.array_sort(picked).alias("starts")
    )


def outline(defs: DataFrame, best: DataFrame, idents: DataFrame) -> DataFrame:
    """(query_id, doc, outline): defined names, those of the question starred.

    Over 40 names, the starred ones and the first others stay.
    """
    said = idents.select("query_id", F.col("ident").alias("_i"), F.lit(True).alias("_said")).distinct()
    rows = best.select("query_id", "doc").join(defs.select("doc", "symbol", "kind"), "doc")
    marked = rows.join(said, [rows.query_id == said.query_id, F.lower("symbol") == said["_i"]], "left").select(
        rows.query_id, "doc", "symbol", "kind", F.coalesce("_said", F.lit(False)).alias("_said")
    )
    entry = F.concat("kind", F.lit(" "), "symbol", F.when(F.col("_said"), "*").otherwise(""))
    ordered = F.array_sort(F.collect_list(F.struct((~F.col("_said")).alias("o"), F.col("symbol"), entry.alias("e"))))
    return marked.groupBy("query_id", "doc").agg(
        F.array_join(F.transform(F.slice(ordered, 1, MAX_OUTLINE), lambda s: s["e"]), "; ").alias("outline")
    )


def cards(best: DataFrame, docs: DataFrame, query_terms: DataFrame) -> DataFrame:
    """(query_id, doc, card): the picked windows with line numbers."""
    picked = pick_windows(window_scores(best, docs, query_terms))
    joined = picked.join(docs, "doc").withColumn("lines", F.split("text", r"\r?\n"))
    numbered = F.transform(
        "starts",
        lambda s: F.array_join(
            F.transform(
                F.sequence(s, F.least(s + WINDOW_LINES, F.size("lines")) - 1),
                lambda i: F.concat(
                    (i + 1).cast("string"), F.lit(": "), F.left(F.element_at("lines", i + 1), F.lit(LINE_CUT))
                ),
            ),
            "\n",
        ),
    )
    return joined.select("query_id", "doc", F.array_join(numbered, "\n...\n").alias("card"))
