"""Reports, datasets and structured logs."""

from __future__ import annotations

import html
import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- Fixed values. ---
WORST_ROWS = 20
HTML_ROWS = 200
# --- End of fixed values. ---


def write_dataset(instances: DataFrame, counts: DataFrame, path: str) -> None:
    """Instances as JSON lines and the skip counts beside them."""
    instances.write.mode("overwrite").json(path)
    counts.coalesce(1).write.mode("overwrite").json(path.rstrip("/") + ".meta")


def worst(results: DataFrame, n: int = WORST_ROWS) -> DataFrame:
    """The n results with the lowest hit and recall at 10."""
    return results.orderBy("hit_10", "recall_10", "query_id").limit(n)


def write_report(summary: DataFrame, results: DataFrame, folder: str) -> None:
    """JSON of all results (distributed) plus Markdown and HTML pages.

    The pages only hold the one-row summary and a fixed number of result rows.
    """
    results.write.mode("overwrite").json(os.path.join(folder, "results"))
    s = summary.first().asDict()
    low = [r.asDict() for r in worst(results).collect()]
    some = [r.asDict() for r in results.orderBy("query_id").limit(HTML_ROWS).collect()]
    spark = results.sparkSession
    for name, text in (("report.json", json.dumps(s)), ("report.md", _markdown(s, low)), ("report.html", _html(s, some))):
        # One small text file each; lines keep their order in a single task.
        rows = [(i, line) for i, line in enumerate(text.split("\n"))]
        spark.createDataFrame(rows, "i int, value string").coalesce(1).sortWithinPartitions("i").select("value").write.mode(
            "overwrite"
        ).text(os.path.join(folder, name))


def _markdown(s: dict, rows: list[dict]) -> str:
    ks = (1, 3, 5, 10)
    table = [f"| {t} | " + " | ".join(f"{s[f'{m}_{k}']:.3f}" for k in ks) + " |" for t, m in (("Hit", "hit"), ("Recall", "recall"), ("MAP", "map"))]
    worst_rows = [f"- {r['query_id']}: hit@10 {r['hit_10']}, recall@10 {r['recall_10']:.3f}, {r['n_gold']} right" for r in rows]
    return "\n".join(
        ["# Retrieval report", "", f"- Questions: **{s['instances']}**", f"- Mean right documents: **{s['avg_gold']:.2f}**",
         f"- Mean answers: **{s['avg_predicted']:.2f}**", "", "| Metric | @1 | @3 | @5 | @10 |", "|---|---:|---:|---:|---:|",
         *table, "", "## Worst results", "", *worst_rows]
    )


def _html(s: dict, rows: list[dict]) -> str:
    body = "\n".join(
        f"<tr><td>{html.escape(str(r['query_id']))}</td><td>{r['hit_10']}</td><td>{r['recall_10']:.3f}</td></tr>" for r in rows
    )
    return (
        "<!doctype html>\n<html><head><meta charset=\"utf-8\"><title>Retrieval report</title></head><body>\n"
        f"<h1>Retrieval report</h1>\n<p>{s['instances']} questions, hit@10 {s['hit_10']:.3f}, recall@10 {s['recall_10']:.3f}</p>\n"
        f"<table><tr><th>Question</th><th>Hit@10</th><th>Recall@10</th></tr>\n{body}\n</table></body></html>"
    )


def log_lines(calls: DataFrame) -> DataFrame:
    """One JSON line per call; error fields only for failed calls."""
    return calls.select(
        F.to_json(
            F.struct(
                F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("ts"), "tool", F.round("duration_ms", 2).alias("ms"),
                F.col("output_size").alias("size"), F.col("error").isNull().alias("ok"), F.col("error").alias("err"),
                F.when(F.col("error").isNotNull(), F.left("msg", F.lit(240))).alias("msg"),
            )
        ).alias("value")
    )
