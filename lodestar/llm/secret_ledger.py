"""Secret scans with an incremental ledger of blobs.

Every version of a text is addressed by its SHA-256. The ledger is a table of
(blob, rule version, spans), kept by blob and rule version. A scan looks only at
pairs that the ledger lacks, each different text once, adds their spans (also
where there are none) and joins the findings back to all paths that hold a blob.
A changed rule gets a new version and is run alone on what is already known.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialise
from .common import let, pick


@dataclass(frozen=True)
class Rule:
    """A kind of secret: Java pattern, and the least length of one of its groups (0: the whole match)."""

    kind: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: Fixed patterns of the base kinds. The runs of ``access`` and ``hex`` are maximal, so their least length is in the pattern.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("hub_token", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("url_login", r"://[^\x20\x09-\x0D:/@]+:[^\x20\x09-\x0D:/@]+@"),
)
RULES = BASE + MORE
_SPANS = "array<struct<start:int,end:int>>"
_LEDGER = f"blob string, rule string, spans {_SPANS}"


def find_spans(text: Column, rule: Rule) -> Column:
    """Sorted spans of a rule in a text, in code points, end exclusive; leftmost matches that do not overlap.

    Matches and the gaps between them take turns, so their lengths add up to the places.
    """
    def walk(found: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            start = state["at"] + F.length(F.get(found["gaps"], i))
            end = start + F.length(F.get(found["matches"], i))
            kept = F.length(F.get(found["values"], i)) >= rule.least
            span = F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))
            return F.struct(end.cast("int").alias("at"), F.when(kept, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

        begin = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))
        return F.aggregate(F.sequence(F.lit(0), F.size(found["matches"]) - 1), begin, step, lambda s: s["spans"])

    pattern = F.lit(rule.pattern)
    parts = F.struct(
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("matches"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("values"),
        F.split(text, rule.pattern, -1).alias("gaps"),
    )
    return F.when(text.rlike(rule.pattern), let(parts, walk)).otherwise(F.array().cast(_SPANS))


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def update(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scan the (blob, rule) pairs of ``versions(blob, text)`` that the ledger at a path lacks, and append them.

    Copies are scanned once. Blobs known for all rules are left out before any
    text moves. A crash before the append leaves the ledger as it was; scanning
    again then repeats the work, and readers take each pair once.
    """
    spark = versions.sparkSession
    fresh = versions
    if _exists(spark, ledger):
        known = spark.read.schema(_LEDGER).parquet(ledger).where(F.col("rule").isin([r.key for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("known"))
        fresh = versions.join(known, "blob", "left").where(F.coalesce(F.size("known"), F.lit(0)) < len(rules))
    else:
        fresh = versions.withColumn("known", F.lit(None).cast("array<string>"))
    fresh = fresh.groupBy("blob").agg(F.first("text").alias("text"), F.first("known").alias("known"))
    entries = [F.struct(F.lit(r.key).alias("rule"), find_spans(F.col("text"), r).alias("spans"), F.coalesce(F.array_contains("known", r.key), F.lit(False)).alias("old")) for r in rules]
    rows = fresh.select("blob", F.explode(F.array(*entries)).alias("e")).where(~F.col("e.old"))
    rows.select("blob", "e.rule", "e.spans").write.mode("append").parquet(ledger)


def findings(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(blob, spans)`` of the blobs with any finding; spans of kind, start and end, by start and then by order of the rules."""
    found = spark.read.schema(_LEDGER).parquet(ledger).where((F.size("spans") > 0) & F.col("rule").isin([r.key for r in rules])).dropDuplicates(["blob", "rule"])
    order = F.coalesce(*[F.when(F.col("rule") == r.key, F.lit(i)) for i, r in enumerate(rules)])
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("order").alias("order"), s["end"].alias("end")))
    per_blob = found.withColumn("order", order).groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list(spans))).alias("found"))  # one list per rule
    kind = F.array(*[F.lit(r.kind) for r in rules])
    return per_blob.select("blob", F.transform("found", lambda s: F.struct(F.get(kind, s["order"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def address(text: Column) -> Column:
    """SHA-256 of a text; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, blob, spans)`` of every row: its text's findings, an empty array if there are none.

    Null texts count as empty; repeated rows and copies stay and share their
    blob's findings; an empty table gives an empty result; other columns are
    ignored.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    rows = rows.select("doc_id", address(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    paths = materialise(rows.select("doc_id", "blob"), "ledger-paths")
    update(rows.select("blob", "text"), ledger, rules)
    found = findings(docs.sparkSession, ledger, rules)
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return paths.join(found, "blob", "left").select("doc_id", "blob", F.coalesce("spans", none).alias("spans"))


def digest(scanned: DataFrame, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """Counts of the base kinds, hash of their spans, and all spans as text."""
    def shown(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    kinds = F.array(*[F.lit(r.kind) for r in base])
    mine = F.filter("spans", lambda s: F.array_contains(kinds, s["kind"]))
    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select("doc_id", *[number(r.kind) for r in base], F.sha2(shown(mine), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``docs`` with every span of a finding replaced by its kind in brackets; texts without findings stay as they are.

    Overlapping spans become one, named by the first. ``length_col`` is set to
    the new number of code points where a text changed.
    """
    text = docs[f"`{text_col}`"]
    rows = docs.withColumn("_blob", address(text))
    update(rows.select(F.col("_blob").alias("blob"), F.coalesce(text, F.lit("")).alias("text")), ledger, rules)
    found = findings(docs.sparkSession, ledger, rules).withColumnsRenamed({"blob": "_found", "spans": "_spans"})

    def step(state: Column, span: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, span["start"] - state["at"])
        fresh = F.when(span["start"] >= state["at"], F.concat(state["out"], gap, F.lit("["), span["kind"], F.lit("]"))).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], span["end"]).alias("at"), fresh.alias("out"))

    masked = F.aggregate("_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    out = rows.join(found, F.col("_blob") == F.col("_found"), "left").withColumn("_text", F.when(F.col("_spans").isNotNull(), masked).otherwise(text))
    shown = {text_col: F.col("_text")}
    if length_col:
        shown[length_col] = F.when(F.col("_spans").isNotNull(), F.length("_text").cast(docs.schema[length_col].dataType)).otherwise(F.col(f"`{length_col}`"))
    return out.select(*[shown.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
