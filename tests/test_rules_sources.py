import importlib.util
import json

import pytest
from pyspark.sql import functions as F

from lodestar.operators import conflicts, diff, evidence, extract, predictor, verdict
from lodestar.plans import tools
from lodestar.sources import commits as C, files as FS, records as R, sinks
from lodestar.streaming.common import drain_batches
from lodestar.streaming.rolling import RollingCalls

PATCH = """diff --git a/svc/auth.py b/svc/auth.py
--- a/svc/auth.py
+++ b/svc/auth.py
@@ -10,4 +10,5 @@ class Auth:
 keep
-def verify(tok):
+def verify(tok, strict):
+    return 1
--- dashes removed
 keep
diff --git a/tests/test_auth.py b/tests/test_auth.py
--- a/tests/test_auth.py
+++ b/tests/test_auth.py
@@ -1 +1,2 @@
 x
+def fresh(): pass
"""


def patches(spark, *rows):
    return spark.createDataFrame(list(rows), "patch_id bigint, patch string, fallback_file string")


def test_hunks(spark):
    got = diff.hunks(diff.patch_lines(patches(spark, (1, PATCH, None)))).orderBy("hunk").collect()
    assert [(r["file"], r["old_start"], r["old_count"], r["new_count"], r["context"]) for r in got] == [
        ("svc/auth.py", 10, 4, 5, "class Auth:"), ("tests/test_auth.py", 1, 1, 2, "")]
    assert got[0]["added"] == ["def verify(tok, strict):", "    return 1"]
    assert got[0]["removed"] == ["def verify(tok):", "-- dashes removed"]


def test_hunk_without_header_uses_fallback(spark):
    got = diff.hunks(diff.patch_lines(patches(spark, (1, "@@ -1,2 +1,2 @@\n-a\n+b", "x.py")))).collect()
    assert [(r["file"], r["added"], r["removed"]) for r in got] == [("x.py", ["b"], ["a"])]
    assert diff.patch_lines(patches(spark, (1, "", "x.py"))).collect() == []


def test_signatures_and_symbols(spark):
    lines = diff.patch_lines(patches(spark, (1, PATCH, None)))
    got = {(r["symbol"], r["change"], r["before"], r["after"]) for r in diff.signature_changes(lines).collect()}
    assert got == {("verify", "signature", "tok", "tok, strict"), ("fresh", "added", "", "")}
    assert {r["symbol"] for r in diff.touched_symbols(lines).where("hunk = 1").collect()} == {"Auth", "verify"}
    js = diff.patch_lines(patches(spark, (1, "@@ -1,1 +1,0 @@\n-export async function go(a) {", "a.ts")))
    assert [(r["symbol"], r["change"]) for r in diff.signature_changes(js).collect()] == [("go", "removed")]


def test_symbols_from_content(spark):
    lines = diff.patch_lines(patches(spark, (1, "@@ -4,1 +4,1 @@\n-x\n+y", "a.py")))
    content = spark.createDataFrame([("a.py", "def one():\n  1\ndef two():\n  x\ndef three(): 3")], "file string, content string")
    assert [r["symbol"] for r in diff.touched_symbols(lines, content).collect()] == ["two"]


def test_changed_files(spark):
    p = patches(spark, (1, PATCH, None))
    assert [r["file"] for r in diff.changed_files(p).collect()] == ["svc/auth.py"]
    assert {r["file"] for r in diff.changed_files(p, include_tests=True).collect()} == {"svc/auth.py", "tests/test_auth.py"}


@pytest.mark.parametrize("patch, symbols, want", [
    ("@@ -1,1 +1,1 @@\n-def f(a):\n+def f(a, b):", [], "signature"),
    ("@@ -1,1 +1,1 @@ def f(a):\n-  1\n+  2", ["f"], "hard"),
    ("@@ -1,1 +1,1 @@ def f(a):\n-  1\n+  2", ["g"], "soft"),
])
def test_severity(spark, patch, symbols, want):
    prs = patches(spark, (9, patch, "a.py")).withColumn("author", F.lit("bob"))
    text = tools.check_conflicts(["a.py"], symbols, "ann", prs)
    assert text.startswith(f"{want}:")
    assert tools.check_conflicts(["other.py"], symbols, "ann", prs).endswith("safe to proceed\"") or "safe to proceed" in tools.check_conflicts(["other.py"], symbols, "ann", prs)


def guard(spark, patch, callers=(), memories=(), target="a.py", **kw):
    return conflicts.check_patches(
        patches(spark, (1, patch, target)), spark.createDataFrame(list(callers), "file string, symbol string, caller string"),
        spark.createDataFrame([(f"d{i}.py", "hub.py") for i in range(10)], "src string, dst string"),
        spark.createDataFrame(list(memories), "id bigint, category string, content string, scope_type string, scope_value string"), **kw)


SIG = "@@ -1,1 +1,1 @@\n-def f(a):\n+def f(a, b):"


@pytest.mark.parametrize("patch, callers, target, want, code", [
    (SIG, [("a.py", "f", "x.py")], "a.py", "block", "breaking_signature"),
    (SIG, [], "a.py", "warn", "signature_change_no_callers_tracked"),
    ("@@ -1,1 +1,1 @@\n-  1\n+  2", [], "a.py", "ok", None),
    ("", [], "a.py", "block", "empty_patch"),
    (SIG, [], None, "block", "no_target_file"),
    ("@@ -1,1 +1,1 @@\n-  1\n+  2", [], "hub.py", "warn", "high_impact_radius"),
])
def test_guard(spark, patch, callers, target, want, code):
    reasons, verdicts = guard(spark, patch, callers, target=target)
    assert verdicts.first()["verdict"] == want
    assert {r["code"] for r in reasons.collect()} == ({code} if code else set())


def test_verdicts_need_no_totals(spark):
    for target in ("a.py", "hub.py"):
        whole, short = (guard(spark, "@@ -1,1 +1,1 @@\n-  1\n+  2", target=target, totals=t) for t in (True, False))
        assert [tuple(r) for r in whole[1].collect()] == [tuple(r) for r in short[1].collect()]
        assert [r["code"] for r in whole[0].collect()] == [r["code"] for r in short[0].collect()]


def test_guard_last_segment_and_memories(spark):
    assert guard(spark, SIG, [("a.py", "svc.f", "x.py")])[1].first()["verdict"] == "warn"
    assert guard(spark, SIG, [("a.py", "svc.f", "x.py")], last_segment=True)[1].first()["verdict"] == "block"
    patch = "@@ -1,0 +1,1 @@\n+request_handlers_payload global state"
    mem = [(1, "avoid", "request handlers global state", "repo", None), (2, "failed", "request handlers global state", "module", "src/"),
           (3, "pattern", "request handlers global state", "file", "A.py"), (4, "decision", "request handlers global state", "repo", None)]
    codes = {r["code"] for r in guard(spark, patch, memories=mem)[0].collect()}
    assert codes == {"violates_avoid", "violates_pattern"}


def test_guard_contending(spark):
    contending = spark.createDataFrame([("a.py", "f", 5)], "file string, symbol string, pr bigint")
    reasons, verdicts = guard(spark, "@@ -1,1 +1,1 @@ def f(a):\n-  1\n+  2", contending=contending)
    assert verdicts.first()["verdict"] == "block" and reasons.first()["code"] == "contending_signature_pr"


def test_guidance(spark):
    rows = spark.createDataFrame([(1, "soft"), (1, "hard"), (2, "soft"), (3, "signature")], "ticket int, severity string")
    got = {r["ticket"]: r["advice"].split(":")[0] for r in conflicts.guidance(rows).collect()}
    assert got == {1: "CAUTION", 2: "NOTE", 3: "BLOCK"}


# ------------------------------------------------------------------- extraction
def test_extract(spark):
    files = spark.createDataFrame([
        ("a.py", "import os\nfrom ..pkg import x, y\nclass A:\n  def m(self):\n    self.go('text message here')\ndef _p(): run()\n"),
        ("bad.py", "class Broken(:\n  def half(self:\n"),
        ("w.ts", 'import { q } from "./q";\nexport class K {}\nfunction h() { call(); }'),
        ("m.rs", "pub struct S;\nfn inner() {}"), ("g.go", "func Pub() {}\nfunc priv() {}"),
    ], "path string, content string")
    rows = extract.extracted(files)
    syms = {(r["path"], r["name"], r["kind"], r["parent"], r["is_public"]) for r in extract.symbols(rows).collect()}
    assert {("a.py", "A", "class", None, True), ("a.py", "m", "method", "A", True), ("a.py", "_p", "function", None, False),
            ("w.ts", "K", "class", None, True), ("w.ts", "h", "function", None, False), ("m.rs", "S", "struct", None, True),
            ("m.rs", "inner", "function", None, False), ("g.go", "Pub", "function", None, True), ("g.go", "priv", "function", None, False)} == syms
    assert {(r["path"], r["module"]) for r in extract.imports(rows).collect()} >= {("a.py", "os"), ("a.py", "..pkg"), ("w.ts", "./q")}
    defs = {(r["path"], r["symbol"], r["kind"]) for r in extract.definitions(rows, files).collect()}
    assert {("bad.py", "broken", "class"), ("bad.py", "half", "func"), ("a.py", "m", "method")} <= defs
    assert [r["literal"] for r in extract.literals(rows).where("path = 'a.py'").collect()] == ["text message here"]
    assert {r["module"] for r in extract.module_names(rows).where("path = 'a.py'").collect()} == {"os", "..pkg", "..pkg.x", "..pkg.y"}


def test_predictor_prefers_named_path(spark):
    from lodestar.operators import index
    files = spark.createDataFrame([("src/auth/login.py", ["login"], ["token"]), ("src/db.py", ["query"], ["token"]), ("tests/test_login.py", ["login"], ["token"])],
                                  "path string, symbols array<string>, identifiers array<string>")
    idx = index.legacy_index(files, "p")
    issues = spark.createDataFrame([(1, "t", "Login broken in src/auth/login.py token"), (2, "t", "")], "query_id int, title string, text string")
    got = predictor.predict(files.select("path"), idx, issues).orderBy("rank").collect()
    assert got[0]["path"] == "src/auth/login.py" and got[0]["confidence"] == "high" and {r["query_id"] for r in got} == {1}
    edges = spark.createDataFrame([("src/app.py", "src/auth/login.py", "import", 1.0)], "src string, dst string, kind string, weight double")
    more = predictor.predict_with_impact(files.select("path").unionByName(spark.createDataFrame([("src/app.py",)], "path string")), idx, issues, edges).collect()
    hop = {r["path"]: (r["source"], r["hops"]) for r in more}
    assert hop["src/app.py"] == ("graph_expansion", 1)
    seed = next(r["score"] for r in more if r["path"] == "src/auth/login.py")
    assert next(r["score"] for r in more if r["path"] == "src/app.py") == pytest.approx(seed * 0.35, abs=1e-4)


def test_evidence_greedy(spark):
    text = "\n".join(f"line{i} {'alpha beta' if i in (3, 20, 21) else 'x'}" for i in range(40))
    docs = spark.createDataFrame([("d", text)], "doc string, text string")
    best = spark.createDataFrame([(1, "d")], "query_id int, doc string")
    terms = spark.createDataFrame([(1, "alpha"), (1, "beta")], "query_id int, term string")
    scored = evidence.window_scores(best, docs, terms)
    hits = {r["start"]: r["hits"] for r in scored.collect()}
    picked = []
    for _h, s in sorted(((h, s) for s, h in hits.items()), reverse=True):
        if all(abs(s - k) >= 12 for k in picked) and len(picked) < 4:
            picked.append(s)
    assert evidence.pick_windows(scored).first()["starts"] == sorted(picked)
    assert "alpha" in evidence.cards(best, docs, terms).first()["card"]


@pytest.mark.parametrize("raw, status, order", [
    ('x {"ranking":["b"],"confidence":0.9,"reason":"r"} y', "verified", ["b", "a", "c"]),
    ('{"ranking":["b"],"confidence":0.5,"reason":"r"}', "abstained", ["a", "b", "c"]),
    ('{"ranking":["b"],"confidence":true,"reason":"r"}', "error", ["a", "b", "c"]),
    ('{"ranking":["b"],"confidence":0.9}', "error", ["a", "b", "c"]),
    ('{"ranking":["b"],"confidence":0.9,"reason":"r","more":1}', "error", ["a", "b", "c"]),
    ("no json", "error", ["a", "b", "c"]), (None, "skipped", ["a", "b", "c"]),
    ('{"ranking":["zzz","c"],"confidence":0.8,"reason":"r"}', "verified", ["c", "a", "b"]),
])
def test_verdict(spark, raw, status, order):
    answers = spark.createDataFrame([(1, ["a", "b", "c"])], "query_id int, ranking array<string>")
    replies = spark.createDataFrame([(1, raw)], "query_id int, raw string")
    got = verdict.apply_verdicts(answers, replies).first()
    assert (got["status"], got["ranking"]) == (status, order)


# ---------------------------------------------------------------------- sources
def test_scan_and_cache(spark, tmp_path):
    for name, text in (("src/a.py", "x = 1"), ("src/B.PY", "y"), ("node_modules/c.js", "z"), ("src/big.py", "b" * 100), ("src/n.txt", "t"), ("src/k.kt", "k")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    graph_files = FS.scan(spark, str(tmp_path), max_size=50)
    assert {r["path"]: r["content"] for r in graph_files.collect()} == {"src/a.py": "x = 1", "src/B.PY": "y"}
    assert {r["path"] for r in FS.scan(spark, str(tmp_path), "index", 50).collect()} == {"src/a.py", "src/k.kt"}
    cache = graph_files.where("path = 'src/a.py'")
    assert [r["path"] for r in FS.changed_since(graph_files, cache).collect()] == ["src/B.PY"]


def test_snapshots(spark):
    tree = spark.createDataFrame([("c1", "a.py", "s1"), ("c2", "b.py", "s1"), ("c2", "c.txt", "s2")], "commit string, path string, sha string")
    assert {r["sha"] for r in FS.blobs_to_analyse(tree, spark.createDataFrame([("s2",)], "sha string")).collect()} == {"s1"}
    docs = FS.snapshot_docs(tree, spark.createDataFrame([("s1", 7), ("s2", 8)], "sha string, n int"))
    assert {(r["commit"], r["path"], r["n"]) for r in docs.collect()} == {("c1", "a.py", 7), ("c2", "b.py", 7)}


def test_history_queries(spark, tmp_path):
    log = "".join(f"\x01{h}\x02{t}\x02{m}\x03\n\n{files}\n" for h, t, m, files in [
        ("c1", 100, "fix the parser now\nSigned-off-by: x", "pkg/a.py\ntests/test_a.py"), ("c2", 200, "too short", "pkg/a.py"),
        ("c3", 300, "only docs changed here", "README.md"), ("c4", 400, "wide change of files", "\n".join(f"p/{i}.py" for i in range(6))),
        ("c5", 500, "make the renderer faster", "pkg/r.ts")])
    (tmp_path / "log.txt").write_text(log)
    parsed = C.read_log(spark, str(tmp_path / "log.txt"))
    got = C.history_queries(parsed).orderBy("age").collect()
    assert [(r["commit"], r["age"], r["files"]) for r in got] == [("c5", 0, ["pkg/r.ts"]), ("c1", 1, ["pkg/a.py"])]
    assert got[1]["text"] == "fix the parser now"
    assert C.code_changes(parsed).count() == 4 and C.with_age(parsed).where("commit = 'c5'").first()["age"] == 0
    status = spark.createDataFrame([("a", "untracked"), ("a", "modified"), ("b", "staged")], "file string, status string")
    assert [tuple(r) for r in C.changed_file_status(status).collect()] == [("a", "modified"), ("b", "staged")]


def test_records(spark, tmp_path):
    (tmp_path / "b.csv").write_text("Bug_ID;Product;Summary;Fixed_Files\n1;shop;it breaks;src/A.java\n2;shop;;src/B.java\n3;shop;no files;none\n")
    got = R.infer_records(R.read_csv(spark, str(tmp_path / "b.csv")), "d").collect()
    ids = {r["instance_id"]: (r["problem_statement"], r["gold_files"]) for r in got}
    assert ids["d__shop__1"] == ("it breaks", ["src/A.java"]) and "d__shop__3" not in ids
    (tmp_path / "b.json").write_text(json.dumps({"bugs": [{"id": 5, "title": "t", "body": "b", "files": ["x/C.java", "x/C.java"]}]}))
    row = R.infer_records(R.read_json(spark, str(tmp_path / "b.json")), "d").first()
    assert (row["problem_statement"], row["gold_files"], row["project"]) == ("b\nt", ["x/C.java"], "unknown")
    (tmp_path / "b.xml").write_text("<r><bug><id>7</id><summary>oops</summary><files>y/D.java</files></bug></r>")
    assert R.infer_records(R.read_xml(spark, str(tmp_path / "b.xml"), "bug"), "d").first()["gold_files"] == ["y/D.java"]


def test_convert_patches(spark, tmp_path):
    rows = spark.createDataFrame([("i1", "o/r", "c", "s", PATCH), ("i2", None, "c", "s", PATCH), ("i3", "o/r", "c", "s", "")],
                                 "instance_id string, repo string, base_commit string, problem_statement string, patch string")
    kept, counts = R.convert_patches(rows, "d")
    assert [(r["instance_id"], r["gold_files"], r["language"]) for r in kept.collect()] == [("i1", ["svc/auth.py"], "python")]
    assert {r["reason"]: r["n"] for r in counts.collect()} == {"kept": 1, "missing_repo_or_commit": 1, "no_gold_files": 1}
    known = spark.createDataFrame([("i1",)], "instance_id string")
    assert R.exclude_known(kept, known).count() == 0
    sinks.write_dataset(kept, counts, str(tmp_path / "set"))
    assert spark.read.json(str(tmp_path / "set")).count() == 1


def test_reports(spark, tmp_path):
    from lodestar.operators import metrics
    pred = spark.createDataFrame([(1, "a", 1)], "query_id int, doc string, rank int")
    per = metrics.rank_metrics(pred, spark.createDataFrame([(1, "a"), (2, "b")], "query_id int, doc string"))
    sinks.write_report(metrics.summarise(per), per, str(tmp_path / "rep"))
    text = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "rep" / "report.md")).collect())
    assert "Questions: **2**" in text and "| Hit | 0.500" in text


def test_yaml():
    text = tools.to_yaml({"plan": {"k": 1}, "items": [{"a": "x", "b": [1, 2]}, {"a": "l1\nl2"}], "none": []})
    assert text.splitlines()[:4] == ["plan:", "  k: 1", "items:", "- a: x"] and "|-" in text
    assert tools.strip_empty({"a": 0, "b": [], "c": {"d": ""}, "e": 1}) == {"e": 1}


def test_rolling_over_many_batches(spark, tmp_path):
    calls = spark.range(60).select(
        F.col("id").alias("seq"), (F.lit(0) + F.col("id")).cast("timestamp").alias("ts"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("tool"),
        F.col("id").cast("double").alias("duration_ms"), F.lit(1).cast("bigint").alias("output_size"), F.lit(None).cast("string").alias("error"))
    for i in range(3):
        calls.where((F.col("seq") >= i * 20) & (F.col("seq") < i * 20 + 20)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    roll = RollingCalls(spark, str(tmp_path / "state"), size=5)
    got = {r["tool"]: (r["count"], r["n"], r["mean_ms"]) for r in roll.run(stream).collect()}
    assert roll.last == 2
    assert got == {"a": (20, 5, 51.0), "b": (40, 5, 56.2)}
    again = spark.read.parquet(str(tmp_path / "in"))
    roll.update(again.where("seq >= 40"), 2)  # a repeated batch changes nothing
    assert spark.read.parquet(str(tmp_path / "state" / "counts" / "2")).agg(F.sum("count")).first()[0] == 60
    assert drain_batches is not None


def test_catalogue_contract():
    import __spark_entry__ as entry
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100
    present = importlib.util.find_spec("lodestar.llm") is not None and importlib.util.find_spec("corpus_pipeline") is not None
    assert bool([n for n in queries if n.startswith("op")]) == ("pipeline" in queries) == present
