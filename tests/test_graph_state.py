import itertools
import math

import pytest
from pyspark.sql import functions as F

from lodestar.operators import feedback, graph, observability as O, resolve, similarity, store
from lodestar.functions import text as X


def pairs(df):
    return {(r["left"], r["right"]): r["weight"] for r in df.collect()}


def test_cochange(spark):
    commits = [["a", "c"], ["a", "b"], ["a", "b"], ["a", "b", "c"]]  # newest first
    rows = [(i, i, f) for i, files in enumerate(commits) for f in files]
    df = spark.createDataFrame(rows, "commit int, age int, file string")
    got = pairs(graph.cochange(df, half_life=1000.0))
    assert got[("a", "b")] == pytest.approx(2.49688312)
    assert got[("a", "c")] == pytest.approx(1.49896136)
    assert got[("b", "c")] == pytest.approx(0.49896136)


def test_cochange_skips_large_commits(spark):
    rows = [(0, 0, f"f{i}") for i in range(21)] + [(1, 1, "x"), (1, 1, "y")]
    got = pairs(graph.cochange(spark.createDataFrame(rows, "commit int, age int, file string")))
    assert set(got) == {("x", "y")}


EDGES = [("controller", "validator", "import"), ("controller", "service", "import"), ("service", "repository", "call")]


def edge_frame(spark, rows=EDGES):
    return spark.createDataFrame([(s, d, k, 1.0) for s, d, k in rows], "src string, dst string, kind string, weight double")


def test_adjacency(spark):
    df = edge_frame(spark).unionByName(spark.createDataFrame([("a", "b", "cochange", 2.0), ("a", "a", "call", 1.0)], edge_frame(spark).schema))
    got = {(r["src"], r["dst"]): r["weight"] for r in graph.adjacency(df).collect()}
    assert got[("a", "b")] == got[("b", "a")] == pytest.approx(0.8 * math.log(3))
    assert got[("repository", "service")] == 1.5 and ("a", "a") not in got


@pytest.mark.parametrize("rounds, expected", [
    (24, {"controller": .474415, "service": .247735, "validator": .170712, "repository": .107138}),
    (3, {"controller": .381606, "service": .343411, "validator": .231437, "repository": .043546}),
])
def test_pagerank(spark, rounds, expected):
    seeds = spark.createDataFrame([(1, "controller", 1.0), (2, "missing", 1.0), (3, "controller", 0.0)], "query_id int, node string, weight double")
    got = graph.personalised_pagerank(graph.adjacency(edge_frame(spark)), seeds, iterations=rounds).collect()
    first = {r["node"]: round(r["score"], 6) for r in got if r["query_id"] == 1}
    assert first == expected
    assert {r["node"] for r in got if r["query_id"] == 2} == {"missing"}  # an edgeless seed keeps all mass
    assert not [r for r in got if r["query_id"] == 3]


def test_impact_radius(spark):
    seeds = spark.createDataFrame([("repository",), ("unknown",)], "seed string")
    depends = edge_frame(spark).select("src", "dst")
    got = {(r["seed"], r["node"]): r["hop"] for r in graph.impact_radius(depends, seeds, 2, rows_per_salt=1).collect()}
    assert got == {("repository", "service"): 1, ("repository", "controller"): 2}


def test_reaching_is_counted_reach(spark):
    import random
    rng = random.Random(3)
    rows = {(rng.randrange(60), rng.randrange(60)) for _ in range(75)} | {(0, i) for i in range(1, 30)} | {(i, 0) for i in (40, 41)}
    edges = spark.createDataFrame([*rows, (1, 2), (1, 2)], "src int, dst int")
    seeds = spark.createDataFrame([(i,) for i in [*range(70), 5, 5]], "seed int")
    for hops, count in ((1, 3), (2, 6), (3, 10), (3, 1)):
        reached = graph.impact_summary(graph.reach(edges, seeds.distinct(), hops)).where(F.col("total") >= count)
        got = [r["seed"] for r in graph.reaching(edges, seeds, hops, count).collect()]
        assert sorted(got) == sorted(r["seed"] for r in reached.collect()) and got


def test_reaching_walks_few_rows_of_a_seed(spark, monkeypatch):
    """A chain of hubs: every node has 40 edges, but a seed is not walked beyond what it needs."""
    edges = spark.range(40).alias("a").crossJoin(spark.range(40).alias("b")).select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"))
    sizes = []
    stored = graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, name: (lambda out: sizes.append(out.count()) or out)(stored(df, name)))
    assert graph.reaching(edges, spark.range(40).select(F.col("id").alias("seed")), 3, 5).count() == 40
    assert max(sizes) <= 40 * 6


def test_calls_and_imports(spark):
    calls = spark.createDataFrame([("a.py", "svc.login"), ("b.py", "login"), ("a.py", "_hid")], "path string, name string")
    symbols = spark.createDataFrame([("b.py", "login", True), ("c.py", "_hid", False)], "path string, name string, is_public boolean")
    assert {tuple(r) for r in graph.call_edges(calls, symbols).collect()} == {("a.py", "b.py", "svc.login")}
    files = spark.createDataFrame([("src/db/users.py",), ("src/db/__init__.py",), ("src/api.py",), ("web/a.ts",), ("web/lib/index.tsx",), ("web/b.js",)], "path string")
    imports = spark.createDataFrame([
        ("src/api.py", "src.db.users"), ("src/api.py", "src.db"), ("src/api.py", "os"), ("src/db/users.py", "."), ("src/db/users.py", "..api"),
        ("web/a.ts", "./lib"), ("web/a.ts", "../web/b"), ("web/a.ts", "react"),
    ], "path string, module string")
    got = {(r["path"], r["module"]): r["resolved"] for r in resolve.resolve_imports(imports, files).collect()}
    assert got == {
        ("src/api.py", "src.db.users"): "src/db/users.py", ("src/api.py", "src.db"): "src/db/__init__.py", ("src/api.py", "os"): None,
        ("src/db/users.py", "."): "src/db/__init__.py", ("src/db/users.py", "..api"): "src/api.py",
        ("web/a.ts", "./lib"): "web/lib/index.tsx", ("web/a.ts", "../web/b"): "web/b.js", ("web/a.ts", "react"): None,
    }


def test_module_lookup(spark):
    mods = spark.createDataFrame([("pkg.a", "pkg/a.py"), ("pkg.a.b", "pkg/a/b.py")], "module string, target string")
    names = spark.createDataFrame([("pkg.a.b.Cls",), ("pkg.a.x",), ("a.b",), ("zzz",)], "name string")
    got = {r["name"]: r["resolved"] for r in resolve.resolve_suffix_modules(names, mods).collect()}
    assert got == {"pkg.a.b.Cls": "pkg/a/b.py", "pkg.a.x": "pkg/a.py", "a.b": "pkg/a/b.py"}


# ------------------------------------------------------------------ similarity
def brute_sets(rows):
    import re
    return {k: {t for t in re.findall(X.SET_TOKEN, text.lower()) if t not in X.SIMILARITY_STOPWORDS} for k, text, *_ in rows}


def jac(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


@pytest.fixture(scope="module")
def notes():
    import random
    rng = random.Random(5)
    words = [f"w{i:03d}" for i in range(60)]
    rows = []
    for i in range(80):
        base = rng.sample(words, 6) if i % 3 else words[:6]  # a third are (near) copies
        text = " ".join(base + ([rng.choice(words)] if i % 2 else []))
        rows.append((i, text, "x" if i % 5 else "y"))
    return rows


def test_superseded_by_brute_force(spark, notes):
    sets = brute_sets(notes)
    cat = {k: c for k, _t, c in notes}
    want = {}
    for o, n in itertools.combinations(range(80), 2):
        if cat[o] == cat[n] and jac(sets[o], sets[n]) >= 0.35 and o not in want:
            want[o] = n
    df = spark.createDataFrame(notes, "id bigint, text string, cat string")
    got = {r["old_id"]: r["new_id"] for r in similarity.superseded_by(df, "id", F.col("text"), "cat").collect()}
    assert got == want


def test_similar_top_brute_force(spark, notes):
    sets = brute_sets(notes)
    df = spark.createDataFrame(notes, "id bigint, text string, cat string")
    got = {}
    for r in similarity.similar_top(df, "id", F.col("text")).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["other"])
    for i in range(80):
        scored = sorted(((-round(jac(sets[i], sets[j]), 3), -j) for j in range(80) if j != i and jac(sets[i], sets[j]) >= 0.2))
        assert got.get(i, []) == [-j for _s, j in scored[:5]]


def test_best_matches(spark, notes):
    sets = brute_sets(notes)
    df = spark.createDataFrame(notes, "id bigint, text string, cat string")
    a, b = df.where("id < 30"), df.where("id >= 30").withColumnRenamed("id", "mid")
    got = {(r["id"], r["mid"]) for r in similarity.best_matches(a, "id", F.col("text"), b, "mid", F.col("text"), 0.3).collect()}
    assert got == {(i, j) for i in range(30) for j in range(30, 80) if jac(sets[i], sets[j]) >= 0.3}


def test_containing(spark):
    hay = spark.createDataFrame([(1, "say foo bar baz now"), (2, "xfoo bar bazy"), (3, "nothing here at all"), (4, "abc-def!")], "h int, t string")
    needles = spark.createDataFrame([(10, "foo bar baz"), (11, "c-d"), (12, "missing inner words"), (13, "oth")], "n int, t string")
    got = {tuple(r) for r in similarity.containing(needles, "n", F.col("t"), hay, "h", F.col("t")).select("n", "h").collect()}
    assert got == {(10, 1), (10, 2), (11, 4), (13, 3)}


def test_jaccard_and_cosine(spark, one):
    df = spark.createDataFrame([(["jwt", "auth"], ["jwt", "oauth"]), ([], ["a"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(similarity.jaccard(F.col("a"), F.col("b"))).collect()] == [pytest.approx(1 / 3), 0.0]
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert v.select(similarity.cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(1 / math.sqrt(2))


# ------------------------------------------------------------------------ state
@pytest.mark.parametrize("age, freq, files, explicit, score, level", [
    (0, 1, 1, False, 0.42, 2), (0, 10, 5, True, 1.0, 1), (15, 5, 2, False, 0.405, 2), (40, 1, 1, False, 0.07, 3),
])
def test_memory_score(spark, age, freq, files, explicit, score, level):
    df = spark.createDataFrame([(float(age), float(freq), float(files), explicit)], "a double, f double, n double, e boolean")
    s = store.memory_score(F.col("a"), F.col("f"), F.col("n"), F.col("e"))
    assert tuple(df.select(s, store.memory_level(s)).first()) == (score, level)


def fold(start_status, start_score, deltas):
    """The rules applied one event at a time."""
    hit = miss = 0
    status, score = start_status, start_score
    for d in deltas:
        hit, miss = hit + (d > 0), miss + (d < 0)
        if status == "active" and miss - hit >= 3:
            status = "suspect"
        elif status == "suspect" and hit - miss >= 3:
            status, score = "active", min(1.0, score + 0.1)
        elif status == "active" and hit - miss >= 3 and score < 1.0:
            score = min(1.0, score + 0.1)
    return hit, miss, status, round(score, 6)


def test_auto_tune_matches_fold(spark):
    import random
    rng = random.Random(3)
    start = [(i, 0, 0, rng.choice(["active", "suspect"]), rng.choice([0.5, 0.95])) for i in range(12)]
    deltas = {i: [rng.choice([1, 1, -1]) if i % 2 else rng.choice([1, -1, -1]) for _ in range(40)] for i in range(12)}
    events = [(i, n * 12 + i, d) for i in deltas for n, d in enumerate(deltas[i])]
    got = feedback.auto_tune(
        spark.createDataFrame(start, "id bigint, hit_count int, miss_count int, status string, score double"),
        spark.createDataFrame(events, "memory_id bigint, seq bigint, delta int"),
    ).collect()
    for r in got:
        _id, _h, _m, status, score = start[r["id"]]
        assert (r["hit_count"], r["miss_count"], r["status"], r["score"]) == fold(status, score, deltas[r["id"]])


def test_reconcile_and_stats(spark):
    pred = spark.createDataFrame([(1, "p", 7, ["a", "b", "c", "d"], [5]), (2, "p", 8, ["a"], [5]), (3, "p", 9, ["a"], [5])],
                                 "id bigint, project string, ticket_id bigint, predicted_files array<string>, memories_shown array<bigint>")
    out = spark.createDataFrame([(1, "p", 7, "completed", ["a"]), (2, "p", 8, "reverted", ["a"]), (3, "p", 9, "abandoned", []), (4, "p", 10, "completed", ["z"])],
                                "id bigint, project string, ticket_id bigint, outcome string, actual_files array<string>")
    got = {r["ticket_id"]: (r["status"], r["feedback"]) for r in feedback.reconcile(out, pred).collect()}
    assert got == {7: ("reconciled", "miss"), 8: ("reconciled", "miss"), 9: ("skipped", None), 10: ("skipped", None)}
    stats = feedback.feedback_stats(out, pred).first()
    assert (stats["total"], stats["completed"], stats["abandoned"], stats["samples"]) == (4, 2, 1, 2)
    assert feedback.feedback_stats(out.where("id > 99"), pred).collect() == []


def test_claims(spark):
    import datetime as dt
    day = lambda n: dt.datetime(2024, 1, n)
    log = spark.createDataFrame([
        (1, "ann", ["a.py"], "active", day(1), 1), (1, "ann", ["login.py", "b.py"], "active", day(9), 2), (2, "bob", ["c.py"], "active", day(1), 3),
        (3, "cat", ["login.py"], "active", day(9), 4), (3, "cat", ["login.py"], "released", day(10), 5),
    ], "ticket bigint, author string, files array<string>, status string, created_at timestamp, seq bigint")
    state = store.claim_state(log, F.lit(day(10)).cast("timestamp"))
    assert {r["ticket"]: r["status"] for r in state.collect()} == {1: "active", 2: "stale"}
    files = spark.createDataFrame([("login.py",)], "file string")
    assert [(r["ticket"], r["overlap"]) for r in store.claims_for_files(state, files).collect()] == [(1, ["login.py"])]


@pytest.mark.parametrize("message, n, similar, want", [
    ("docs: x", 5, 9, (False, "low")), ("refactor: x", 1, 1, (True, "high")), ("breaking: x", 1, 1, (True, "high")),
    ("feat: x", 3, 1, (True, "medium")), ("feat: x", 1, 1, (False, "low")), ("feat: x", 1, 3, (True, "medium")), ("Feat: x", 3, 1, (False, "low")),
])
def test_promotion(spark, message, n, similar, want):
    df = spark.createDataFrame([(message, n, similar)], "m string, n int, s int")
    p = df.select(store.promotion(F.col("m"), X.classify_commit(F.col("m")), F.col("n"), F.col("s")).alias("p")).first()["p"]
    assert (p["promote"], p["confidence"]) == want


@pytest.mark.parametrize("files, want", [
    (["src/auth/a.py", "src/auth/b.py"], ("module", "src/auth")), (["src/a.py", "lib/b.py"], ("repo", None)),
    ([f"s/{i}.py" for i in range(6)], ("repo", None)), (["a.py", "b.py"], ("repo", None)), ([], ("repo", None)),
])
def test_scope(spark, files, want):
    df = spark.createDataFrame([(files,)], "f array<string>")
    assert tuple(df.select(store.scope_of(F.col("f")).alias("s")).first()["s"]) == want


def test_change_log(spark, tmp_path):
    log = store.ChangeLog(spark, str(tmp_path), "memories", store.MEMORY_SCHEMA, "id")
    assert log.current().count() == 0
    new = spark.createDataFrame([("b", 0.5), ("a", 0.9)], "content string, score double").withColumn("status", F.lit("active")).withColumn("project", F.lit("p"))
    log.insert(new, [F.col("content")])
    log.insert(new.where("content = 'a'").withColumn("content", F.lit("c")), [F.col("content")])
    assert {r["content"]: r["id"] for r in log.current().collect()} == {"a": 1, "b": 2, "c": 3}
    log.append(store.superseded_by_prefix(log.current(), "A", 3))
    now = {r["content"]: (r["status"], r["superseded_by"]) for r in log.current().collect()}
    assert now == {"a": ("superseded", 3), "b": ("active", None), "c": ("active", None)}


def test_calls(spark):
    rows = [(i, "t", float(v), 10 * i, None) for i, v in enumerate([10, 20, 30, 40, 50])] + [(9, "u", 5.0, 3, "E")]
    calls = spark.createDataFrame(rows, "seq bigint, tool string, duration_ms double, output_size bigint, error string").withColumn("ts", F.current_timestamp())
    got = {r["tool"]: r for r in O.summary(calls, [F.desc("seq")]).collect()}
    assert (got["t"]["p50_ms"], got["t"]["max_ms"], got["t"]["avg_size"]) == (30.0, 50.0, 20)
    assert (got["u"]["p99_ms"], got["u"]["error_rate"]) == (5.0, 1.0)
    many = spark.range(600).select(F.col("id").alias("seq"), F.lit("t").alias("tool"), F.col("id").cast("double").alias("duration_ms"),
                                   F.lit(1).alias("output_size"), F.lit(None).cast("string").alias("error"), F.current_timestamp().alias("ts"))
    row = O.summary(many, [F.desc("seq")]).first()
    assert (row["count"], row["avg_ms"]) == (600, 349.5)


def test_recorder(spark, tmp_path):
    rec = O.CallRecorder(spark, str(tmp_path / "calls"))
    fine = rec.observed("fine")(lambda: "abc")
    assert rec.observed("fine")(fine) is fine
    fine()
    bad = rec.observed("bad")(lambda: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        bad()
    rec.flush()
    got = {r["tool"]: (r["output_size"], r["error"]) for r in spark.read.parquet(str(tmp_path / "calls")).collect()}
    assert got == {"fine": (3, None), "bad": (0, "ZeroDivisionError")}


def test_pushed_walk_equals_the_dense_one(spark):
    """Random graphs with a hub, seeds without edges and repeated seeds, against the exact solution."""
    import numpy as np

    rng = np.random.default_rng(4)
    n = 30
    weights = np.triu(rng.random((n, n)) * (rng.random((n, n)) < 0.15), 1)
    weights[0, 1:20] = rng.random(19)  # a hub
    weights[:, n - 1] = weights[n - 1, :] = 0  # no edges
    weights = weights + weights.T
    edges = spark.createDataFrame([(int(a), int(b), float(weights[a, b])) for a, b in zip(*np.nonzero(weights))], "src int, dst int, weight double")
    seeds = [("q", 3, 2.0), ("q", 5, 1.0), ("q", n - 1, 1.0), ("r", 7, 1.0), ("r", 7, 1.0), ("r", 9, -1.0), ("lone", n - 1, 1.0)]
    got = graph.push_ranks(edges, spark.createDataFrame(seeds, "query_id string, node int, weight double"), epsilon=1e-7, rows_per_salt=5)
    found = {(r.query_id, r.node): r.score for r in got.collect()}
    degree = weights.sum(1)
    for name in ("q", "r", "lone"):
        start = np.zeros(n)
        for query, node, weight in seeds:
            start[node] += weight if query == name and weight > 0 else 0
        start /= start.sum()
        move = np.where(degree[:, None] > 0, weights / np.maximum(degree, 1e-300)[:, None], start[None, :])
        exact = np.linalg.solve(np.eye(n) - 0.72 * move.T, 0.28 * start)
        assert all(abs(found.get((name, i), 0.0) - exact[i]) < 1e-5 for i in range(n))
    # a loose threshold touches few nodes, whatever the graph
    few = graph.push_ranks(edges, spark.createDataFrame([("q", 3, 1.0)], "query_id string, node int, weight double"), epsilon=0.5)
    assert few.count() == 1


def test_queries_that_share_rows_walk_alone(spark, monkeypatch):
    monkeypatch.setattr(graph, "QUERIES_PER_ROW", 2)
    edges = graph.symmetric(spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (3, 4, 1.0)], "left long, right long, weight double"))
    rows = [("a", 1, 1.0), ("a", 9, 1.0), ("b", 4, 2.0), ("c", 2, 1.0), ("c", 2, 3.0), ("d", 7, 1.0), ("e", 3, 0.0)]
    seeds = spark.createDataFrame(rows, "query_id string, node long, weight double")
    ranks = lambda s: {(r.query_id, r.node): round(r.score, 9) for r in graph.personalised_pagerank(edges, s, iterations=5).collect()}
    alone = {}
    for q in "abcd":
        alone |= ranks(seeds.where(f"query_id = '{q}'"))
    together = ranks(seeds)
    assert together == alone and together[("d", 7)] == 1.0 and ("a", 9) in together and not any(q == "e" for q, _ in together)


def test_near_walks_share_their_edges(spark, monkeypatch):
    """Walks that keep near their seeds equal a plain walk on each query's own part of the graph, however many share a row."""
    links = [(1, 2, 1.0), (2, 3, 2.0), (3, 4, 1.0), (4, 5, 3.0), (5, 6, 1.0), (2, 6, 0.5), (7, 8, 1.0)]
    both = links + [(b, a, w) for a, b, w in links]
    edges = spark.createDataFrame(both, "src bigint, dst bigint, weight double")
    seeds = {"a": {1: 1.0, 9: 1.0}, "b": {4: 3.0, 7: 1.0}, "c": {9: 2.0}}
    table = spark.createDataFrame([(q, n, w) for q, s in seeds.items() for n, w in s.items()], "query_id string, node bigint, weight double")
    want = {}
    for q, s in seeds.items():
        near = set(s) | {b for a, b, _ in both if a in s}
        start = {n: w / sum(s.values()) for n, w in s.items()}
        inside = [(a, b, w) for a, b, w in both if a in near and b in near]
        out = {a: sum(w for x, _, w in inside if x == a) for a, _, _ in inside}
        score = dict(start)
        for _ in range(5):
            lost = sum(v for n, v in score.items() if n not in out)
            fresh = {n: (1 - graph.DAMPING + graph.DAMPING * lost) * v for n, v in start.items()}
            for a, b, w in inside:
                fresh[b] = fresh.get(b, 0.0) + graph.DAMPING * score.get(a, 0.0) * w / out[a]
            score = fresh
        want.update({(q, n): v / sum(score.values()) for n, v in score.items() if v > 0})
    stored = []
    keep = graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df, label, *a, **k: stored.append((label, df.columns)) or keep(df, label, *a, **k))
    for width in (32, 2):
        monkeypatch.setattr(graph, "QUERIES_PER_ROW", width)
        got = {(r.query_id, r.node): r.score for r in graph.personalised_pagerank(edges, table, iterations=5, max_hops=1).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert not any({"query_id", "src", "dst"} <= set(columns) for _, columns in stored)  # no edge is repeated for a query
