import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.operators import bm25, channels as C, fusion, index, metrics, ml
from lodestar.operators.skew import next_candidate, ranked, running_sum, salted_join
from lodestar.plans import localize as L
from lodestar.session import materialise


@pytest.fixture(scope="module")
def legacy(spark):
    files = spark.createDataFrame(
        [("a.py", ["login", "logout"], ["user"]), ("b.py", ["login"], ["user", "token"])],
        "path string, symbols array<string>, identifiers array<string>",
    )
    return index.legacy_index(files, "t")


def test_legacy_stats(legacy):
    assert (legacy.n, legacy.avgdl) == (2, 6.0)
    df = {r["term"]: r["df"] for r in legacy.terms.collect()}
    assert df["login"] == 2 and df["logout"] == 1
    assert {r["doc"]: r["dl"] for r in legacy.documents.collect()} == {"a.py": 7, "b.py": 5}


def test_bm25_kernel(spark, legacy):
    q = spark.createDataFrame([(1, "login", 1.0)], "query_id int, term string, weight double")
    got = {r["doc"]: round(r["score"], 6) for r in bm25.scores(legacy, q).collect()}
    assert got == {"a.py": 0.291714, "b.py": 0.317081}


def test_empty_corpus(spark):
    idx = index.legacy_index(spark.createDataFrame([], "path string, symbols array<string>, identifiers array<string>"), "e")
    assert (idx.n, idx.avgdl) == (0, 0.0)


@pytest.mark.parametrize("df, expected", [(1, 4.209655), (50, 0.693147)])
def test_idf(one, df, expected):
    assert one(lambda: index.idf(F.col("df"), 100), df=df) == pytest.approx(expected, abs=1e-6)


@pytest.mark.parametrize("tf, dl, expected", [(1, 10, 1.0), (100, 10, 2.463054), (3, 5, 1.904762), (3, 50, 0.833333)])
def test_tf_part(one, tf, dl, expected):
    assert one(lambda: bm25.tf_part(F.col("tf"), F.col("dl"), 10.0, 1.5), tf=tf, dl=dl) == pytest.approx(expected, abs=1e-6)


def test_search_order_and_empty(spark):
    files = spark.createDataFrame([
        ("auth_service.py", ["login", "logout", "verify_token"], "import jwt\ndef verify_token(token): return jwt.decode(token)"),
        ("login_handler.py", ["handle"], "from auth_service import login"),
        ("database_operations.py", ["query_users", "insert_row"], "def query_users(): pass"),
    ], "path string, symbols array<string>, content string")
    idx = index.boosted_index(files, "b")
    q = spark.createDataFrame([(1, "jwt decode token"), (2, ""), (3, "the and for with")], "query_id int, text string")
    got = bm25.search(idx, q).orderBy("query_id", "rank").collect()
    assert got[0]["doc"] == "auth_service.py" and {r["query_id"] for r in got} == {1}


def test_salted_equals_plain(spark, legacy):
    rows = spark.range(2000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))).alias("k"), F.col("id").alias("v"))
    other = rows.select("k").distinct().withColumn("w", F.col("k") * 2)
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    plain = rows.join(other, "k").agg(F.count(F.lit(1)), F.sum("v"), F.sum("w")).first()
    salted = salted_join(rows, other, "k", "v", counts, 2000, rows_per_salt=100).agg(F.count(F.lit(1)), F.sum("v"), F.sum("w")).first()
    assert tuple(plain) == tuple(salted)


def test_ranked_equals_window(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"), "id")
    order = [F.desc("v"), F.asc("id")]
    plain = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    a = {(r["g"], r["id"]): r["rn"] for r in plain.collect()}
    b = {(r["g"], r["id"]): r["rn"] for r in ranked(df, ["g"], order, "rn").collect()}
    assert a == b
    c = {r["id"]: r["rn"] for r in ranked(df, [], order, "rn").collect()}
    assert sorted(c.values()) == list(range(1, 3001))


def test_split_lookahead_and_sums(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("g"), "id", F.when(F.col("id") % 7 == 0, F.col("id")).alias("c"),
                                 F.when(F.col("id") % 3 == 0, -1).otherwise(1).alias("d"))
    rows = {r["id"]: r["nx"] for r in next_candidate(df, ["g"], "id", "c", "nx").collect()}
    for i in range(500):
        later = [j for j in range(i + 1, 500) if j % 2 == i % 2 and j % 7 == 0]
        assert rows[i] == (later[0] if later else None)
    sums = {r["id"]: r["s"] for r in running_sum(df, ["g"], "id", "d", "s").collect()}
    for i in range(500):
        assert sums[i] == sum(-1 if j % 3 == 0 else 1 for j in range(i + 1) if j % 2 == i % 2)


def test_normalise(spark):
    values = spark.range(400).select((F.col("id") % 4).alias("query_id"), F.col("id").alias("doc"), F.lit("c").alias("channel"),
                                     F.pmod(F.xxhash64("id"), F.lit(30)).cast("double").alias("value"))
    rows = values.where("value > 0").collect()
    got = {(r["query_id"], r["doc"]): (r["n"], r["rank"]) for r in C.normalise(values).collect()}
    assert len(got) == len(rows)
    for q in range(4):
        mine = sorted((r for r in rows if r["query_id"] == q), key=lambda r: (-r["value"], r["doc"]))
        for rank, r in enumerate(mine, 1):
            assert got[q, r["doc"]] == (r["value"] / mine[0]["value"], rank)


def test_tree_score(spark):
    model = {"features": ["a", "b"], "trees": [[0, 0.5, 1.0, [1, 2.0, 10, 20]], -0.25]}
    df = spark.createDataFrame([(0.1, None), (0.9, 1.0), (0.9, 3.0)], "a double, b double")
    assert [r[0] for r in df.select(fusion.tree_score(model)).collect()] == [0.75, 9.75, 19.75]
    assert [r[0] for r in df.select(fusion.tree_score_udf(model)("a", "b")).collect()] == [0.75, 9.75, 19.75]


def test_reading_plan(spark):
    tiers = [{"label": "high", "min_margin": 2.0, "read_first": 1, "expected_hit": 0.9}, {"label": "low", "min_margin": 0.0, "read_first": 10, "expected_hit": 0.8}]
    rows = spark.createDataFrame([(1, "a", 5.0), (1, "b", 2.5), (1, "c", 1.0), (2, "a", 5.0), (2, "b", 4.5), (2, "c", 1.0), (3, "a", 1.0)],
                                 "query_id int, doc string, score double")
    plan = {r["query_id"]: r for r in fusion.reading_plan(fusion.margins(rows), tiers).collect()}
    assert plan[1]["confidence"] == "high" and plan[1]["read_first"] == 1
    assert (plan[2]["confidence"], plan[2]["read_first"], plan[2]["margin"]) == ("low", 3, 0.5)
    assert plan[3]["confidence"] == "high" and plan[3]["margin"] is None


def brute_tiers(results, target, cap=10):
    ordered = sorted(results, key=lambda q: (-q[1], q[0]))
    bounds = [0, round(len(ordered) * 0.3), round(len(ordered) * 0.7), len(ordered)]
    out = {}
    for label, lo, hi in zip(("high", "medium", "low"), bounds, bounds[1:]):
        group = ordered[lo:hi]
        if group:
            rate = lambda k: sum(r is not None and r <= k for _q, _m, r in group) / len(group)
            k = next((k for k in range(1, cap + 1) if rate(k) >= target), cap)
            out[label] = (k, round(rate(k), 3), round(rate(1), 3), len(group))
    return out


def test_tiers(spark):
    results = [(i, float(20 - i), r) for i, r in enumerate([1, 1, 1, 1, 2, 2, 1, None, 1, None])]
    df = spark.createDataFrame(results, "query_id int, margin double, gold_rank int")
    got = {r["label"]: (r["read_first"], r["expected_hit"], r["hit_at_1"], r["n"]) for r in fusion.tier_table(df, 0.75).collect()}
    assert got == brute_tiers(results, 0.75)
    assert got["high"] == (1, 1.0, 1.0, 3) and got["medium"][0] == 2 and got["low"][0] == 10


def test_pooled_tier(spark):
    df = spark.createDataFrame([(1, 3.0, 1), (2, 1.0, 2), (3, 0.5, None)], "query_id int, margin double, gold_rank int")
    row = fusion.tier_table(df, 0.6, shares=(), labels=("low",)).first()
    assert (row["label"], row["min_margin"], row["read_first"], row["n"]) == ("low", 0.0, 2, 3)


def test_holdout(spark):
    rows = [(i, 1.0, None if i < 10 else 1) for i in range(30)]  # 0 is the newest
    df = spark.createDataFrame(rows, "query_id int, margin double, gold_rank int")
    got = fusion.holdout_check(df, [F.asc("query_id")]).first()
    assert (got["n"], got["claimed"], got["observed"], got["avg_files"]) == (10, 1.0, 0.0, 1.0)


def test_rank_metrics(spark):
    pred = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id int, doc string, rank int")
    gold = spark.createDataFrame([(1, "b"), (1, "d"), (2, "x")], "query_id int, doc string")
    got = {r["query_id"]: r for r in metrics.rank_metrics(pred, gold, (1, 2, 3)).collect()}
    assert (got[1]["hit_1"], got[1]["hit_2"], got[1]["recall_2"], got[1]["ap_3"]) == (0, 1, 0.5, 0.25)
    assert (got[2]["hit_3"], got[2]["n_predicted"]) == (0, 0)


@pytest.mark.parametrize("p, a, expected", [
    (["a", "b", "c"], ["a", "b", "d"], (0.667, 0.667)), ([], [], (1.0, 1.0)), (["a"], [], (0.0, 0.0)), ([], ["a"], (0.0, 0.0)),
])
def test_precision_recall(spark, p, a, expected):
    df = spark.createDataFrame([(p, a)], "p array<string>, a array<string>")
    m = metrics.precision_recall(F.col("p"), F.col("a"))
    assert tuple(df.select(m["precision"], m["recall"]).first()) == expected


def test_history(spark):
    commits = spark.createDataFrame([(0, "fix: parser", ["pkg/parser.py"]), (1, "add", ["pkg/parser.py", "pkg/render.py"])],
                                    "age int, subject string, files array<string>")
    got = {r["path"]: (r["touches"], r["recent"], r["fixes"]) for r in C.history_counts(commits).collect()}
    assert got == {"pkg/parser.py": (2, 2, 1), "pkg/render.py": (1, 1, 0)}


def test_localize_end_to_end(spark):
    from lodestar.operators import extract

    files = spark.createDataFrame([
        ("pkg/__init__.py", ""),
        ("pkg/parser.py", 'from pkg.errors import ConfigError\ndef parse_config(text):\n    raise ConfigError("configuration text must not be empty")\n'),
        ("pkg/errors.py", "class ConfigError(Exception):\n    pass\n"),
        ("pkg/render.py", "def render(tree):\n    return str(tree)\n"),
        ("tests/test_parser.py", "from pkg.parser import parse_config\ndef test_parse_config():\n    parse_config('')\n"),
    ], "path string, content string")
    rows = extract.extracted(files)
    docs = files.select(F.col("path").alias("doc"), "path", F.col("content").alias("text"), F.lit(3).alias("n_lines"))
    as_doc = lambda df: df.withColumnRenamed("path", "doc")
    repo = L.Repository(
        docs, index.code_term_index(docs, "doc", "text", "e2e"), as_doc(extract.definitions(rows, files)),
        as_doc(extract.qualified(rows)), as_doc(extract.literals(rows)),
    )
    issue = ("parse_config fails\nTraceback\n File \"/site-packages/pkg/parser.py\", line 5, in parse_config\n"
             "configuration text must not be empty")
    issues = spark.createDataFrame([(1, "parse_config fails", issue)], "query_id int, title string, text string")
    feats = {r["doc"]: r for r in L.features(repo, issues).collect()}
    top = feats["pkg/parser.py"]
    assert top["traceback_rr"] == top["defs_rr"] == top["literal_rr"] == 1.0
    assert "tests/test_parser.py" not in feats
    best = L.localize(repo, issues).where("rank = 1").first()
    assert best["path"] == "pkg/parser.py" and "in traceback" in best["why"]


def test_learning(spark):
    rows = [(q, d, d == 0, 0.2 + 0.7 * (d == 0), (d * 7 % 5) / 5) for q in range(20) for d in range(6)]
    df = spark.createDataFrame(rows, "query_id int, doc int, is_gold boolean, f1 double, f2 double")
    weights = ml.fit_pairwise(df, ["f1", "f2"])
    assert weights["f1"] > abs(weights["f2"])
    model = ml.fit_boosted(df, ["f1", "f2"], trees=3, depth=2)
    exported = ml.export_trees(model, ["f1", "f2"])
    scored = df.withColumn("s", fusion.tree_score(exported))
    assert scored.where("is_gold").agg(F.min("s")).first()[0] > scored.where("not is_gold").agg(F.max("s")).first()[0]
    assert math.isfinite(scored.agg(F.sum("s")).first()[0])


def test_get_or_build(spark):
    calls = []

    def build():
        calls.append(1)
        docs = spark.createDataFrame([(1, "alpha beta alpha")], "doc bigint, text string")
        return index.code_token_index(docs, "doc", "text", "gob")

    first = index.get_or_build(spark, "gob-test", build)
    again = index.get_or_build(spark, "gob-test", build)
    assert len(calls) == 1 and (again.n, again.avgdl) == (first.n, first.avgdl) == (1, 3.0)
    index.get_or_build(spark, "gob-test", build, max_age=0)
    assert len(calls) == 2
    assert first.postings.count() == 2  # the older version is still readable
    table = index.get_or_build_table(spark, "gob-table", lambda: spark.range(5))
    assert table.count() == 5


def test_late_names_are_indexed(spark):
    idents = [f"name{i:04d}" for i in range(500)] + ["zzlast"]
    files = spark.createDataFrame([("a.py", [f"sym{i:03d}" for i in range(150)] + ["zsym"], idents)], "path string, symbols array<string>, identifiers array<string>")
    terms = {r["term"] for r in index.legacy_postings(files).collect()}
    assert {"zzlast", "zsym"} <= terms and len(terms) == 652
    assert index.legacy_postings(files, max_symbols=100, max_identifiers=300).count() == 400


def test_reach_keeps_the_pool(spark):
    rows = spark.range(4000).select(
        F.lit(1).alias("query_id"), F.element_at(F.array(F.lit("bm25"), F.lit("api"), F.lit("defs")), (F.col("id") % 3 + 1).cast("int")).alias("channel"),
        F.pmod(F.xxhash64("id"), F.lit(700)).alias("doc"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(90)).cast("double").alias("value"),
    ).dropDuplicates(["channel", "doc"])
    ranks = C.normalise(rows).where("doc % 5 <> 0")
    plain = C.pool(C.widen(ranks), 40).select("doc", "best_rr", "pool_rank").collect()
    pruned = C.within_reach(ranks, 40)
    assert pruned.count() < ranks.count()
    assert sorted(C.pool(C.widen(pruned), 40).select("doc", "best_rr", "pool_rank").collect()) == sorted(plain)


def test_leading_rows_alone_give_the_pool(spark):
    """Only the first rows of a channel are ranked, ineligible ones ahead included, and the pool is that of all ranks."""
    rows = spark.range(4000).select(
        F.lit(1).alias("query_id"), F.element_at(F.array(F.lit("bm25"), F.lit("api"), F.lit("defs")), (F.col("id") % 3 + 1).cast("int")).alias("channel"),
        F.pmod(F.xxhash64("id"), F.lit(700)).alias("doc"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(90)).cast("double").alias("value"),
    ).dropDuplicates(["channel", "doc"]).unionByName(spark.createDataFrame([(2, "api", 5, 1.0), (2, "api", 6, 2.0)], "query_id int, channel string, doc bigint, value double"))
    eligible = rows.select("doc").distinct().where("doc % 5 <> 0")
    first = C.leading(rows, eligible, 40)
    ranks = C.normalise(rows)
    same = first.join(ranks.select("query_id", "channel", "doc", F.col("rank").alias("all")), ["query_id", "channel", "doc"])
    assert first.count() == same.where("rank = all").count() < ranks.count() / 2
    pool = lambda r: sorted(map(tuple, C.pool(r.join(eligible, "doc", "left_semi").groupBy("query_id", "doc").agg(F.max("rr").alias("best_rr")), 40).collect()))
    assert pool(first) == pool(ranks)
    assert C.within_reach(ranks, 40, eligible).count() == C.within_reach(ranks.join(eligible, "doc", "left_semi"), 40).count()


def test_relative_values_need_no_ranks(spark):
    rows = spark.createDataFrame([(1, "bm25", 1, 4.0), (1, "bm25", 2, 1.0), (1, "bm25", 3, -1.0), (2, "bm25", 1, 0.5)], "query_id int, channel string, doc int, value double")
    key = lambda df: sorted(map(tuple, df.select("query_id", "channel", "doc", "n").collect()))
    assert key(C.relative(rows)) == key(C.normalise(rows)) == [(1, "bm25", 1, 1.0), (1, "bm25", 2, 0.25), (2, "bm25", 1, 1.0)]


def test_ranks_in_reach_are_those_among_all_rows(spark):
    """Ties, channels of many ineligible documents and questions in several blocks; nothing but the first rows is sorted."""
    rows = spark.range(9000).select(
        (F.col("id") % 5).alias("query_id"), F.element_at(F.array(F.lit("bm25"), F.lit("api"), F.lit("defs")), (F.col("id") % 3 + 1).cast("int")).alias("channel"),
        F.concat(F.lit("d"), F.pmod(F.xxhash64("id"), F.lit(700))).alias("doc"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(90)) / 7).alias("value"),
    ).dropDuplicates(["query_id", "channel", "doc"])
    rows = materialise(rows.unionByName(spark.createDataFrame([(9, "api", "x", 1.0), (9, "api", "d1", 2.0), (8, "api", "x", 3.0)], "query_id int, channel string, doc string, value double")), "reach-test")
    stored = materialise(C.rounded_values(rows), "reach-test")
    key = lambda df: sorted(map(tuple, df.select("query_id", "channel", "doc", "value", "n", "rr", "rank").collect()))
    for most in ("d2", "d10", "d6", "y"):  # few to all documents may be answers
        eligible = rows.select("doc").distinct().where(F.col("doc") < most)
        assert key(C.in_reach(stored, eligible, 20, at_once=3)) == key(C.within_reach(C.normalise(rows), 20, eligible)), most
    assert C.in_reach(stored.limit(0), eligible).count() == 0
