from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestar.functions import paths as P
from lodestar.functions import text as X
from lodestar.operators import signals as S


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def tokens(spark, make, text):
    df = spark.createDataFrame([(1, text)], "id int, t string")
    return Counter(r["term"] for r in make(df, F.col("t"), "id").collect())


@pytest.mark.parametrize("text, expected", [
    ("AuthService", {"auth": 1, "service": 1}),
    ("HTTPRequest", {"http": 1, "request": 1}),
    ("verify_jwt_token", {"verify": 1, "jwt": 1, "token": 1}),
    ("jwt jwt jwt token", {"jwt": 3, "token": 1}),
    ("the and for with", {}),
    ("", {}),
    (None, {}),
])
def test_code_tokens(spark, text, expected):
    assert tokens(spark, X.code_token_rows, text) == Counter(expected)


def test_code_terms_whole_and_parts(spark):
    assert tokens(spark, X.code_term_rows, "parseConfig x1 _a is") == Counter({"parseconfig": 1, "parse": 1, "config": 1, "x1": 1})
    assert tokens(spark, X.code_term_rows, "HTTP2Server __init__") == Counter({"http2server": 1, "http2": 1, "server": 1, "init": 1})


def test_set_tokens(spark):
    df = spark.createDataFrame([("JWT RS256",), (None,), ("the with",)], "t string")
    got = [set(r[0]) for r in df.select(X.token_set(F.col("t"))).collect()]
    assert got == [{"jwt", "rs256"}, set(), set()]


@pytest.mark.parametrize("text, expected", [
    ("ticket #42: done", 42), ("Ticket #7 closed", 7), ("Fixed in PR #123", 123), ("closes issue #99", 99),
    ("decision: use JWT", None), ("", None),
])
def test_ticket_id(one, text, expected):
    assert one(lambda: X.ticket_id(F.col("t")), t=text) == expected


@pytest.mark.parametrize("text, expected", [
    ("Revert change", "avoid"), ("refactor: x", "decision"), ("fix: y", "failed"), ("feat: z", "pattern"),
    ("docs: w", "noise"), ("breaking: api", "decision"), ("migrate to x", "decision"),
])
def test_classify(one, text, expected):
    assert one(lambda: X.classify_commit(F.col("t")), t=text) == expected


def test_literal_fragment(one):
    lit = lambda v: one(lambda: X.literal_fragment(F.col("t")), t=v)
    assert lit("Unknown %s value in configuration") == "value in configuration"
    assert lit("short one") is None
    assert lit("nospaceatallinthis") is None


def test_title(one):
    assert one(lambda: X.title_of(F.col("t")), t="\n\n  Head line \nbody") == "Head line"


@pytest.mark.parametrize("path, expected", [
    ("tests/test_a.py", True), ("src/a.py", False), ("pkg/__tests__/a.js", True), ("a/spec/b.rb", True),
    ("src/a.test.ts", True), ("src/a_test.go", True), ("src/contest.py", False), ("Test_x.py", True),
])
def test_index_test_path(one, path, expected):
    assert one(lambda: P.is_test_index(F.col("p")), p=path) is expected


@pytest.mark.parametrize("path, expected", [
    ("tests/test_parser.py", True), ("pkg/parser.py", False), ("pkg/conftest.py", True), ("a/b_test.go", True),
    ("src/x.spec.tsx", True), ("Lib.Tests/x.cs", True), ("src/testing/a.py", True), ("latest/a.py", False),
])
def test_localizer_test_path(one, path, expected):
    assert one(lambda: P.is_test_localizer(F.col("p")), p=path) is expected


@pytest.mark.parametrize("path, expected", [
    ("dist/app.js", True), ("src/app.min.js", True), ("vendor/x.py", True), ("src/builder/x.py", False),
    ("a/third_party/b.py", True), ("src/app.bundle.js", True), ("src/app.js", False),
])
def test_generated_path(one, path, expected):
    assert one(lambda: P.is_generated(F.col("p")), p=path) is expected


def test_path_arithmetic(one):
    col = F.col("p")
    assert one(lambda: P.module_of(col), p="pkg/sub/__init__.py") == "pkg.sub"
    assert one(lambda: P.module_of(col), p="web/index.ts") == "web"
    assert one(lambda: P.stem(col), p="a/b.c.py") == "b.c"
    assert one(lambda: P.directory(col), p="a.py") is None
    assert one(lambda: P.test_to_source(col), p="pkg/tests/test_x.py") == ["pkg/x.py", "x.py"]
    assert one(lambda: P.test_to_source(col), p="src/x.py") == []


def test_frames_and_imports(one):
    text = 'File "/site-packages/pkg/parser.py", line 5, in parse_config\nsrc/a.js:10:2 oops\nfrom a.b import c, d\nimport os, sys'
    got = one(lambda: S.frames(F.col("t")), t=text)
    assert [(f["path"], f["func"]) for f in got] == [("/site-packages/pkg/parser.py", "parse_config"), ("src/a.js", "")]
    assert one(lambda: S.snippet_imports(F.col("t")), t=text) == ["a.b", "a.b.c", "a.b.d", "os", "sys"]


def test_weighted_terms(spark):
    df = spark.createDataFrame([(1, "ValueError in pkg/loader.py for my_func models")], "query_id int, text string")
    got = {r["term"]: r["weight"] for r in S.weighted_terms(df).collect()}
    assert got["loader"] == pytest.approx(1 + 5 + 4 * 0)  # word and path
    assert got["my_func"] == pytest.approx(3.0)
    assert got["func"] == pytest.approx(1 + 2)
    assert got["valueerror"] == pytest.approx(3 + 2 + 2)
    assert got["models"] == pytest.approx(0.35)


def test_compact(one):
    assert one(lambda: X.compact(F.col("t"), 40, "#"), t="a" * 30) == "a" * 30
    got = one(lambda: X.compact(F.col("t"), 10, "#"), t="abcdefghijklmnop")
    assert got == "abcdef#nop"
