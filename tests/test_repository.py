"""The localizer on a repository of sources: import graph, all channels, answers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestar.operators import resolve
from lodestar.plans import localize as L
from lodestar.plans.repository import repository_of

FILES = {
    "shop/__init__.py": "from .orders import place_order\n",
    "shop/orders.py": (
        "from .errors import OrderError\nfrom shop.stock.store import Store\n\n\nclass OrderBook:\n    def check_amount(self, amount):\n"
        '        raise OrderError("amount of the order must be positive")\n\n\ndef place_order(amount):\n    return OrderBook().check_amount(amount)\n'
    ),
    "shop/errors.py": "class OrderError(Exception):\n    pass\n",
    "shop/stock/__init__.py": "",
    "shop/stock/store.py": "from ..errors import OrderError\nfrom . import shelf\nimport json\n\n\nclass Store:\n    pass\n",
    "shop/stock/shelf.py": "import shop.stock.shelf\n\n\ndef shelf_size():\n    return 3\n",
    "shop/render.py": "def render_page(template):\n    return template\n",
    "tests/test_orders.py": "from shop.orders import place_order\n\n\ndef test_place():\n    place_order(1)\n",
    "web/cart.ts": 'import { total } from "./lib/total";\nimport { page } from "../web/page";\nexport function cart() { return total(); }\n',
    "web/lib/total.ts": "export function total() { return 1; }\n",
    "web/page.ts": "export function page() {}\n",
}
REPORT = (
    'place_order fails for small orders\nTraceback (most recent call last):\n  File "/srv/shop/render.py", line 2, in render_page\n'
    '  File "/srv/shop/orders.py", line 7, in check_amount\nOrderError: amount of the order must be positive\n'
    "OrderBook.check_amount raises it. See shop.orders and shop/errors.py.\n"
)


@pytest.fixture(scope="module")
def repo(spark):
    return repository_of(spark.createDataFrame(list(FILES.items()), "path string, content string"))


def test_import_graph_resolves_relative_and_absolute_names(repo):
    assert {tuple(r) for r in repo.imports.select("src", "dst").collect()} == {
        ("shop/__init__.py", "shop/orders.py"), ("shop/orders.py", "shop/errors.py"), ("shop/orders.py", "shop/stock/store.py"),
        ("shop/stock/store.py", "shop/errors.py"), ("shop/stock/store.py", "shop/stock/shelf.py"), ("shop/stock/store.py", "shop/stock/__init__.py"),
        ("tests/test_orders.py", "shop/orders.py"), ("web/cart.ts", "web/lib/total.ts"), ("web/cart.ts", "web/page.ts"),
    }


@pytest.mark.parametrize("module, path, expected", [
    ("json", "a/b.py", "json"), (".c", "a/b.py", "a.c"), (".", "a/b.py", "a"), ("..c.d", "a/x/b.py", "a.c.d"), (".c", "a/__init__.py", "a.c"),
    ("..c", "a/x/__init__.py", "a.c"), ("....c", "a/b.py", "c"), ("./c", "web/a.ts", "web.c"), ("../lib/c", "web/x/a.ts", "web.lib.c"), ("./c/index", "a.ts", "c"),
])
def test_absolute_modules(one, module, path, expected):
    assert one(lambda: resolve.absolute_modules(F.col("m"), F.col("p")), m=module, p=path) == expected


def test_missing_leading_packages_and_shared_modules(spark):
    files = spark.createDataFrame([("src/pkg/a.py",), ("src/pkg/b.py",), ("src/pkg/b.ts",)], "path string")
    asked = spark.createDataFrame([("src/pkg/a.py", "pkg.b"), ("src/pkg/b.py", "src.pkg.a"), ("src/pkg/a.py", "pkg.a")], "path string, module string")
    edges = lambda tolerant: {tuple(r) for r in resolve.import_graph(asked, files, tolerant).collect()}
    assert edges(False) == {("src/pkg/b.py", "src/pkg/a.py")}
    assert edges(True) == {("src/pkg/b.py", "src/pkg/a.py"), ("src/pkg/a.py", "src/pkg/b.ts")}


def test_all_channels_reach_the_answer(spark, repo):
    issues = spark.createDataFrame([(1, "place_order fails for small orders", REPORT)], "query_id int, title string, text string")
    rows = {r.path: r for r in L.features(repo, issues).collect()}
    top = rows["shop/orders.py"]
    for channel in ("bm25", "traceback", "defs", "qualified", "literal"):
        assert top[f"{channel}_rr"] == 1.0, channel
    assert top.module_n > 0 and rows["shop/errors.py"].literal_path_n > 0
    assert rows["shop/stock/store.py"].neighbor_n > 0  # imported by the best match
    assert "tests/test_orders.py" not in rows
    answers = L.localize(repo, issues, 3, tiers=[{"label": "high", "min_margin": 0.0, "read_first": 2, "expected_hit": 0.9}]).orderBy("rank").collect()
    assert answers[0].path == "shop/orders.py" and "in traceback" in answers[0].why and answers[0].read_first == 2


def test_history_of_the_commits_counts(spark):
    commits = spark.createDataFrame([(0, "fix crash of orders", ["shop/orders.py"]), (1, "add pages", ["shop/orders.py", "shop/render.py"])], "age int, subject string, files array<string>")
    repo = repository_of(spark.createDataFrame(list(FILES.items()), "path string, content string"), commits)
    found = {r.doc: (r.touches, r.recent, r.fixes) for r in repo.history.collect()}
    assert found == {"shop/orders.py": (2, 2, 1), "shop/render.py": (1, 1, 0)}
    issues = spark.createDataFrame([(1, "orders crash", "orders crash in place_order")], "query_id int, title string, text string")
    top = {r.path: r for r in L.features(repo, issues).collect()}["shop/orders.py"]
    assert top.hist_touch == pytest.approx(1.0986, abs=1e-3) and top.hist_fix == pytest.approx(0.6931, abs=1e-3)
