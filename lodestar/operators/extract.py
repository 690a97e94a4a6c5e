"""Symbols, imports and calls of source files.

Python files are read with the standard parser in Arrow batches, one file per
row; the other languages need only patterns and stay in column expressions.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X

# --- Fixed values: definition, import and string patterns. ---
SCRIPT_SYMBOLS = (
    r"function\s+([a-zA-Z_$][\w$]*)",
    r"class\s+([a-zA-Z_$][\w$]*)",
    r"const\s+([a-zA-Z_$][\w$]*)\s*=",
    r"let\s+([a-zA-Z_$][\w$]*)\s*=",
    r"export\s+(?:default\s+)?(?:function|class|const)\s+([a-zA-Z_$][\w$]*)",
    r"import\s+.*?from\s+['\"]([^'\"]+)['\"]",
)
GENERIC_DEFINITION = r"\b(class|interface|struct|enum|trait|type|function|func|fn)\s+([A-Za-z_$][\w$]*)"
CLASS_WORDS = ("class", "interface", "struct", "enum", "trait", "type")
QUOTED_STRING = r"([\"'`])(.{12,300}?)\1"
BROKEN_DEFINITION = r"(?m)^\s*(class|def|async\s+def)\s+(\w+)"
SCRIPT_IMPORT = r"(?:from|import)\s+['\"]([^'\"]+)['\"]"
GENERIC_IMPORT = r"(?m)^\s*(?:import|use|using)\s+[\"(]*([A-Za-z_][\w.:/]*)"
GENERIC_CALL = r"([A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*)\s*\("
EXPORTED = r"(?m)^\s*export\s+(?:default\s+)?(?:async\s+)?(?:function|class|const|let|interface|type)\s+([A-Za-z_$][\w$]*)"
RUST_PUBLIC = r"pub(?:\([^)]*\))?\s+(?:struct|enum|trait|type|fn)\s+([A-Za-z_]\w*)"
TYPED_PUBLIC = r"public\s+(?:[\w<>\[\]]+\s+)*?(?:class|interface|struct|enum)\s+([A-Za-z_]\w*)"
KEYWORD_CALLS = ("if", "for", "while", "switch", "catch", "return", "function", "fn", "func")
# --- End of fixed values. ---

SCHEMA = (
    "path string, symbols array<struct<name:string,kind:string,line_start:int,line_end:int,parent:string,is_public:boolean>>, "
    "imports array<struct<module:string,names:array<string>>>, calls array<struct<name:string,line:int>>, "
    "strings array<string>, parsed boolean"
)


class _Reader(ast.NodeVisitor):
    """Collects definitions with their enclosing class, imports, calls and strings."""

    def __init__(self):
        self.symbols, self.imports, self.calls, self.strings, self.classes = [], [], [], [], []

    def _define(self, node, kind: str) -> None:
        parent = self.classes[-1] if self.classes else None
        self.symbols.append((node.name, kind, node.lineno, node.end_lineno, parent, not node.name.startswith("_")))

    def visit_ClassDef(self, node):
        self._define(node, "class")
        self.classes.append(node.name)
        self.generic_visit(node)
        self.classes.pop()

    def visit_FunctionDef(self, node):
        self._define(node, "method" if self.classes else "function")
        self.generic_visit(node)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Import(self, node):
        self.imports.extend((a.name, []) for a in node.names)

    def visit_ImportFrom(self, node):
        self.imports.append(("." * node.level + (node.module or ""), [a.name for a in node.names]))

    def visit_Call(self, node):
        if isinstance(node.func, (ast.Name, ast.Attribute)):
            self.calls.append((ast.unparse(node.func), node.lineno))
        self.generic_visit(node)

    def visit_Constant(self, node):
        if isinstance(node.value, str):
            self.strings.append(node.value)


def _read_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import sys
    import warnings

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 5000))
    for batch in batches:
        rows = []
        for path, content in zip(batch["path"], batch["content"]):
            reader, parsed = _Reader(), True
            try:
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    reader.visit(ast.parse(content or ""))
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                reader, parsed = _Reader(), False
            symbols = [
                dict(zip(("name", "kind", "line_start", "line_end", "parent", "is_public"), s)) for s in reader.symbols
            ]
            imports = [{"module": m, "names": n} for m, n in reader.imports]
            calls = [{"name": n, "line": l} for n, l in reader.calls]
            rows.append((path, symbols, imports, calls, reader.strings, parsed))
        yield pd.DataFrame(rows, columns=["path", "symbols", "imports", "calls", "strings", "parsed"])


def extracted(files: DataFrame) -> DataFrame:
    """One row per file(path, content): symbols, imports, calls, strings."""
    is_python = P.suffix(F.col("path")).isin("py", "pyi")
    python = files.where(is_python).select("path", "content").mapInPandas(_read_batches, SCHEMA)
    return python.unionByName(_patterns(files.where(~is_python)))


def _patterns(files: DataFrame) -> DataFrame:
    """Pattern-based extraction; lines are not tracked per match here."""
    text, lang = F.col("content"), P.language(F.col("path"))
    kinds, names = X.matches(text, GENERIC_DEFINITION, 1), X.matches(text, GENERIC_DEFINITION, 2)
    exported = (
        F.when(lang.isin("javascript", "typescript"), X.matches(text, EXPORTED, 1))
        .when(lang == "rust", X.matches(text, RUST_PUBLIC, 1))
        .when(lang.isin("java", "csharp"), X.matches(text, TYPED_PUBLIC, 1))
        .otherwise(F.filter(names, lambda n: n.rlike("^[A-Z]")))
    )
    no_line, no_parent = F.lit(None).cast("int"), F.lit(None).cast("string")
    symbols = F.transform(
        F.arrays_zip(kinds.alias("k"), names.alias("n")),
        lambda s: F.struct(
            s["n"].alias("name"),
            F.when(s["k"].isin(*CLASS_WORDS), s["k"]).otherwise("function").alias("kind"),
            no_line.alias("line_start"), no_line.alias("line_end"), no_parent.alias("parent"),
            F.array_contains(exported, s["n"]).alias("is_public"),
        ),
    )
    modules = F.when(lang.isin("javascript", "typescript"), X.matches(text, SCRIPT_IMPORT, 1)).otherwise(
        X.matches(text, GENERIC_IMPORT, 1)
    )
    imports = F.transform(
        modules, lambda m: F.struct(m.alias("module"), F.array().cast("array<string>").alias("names"))
    )
    called = F.filter(
        X.matches(text, GENERIC_CALL, 1), lambda c: ~c.isin(*KEYWORD_CALLS) & ~F.array_contains(names, c)
    )
    calls = F.transform(called, lambda c: F.struct(c.alias("name"), no_line.alias("line")))
    return files.select(
        "path", symbols.alias("symbols"), imports.alias("imports"), calls.alias("calls"),
        X.matches(text, QUOTED_STRING, 2).alias("strings"), F.lit(True).alias("parsed"),
    )


def symbols(rows: DataFrame) -> DataFrame:
    return rows.select("path", F.explode("symbols").alias("s")).select("path", "s.*")


def imports(rows: DataFrame) -> DataFrame:
    return rows.select("path", F.explode("imports").alias("i")).select("path", "i.*").where("module != ''")


def calls(rows: DataFrame) -> DataFrame:
    return rows.select("path", F.explode("calls").alias("c")).select("path", "c.*")


def definitions(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(path, symbol, kind): lower-case names, class before method and function.

    A Python file that does not parse is read by line patterns instead.
    """
    kind = (
        F.when(F.col("kind").isin(*CLASS_WORDS), "class").when(F.col("kind") == "method", "method").otherwise("func")
    )
    found = symbols(rows).select("path", F.lower("name").alias("symbol"), kind.alias("kind"))
    broken = files.join(rows.where("not parsed").select("path"), "path", "left_semi")
    pairs = F.arrays_zip(
        X.matches(F.col("content"), BROKEN_DEFINITION, 1).alias("k"), X.matches(F.col("content"), BROKEN_DEFINITION, 2).alias("n")
    )
    rough = broken.select("path", F.explode(pairs).alias("p")).select(
        "path", F.lower("p.n").alias("symbol"), F.when(F.col("p.k") == "class", "class").otherwise("func").alias("kind")
    )
    rank = F.when(F.col("kind") == "class", 0).when(F.col("kind") == "method", 1).otherwise(2)
    return found.unionByName(rough).groupBy("path", "symbol").agg(F.min_by("kind", rank).alias("kind"))


def qualified(rows: DataFrame) -> DataFrame:
    return symbols(rows).where("parent is not null").select(
        "path", F.lower(F.concat("parent", F.lit("."), "name")).alias("qualified")
    ).distinct()


def literals(rows: DataFrame) -> DataFrame:
    """(path, literal): all message-like strings."""
    kept = F.array_distinct(
        F.array_compact(F.transform("strings", lambda s: X.literal_fragment(s)))
    )
    return rows.select("path", F.explode(kept).alias("literal"))


def module_names(rows: DataFrame) -> DataFrame:
    """(path, module): imported modules, and module.name for imported names."""
    listed = imports(rows)
    joined = F.when(F.col("module").endswith("."), F.concat("module", "name")).otherwise(F.concat("module", F.lit("."), "name"))
    named = listed.select("path", "module", F.explode("names").alias("name")).select("path", joined.alias("module"))
    return listed.select("path", "module").unionByName(named).distinct()


def script_symbols(text: Column) -> Column:
    """Lower-case names of a script by pattern, distinct."""
    found = F.flatten(F.array(*[X.matches(text, p, 1) for p in SCRIPT_SYMBOLS]))
    return F.array_distinct(F.transform(found, lambda s: F.lower(s)))


def index_symbols(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(path, symbols, identifiers) for the symbol index, by language."""
    lower = lambda c: F.transform(c, lambda x: F.lower(x))
    head = lambda m: F.element_at(F.split(m, r"\."), 1)
    python = F.array_distinct(
        lower(
            F.concat(
                F.transform("symbols", lambda s: s["name"]),
                F.filter(F.transform("imports", lambda i: head(i["module"])), lambda m: m != ""),
                F.flatten(F.transform("imports", lambda i: i["names"])),
            )
        )
    )
    by_path = rows.select("path", python.alias("_py"))
    suffix = P.suffix(F.col("path"))
    symbols_of = F.when(suffix == "py", F.col("_py")).when(
        suffix.isin("js", "jsx", "ts", "tsx"), script_symbols(F.col("content"))
    ).otherwise(F.array().cast("array<string>"))
    return files.join(by_path, "path", "left").select(
        "path", F.coalesce(symbols_of, F.array().cast("array<string>")).alias("symbols"),
        X.index_identifiers(F.col("content")).alias("identifiers"),
    )
