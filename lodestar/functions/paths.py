"""Path predicates and path arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: the four test-path rules differ on purpose. ---
INDEX_TEST_PATH = r"(?i)(^|/)(tests?|__tests__|spec)/|(^|/)test_|_test\.|\.test\.|\.spec\."
LOCALIZER_TEST_PATH = (
    r"(^|/)(tests?|testing|__tests__)/|(^|/)test_[^/]*$|_tests?\.py$|(^|/)conftest\.py$"
    r"|_test\.go$|\.(test|spec)\.[cm]?[jt]sx?$|\.tests?/"
)
PRIOR_TEST_PATH = r"(^|/)(tests?|__tests__|spec)/|(^|/)test_|_test\."
PENALTY_TEST_PATH = r"(^|/)(tests?|__tests__|spec)/|(^|/)test_|_test\.py$"
GENERATED_PATH = (
    r"(^|/)(dist|build|vendor|vendored|third_party|node_modules)/|\.min\.[cm]?js$|\.bundle\.js$"
)
GENERIC_STEMS = """
__init__ base utils util core common compat helpers misc constants types
""".split()
PENALTY_GENERIC_STEMS = """
__init__ base core common compat helpers helper misc utils utility config settings
constants types models
""".split()
NON_PACKAGE_DIRS = """
doc docs example examples benchmarks asv_bench tutorials galleries scripts bin tools
ci extern
""".split()
PYTHON_SUFFIXES = (".py", ".pyi")
SCRIPT_SUFFIXES = (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs")
GRAPH_SUFFIXES = (
    ".py", ".pyi", ".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".go", ".rs", ".java", ".cs",
)
INDEX_SUFFIXES = (
    ".py", ".js", ".ts", ".tsx", ".jsx", ".go", ".rs", ".java", ".kt", ".rb", ".cs", ".cpp",
    ".c", ".h",
)
LANGUAGE_BY_SUFFIX = {
    "py": "python", "pyi": "python", "go": "go", "rs": "rust", "java": "java", "cs": "csharp",
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "ts": "typescript", "tsx": "typescript",
}
# --- End of fixed values. ---


def slashed(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/")


def is_test_index(path: Column) -> Column:
    return path.rlike(INDEX_TEST_PATH)


def is_test_localizer(path: Column) -> Column:
    return F.lower(slashed(path)).rlike(LOCALIZER_TEST_PATH)


def is_test_prior(path: Column) -> Column:
    return F.lower(normal(path)).rlike(PRIOR_TEST_PATH)


def is_test_penalty(path: Column) -> Column:
    return F.lower(normal(path)).rlike(PENALTY_TEST_PATH)


def is_generated(path: Column) -> Column:
    return F.lower(path).rlike(GENERATED_PATH)


def normal(path: Column) -> Column:
    """Forward slashes, no surrounding blanks, dots or slashes."""
    return F.regexp_replace(slashed(F.trim(path)), r"^[./]+|[./]+$", "")


def leaf(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def without_suffix(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def stem(path: Column) -> Column:
    """File name up to its last dot."""
    return without_suffix(leaf(path))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def top_dir(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), 1)


def directory(path: Column) -> Column:
    """Parent folder, or NULL for a top-level file."""
    return F.nullif(F.regexp_extract(path, "^(.*)/[^/]*$", 1), F.lit(""))


def module_of(path: Column) -> Column:
    """Dotted module name; package markers stand for their folder."""
    bare = without_suffix(slashed(path))
    return F.regexp_replace(F.regexp_replace(bare, "/(__init__|index)$", ""), "/", ".")


def depth(path: Column) -> Column:
    return F.length(path) - F.length(F.regexp_replace(path, "/", ""))


def diff_language(path: Column) -> Column:
    """python / javascript / unknown, as the diff rules need it."""
    low = F.lower(path)
    return (
        F.when(low.rlike(r"\.pyi?$"), "python")
        .when(low.rlike(r"\.(js|jsx|ts|tsx|mjs|cjs)$"), "javascript")
        .otherwise("unknown")
    )


def language(path: Column) -> Column:
    lookup = F.create_map(*[F.lit(x) for kv in LANGUAGE_BY_SUFFIX.items() for x in kv])
    return F.coalesce(lookup[suffix(path)], F.lit("other"))


def test_to_source(path: Column) -> Column:
    """Likely source paths of a test path, most specific first."""
    norm = normal(path)
    name = stem(norm)
    ext = F.coalesce(F.nullif(F.regexp_extract(norm, r"(\.[^./]*)$", 1), F.lit("")), F.lit(".py"))
    source = F.regexp_replace(F.regexp_replace(name, "^test_", ""), "_test$", "")
    parts = F.split(norm, "/")
    at = F.array_position(parts, "tests").cast("int")
    prefix = F.array_join(F.slice(parts, 1, F.greatest(at - 1, F.lit(0))), "/")
    beside = F.when(
        (at > 0) & (source != ""),
        F.concat(prefix, F.when(prefix != "", "/").otherwise(""), source, ext),
    )
    bare = F.when((source != "") & (source != name), F.concat(source, ext))
    return F.array_compact(F.array(beside, bare))
