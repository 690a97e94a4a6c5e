"""First-match lookups: imports, dotted names and path suffixes to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P

# --- Fixed values: candidate order of script imports. ---
TYPED_FIRST = (".tsx", ".ts", ".jsx", ".js", ".mjs", ".cjs")
PLAIN_FIRST = (".jsx", ".js", ".mjs", ".cjs", ".tsx", ".ts")
# --- End of fixed values. ---


def first_match(
    requests: DataFrame, candidates: Column, targets: DataFrame, target_key: str, keep: list[str],
    value: str = "target",
) -> DataFrame:
    """Resolve each request to the first candidate that exists in ``targets``.

    ``candidates`` is an ordered array per request; the lookup is one equi-join
    and a minimum over the matching positions. Requests are unique by ``keep``.
    """
    opened = requests.select(*keep, F.posexplode(candidates).alias("_prio", "_cand"))
    hits = opened.join(
        targets.select(F.col(target_key).alias("_cand"), F.col(value).alias("_value")), "_cand"
    )
    return hits.groupBy(*keep).agg(F.min_by("_value", "_prio").alias("resolved"))


def python_candidates(module: Column, importer: Column) -> Column:
    """x.py, then x/__init__.py, for absolute and dot-relative modules."""
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    rest = F.regexp_replace(F.regexp_replace(module, r"^\.+", ""), r"\.", "/")
    folders = F.split(importer, "/")
    up = F.slice(folders, 1, F.greatest(F.size(folders) - dots, F.lit(0)))
    base = F.when(
        dots > 0, F.array_join(F.when(rest != "", F.concat(up, F.array(rest))).otherwise(up), "/")
    ).otherwise(rest)
    return F.when(
        module != "", F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))
    ).otherwise(F.array().cast("array<string>"))


def _without_parents(path: Column) -> Column:
    """Resolve "." and ".." steps of a relative path."""
    return F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, part: F.when(part.isin("", "."), acc)
        .when(part == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(part))),
        lambda acc: F.array_join(acc, "/"),
    )


def script_candidates(module: Column, importer: Column) -> Column:
    """Relative script imports: extensions by priority, then index files."""
    folder = F.coalesce(P.directory(importer), F.lit(""))
    base = _without_parents(F.concat_ws("/", folder, module))
    typed = P.suffix(importer).isin("ts", "tsx")

    def options(order: tuple[str, ...]) -> Column:
        direct = [F.concat(base, F.lit(e)) for e in order]
        index = [F.concat(base, F.lit(f"/index{e}")) for e in order]
        return F.array(*direct, *index)

    return F.when(
        module.startswith("."), F.when(typed, options(TYPED_FIRST)).otherwise(options(PLAIN_FIRST))
    ).otherwise(F.array().cast("array<string>"))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, module, resolved); unresolved (external) modules keep NULL.

    ``imports`` is (path, module), ``files`` is (path). Languages other than
    Python and the script family are always external.
    """
    asked = imports.select("path", "module").distinct()
    lang = P.language(F.col("path"))
    candidates = (
        F.when(lang == "python", python_candidates(F.col("module"), F.col("path")))
        .when(lang.isin("javascript", "typescript"), script_candidates(F.col("module"), F.col("path")))
        .otherwise(F.array().cast("array<string>"))
    )
    targets = files.select(F.col("path").alias("_key"), F.col("path").alias("target"))
    found = first_match(asked, candidates, targets, "_key", ["path", "module"])
    return asked.join(found, ["path", "module"], "left")


def dotted_prefixes(name: Column) -> Column:
    """All dotted prefixes of a name, longest first."""
    parts = F.split(name, r"\.")
    return F.transform(
        F.sequence(F.size(parts), F.lit(1), F.lit(-1)),
        lambda n: F.array_join(F.slice(parts, 1, n), "."),
    )


def path_suffixes(path: Column) -> Column:
    """All suffixes of a path, longest first."""
    parts = F.split(P.slashed(path), "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"),
    )


def resolve_modules(names: DataFrame, modules: DataFrame) -> DataFrame:
    """(name, resolved): longest dotted prefix that is a module.

    ``names`` is (name) distinct, ``modules`` is (module, target).
    """
    return first_match(names, dotted_prefixes(F.col("name")), modules, "module", ["name"])


def resolve_suffix_modules(names: DataFrame, modules: DataFrame) -> DataFrame:
    """As above, with a second chance for a missing leading package.

    A name that has no prefix match resolves to the first module (in name
    order) that ends with ``.name``; every dotted suffix of every module is a
    join key, so this stays an equi-join.
    """
    direct = resolve_modules(names, modules)
    rest = names.join(direct, "name", "left_anti")
    parts = F.split("module", r"\.")
    tails = modules.select(
        "module", "target",
        F.explode(
            F.transform(
                F.when(F.size(parts) > 1, F.sequence(F.lit(2), F.size(parts))).otherwise(
                    F.array().cast("array<int>")
                ),
                lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "."),
            )
        ).alias("name"),
    )
    second = tails.join(rest, "name").groupBy("name").agg(F.min_by("target", "module").alias("resolved"))
    return direct.unionByName(second)


def resolve_path_suffixes(mentions: DataFrame, files: DataFrame) -> DataFrame:
    """(mention, resolved): longest suffix of a mentioned path that is a file."""
    targets = files.select(F.col("path").alias("_key"), F.col("path").alias("target"))
    return first_match(mentions, path_suffixes(F.col("mention")), targets, "_key", ["mention"])


def absolute_modules(module: Column, path: Column) -> Column:
    """The dotted module that an import means in the file at ``path``.

    Leading dots count up from the package of the file (an ``__init__`` is its
    own package), ``./`` and ``../`` from its folder; other names stand as they are.
    """
    parts = F.split(P.module_of(path), r"\.")
    package = F.when(path.endswith("__init__.py"), parts).otherwise(F.slice(parts, F.lit(1), F.size(parts) - 1))
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    above = F.slice(package, F.lit(1), F.greatest(F.size(package) - F.greatest(dots, F.lit(1)) + 1, F.lit(0)))
    rest = F.filter(F.split(F.regexp_replace(module, r"^\.+", ""), r"\."), lambda m: m != "")
    folder = F.coalesce(P.directory(path), F.lit(""))
    return (
        F.when(module.startswith("./") | module.startswith("../"), P.module_of(_without_parents(F.concat_ws("/", folder, module))))
        .when(dots > 0, F.array_join(F.concat(above, rest), "."))
        .otherwise(module)
    )


def import_graph(imports: DataFrame, files: DataFrame, tolerant: bool = False) -> DataFrame:
    """(src, dst), distinct: which file imports which, among files(path).

    ``imports`` is (path, module), with an entry for each imported name too. A
    module is the file of its longest dotted prefix; ``tolerant`` also finds one
    whose leading package is missing. Two files of one module count as the later
    path; a file does not import itself. Each name is resolved once however many
    files import it, and all lookups are equi-joins.
    """
    asked = imports.select("path", absolute_modules(F.col("module"), F.col("path")).alias("name")).where("name <> ''").distinct()
    modules = files.groupBy(P.module_of(F.col("path")).alias("module")).agg(F.max("path").alias("target"))
    names = asked.select("name").distinct()
    found = resolve_suffix_modules(names, modules) if tolerant else resolve_modules(names, modules)
    return asked.join(found, "name").where(F.col("path") != F.col("resolved")).select(F.col("path").alias("src"), F.col("resolved").alias("dst")).distinct()
