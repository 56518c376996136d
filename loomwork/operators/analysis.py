"""Code analytics over chunk attributes: set differences, containment, theta joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Syntax nodes that define something callable or usable (fixed values).
DEFINING = [
    "function_declaration", "method_declaration", "method_definition", "function_definition", "function_item", "class_declaration",
    "class_definition", "type_declaration", "struct_item", "export_statement", "lexical_declaration",
]
#: Kinds of comments that mark work to do, as (keyword, pattern).
ISSUES = {k: rf"(?i){k}[:\s]+(.*)" for k in ("TODO", "FIXME", "HACK", "DEPRECATED")}


def is_test(path: Column) -> Column:
    """Go test files and what lies below a folder ``test`` or ``tests`` that is not the first one."""
    return path.endswith("_test.go") | F.contains(path, F.lit("/test/")) | F.contains(path, F.lit("/tests/"))


#: Parts of paths whose definitions are entry points (fixed values).
ENTRY_PATHS = ["/api", "/routes", "/cmd", "main.go", "index.ts"]


def definitions(chunks: DataFrame, excluded: list[str] | None = None, library: bool = False, below: str = "") -> DataFrame:
    """project_id, rel_path, symbol of what non-test chunks define; entry points and test functions left out.

    ``excluded``: parts of paths that are left out.  A ``library`` exports what
    is not internal, so only its internal and private files count, and no path
    is excluded.  ``below``: only paths that begin so.
    """
    path = F.col("rel_path")
    rows = chunks.where(F.col("type").isin(DEFINING) & ~is_test(path) & path.startswith(below))
    if library:
        rows = rows.where(F.contains(path, F.lit("internal/")) | F.contains(path, F.lit("private/")) | path.rlike(r"(^|/)_[^/]*$"))
    for part in [] if library else excluded or []:
        rows = rows.where(~F.contains(path, F.lit(part)))
    named = rows.select("project_id", "rel_path", F.explode("symbols").alias("symbol")).where(F.length("symbol") > 0)
    return named.where(~F.col("symbol").rlike("^(main|NewServer|Test.*|Benchmark.*|Example.*)$")).distinct()


def usages(chunks: DataFrame, tests: bool) -> DataFrame:
    """project_id, name of everything the chunks call or relate to; of tests also every word."""
    rows = chunks.where(is_test(F.col("rel_path")) if tests else ~is_test(F.col("rel_path")))
    names = F.concat(F.coalesce("calls", F.array().cast("array<string>")), F.coalesce("relationships", F.array().cast("array<string>")))
    if tests:
        names = F.concat(names, F.coalesce(F.split("content", r"[^\w.$]+"), F.array().cast("array<string>")))
    return rows.select("project_id", F.explode(names).alias("name")).where(F.length("name") > 0).distinct()


def _unused(defined: DataFrame, used: DataFrame) -> DataFrame:
    """Definitions whose name, or the part after its first dot, is not used in the same project."""
    short = F.when(F.contains("symbol", F.lit(".")), F.regexp_extract("symbol", r"^[^.]*\.(.*)$", 1)).otherwise(F.col("symbol"))
    d = defined.where(F.col("project_id").isNotNull()).withColumn("_short", short)
    u = used.where(F.col("project_id").isNotNull())
    left = d.join(u.select("project_id", F.col("name").alias("symbol")), ["project_id", "symbol"], "left_anti")
    return left.join(u.select("project_id", F.col("name").alias("_short")), ["project_id", "_short"], "left_anti").drop("_short")


def dead_symbols(chunks: DataFrame, excluded: list[str] | None = None, library: bool = False, below: str = "") -> DataFrame:
    """Defined outside tests and used nowhere outside them."""
    return _unused(definitions(chunks, excluded, library, below), usages(chunks.where(F.col("rel_path").startswith(below)) if below else chunks, tests=False))


def missing_tests(chunks: DataFrame) -> DataFrame:
    """Defined outside tests, not private, and not mentioned by any test."""
    public = definitions(chunks).where(~F.col("symbol").startswith("_"))
    return _unused(public, usages(chunks, tests=True))


def package_of(name: Column) -> Column:
    """First segment of a module path, two if it is scoped."""
    return F.when(name.startswith("@"), F.regexp_extract(name, r"^(@[^/]+/[^/]+)", 1)).otherwise(F.regexp_extract(name, r"^([^/]+)", 1))


def source_package(path: Column) -> Column:
    """First folder of a path, two under apps/ or packages/."""
    parts = F.split(path, "/")
    return F.when(parts[0].isin("apps", "packages") & (F.size(parts) > 2), F.concat_ws("/", parts[0], parts[1])).otherwise(parts[0])


def missing_dependencies(imports: DataFrame, manifest: DataFrame) -> DataFrame:
    """Imported packages that the project's manifest lacks, with the files that import them.

    ``imports``: project_id, rel_path, module.  ``manifest``: project_id, package.
    Relative and absolute modules do not count.
    """
    named = imports.where(~F.col("module").rlike(r"^[./\\]")).withColumn("package", package_of(F.col("module")))
    lost = named.join(manifest, ["project_id", "package"], "left_anti")
    return lost.groupBy("project_id", "package").agg(F.countDistinct("rel_path").alias("n_files"), F.min("rel_path").alias("first_file"))


def edges(relations: DataFrame, prefix: str = "") -> DataFrame:
    """Distinct (source package, related module) pairs, related names under the prefix."""
    rows = relations.where(F.col("module").startswith(prefix)) if prefix else relations
    return rows.select("project_id", source_package(F.col("rel_path")).alias("source"), F.col("module").alias("target")).distinct()


def implementations(required: DataFrame, offered: DataFrame) -> DataFrame:
    """Relational division: (project_id, interface, type) where the type offers every method the interface requires.

    ``required``: project_id, interface, method.  ``offered``: project_id, type,
    method.  Interfaces without methods match nothing.  An interface meets only
    the types of its project that offer its rarest method, which are verified
    on the other methods, so that common method names pair nothing.
    """
    r, o = required.distinct(), offered.distinct()
    rare = o.groupBy("project_id", "method").agg(F.count("*").alias("_f"))
    need = (
        r.join(rare, ["project_id", "method"], "left").groupBy("project_id", "interface")
        .agg(F.count("*").alias("_need"), F.min_by("method", F.struct(F.coalesce("_f", F.lit(0)), "method")).alias("method"))
    )
    met = need.join(o, ["project_id", "method"]).select("project_id", "interface", "type", "_need")
    have = met.join(r, ["project_id", "interface"]).join(o, ["project_id", "type", "method"], "left_semi")
    counted = have.groupBy("project_id", "interface", "type", "_need").agg(F.count("*").alias("_have"))
    return counted.where("_have = _need").select("project_id", "interface", "type", F.col("_need").alias("n_methods"))


def field_usage(chunks: DataFrame, field: str) -> DataFrame:
    """Chunks whose structure has the field."""
    return chunks.where(F.map_contains_key("structural_metadata", f"field:{field}"))


def pattern_issues(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """One row per line and keyword: the keyword, severity and the text behind it."""
    found = F.array(
        *[
            F.when(F.col(line_col).rlike(p), F.struct(F.lit(k).alias("keyword"), F.concat(F.lit(f"[{k}]: "), F.regexp_extract(line_col, p, 1)).alias("message")))
            for k, p in ISSUES.items()
        ]
    )
    return lines.withColumn("_f", F.explode(F.filter(found, lambda x: x.isNotNull()))).select(*lines.columns, "_f.keyword", "_f.message")


def split_lines(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """Lines with their number from 1."""
    return df.select(*keep, F.posexplode(F.split(text_col, "\n")).alias("_p", "line")).withColumn("line_no", F.col("_p") + 1).drop("_p")


def grep(df: DataFrame, text_col: str, keep: list[str], match: Column, whole: Column | None = None) -> DataFrame:
    """Matching lines, trimmed; ``whole`` is a test of the whole text that spares the split where nothing can match."""
    rows = df if whole is None else df.where(whole)
    lines = split_lines(rows, text_col, keep)
    return lines.where(match).select(*keep, "line_no", F.trim("line").alias("line"))


def first_matches(found: DataFrame, order: list[str], limit: int = 100) -> DataFrame:
    """The first matches in order, and whether there were more: limit_reached."""
    some = found.orderBy(*order).limit(limit + 1)
    n = F.row_number().over(W.orderBy(*order))  # of at most limit + 1 rows
    counted = some.withColumn("_n", n).withColumn("limit_reached", F.max("_n").over(W.partitionBy()) > limit)
    return counted.where(F.col("_n") <= limit).drop("_n")


def risk(n: Column) -> Column:
    return F.when(n > 10, "High").when(n > 3, "Medium").otherwise("Low")


def distill(chunks: DataFrame) -> DataFrame:
    """Per project and folder: how many chunks of each visibility, the first exported names, the dependencies."""
    folder = F.regexp_replace("rel_path", r"/?[^/]*$", "")
    name = F.try_element_at("symbols", F.lit(1))
    rows = chunks.where(F.length(name) > 0).select(
        "project_id", folder.alias("package"), name.alias("name"), "type", F.coalesce("relationships", F.array().cast("array<string>")).alias("rels")
    )
    exported = F.col("name").rlike("^[A-Z]") | F.col("type").rlike("class|interface")
    base = rows.groupBy("project_id", "package").agg(
        F.count_if(exported).alias("n_exported"), F.count_if(~exported).alias("n_internal"), F.countDistinct("type").alias("n_types")
    )
    firsts = top_names(rows.where(exported), 6)
    deps = rows.select("project_id", "package", F.explode("rels").alias("dep")).groupBy("project_id", "package").agg(F.countDistinct("dep").alias("n_deps"))
    keys = ["project_id", "package"]
    return base.join(firsts, keys, "left").join(deps, keys, "left").select(*keys, "n_exported", "n_internal", "n_types", F.coalesce("n_deps", F.lit(0)).alias("n_deps"), F.coalesce("names", F.lit("")).alias("names"))


def top_names(rows: DataFrame, n: int) -> DataFrame:
    """The first n distinct names of each package, joined; a ranking that keeps n rows a group map-side."""
    w = W.partitionBy("project_id", "package").orderBy("name")
    few = rows.select("project_id", "package", "name").distinct().withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    return few.groupBy("project_id", "package").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"))


def _prefix_join(rows: DataFrame, text: str, names: DataFrame, name: str) -> DataFrame:
    """Rows with the names that their text begins with.

    The lengths that names have, a few numbers, cut the prefixes that are
    joined by equality; rows and names are never paired one by one.
    """
    lengths = names.agg(F.collect_set(F.length(name)).alias("_ls"))
    cuts = rows.crossJoin(F.broadcast(lengths)).withColumn("_l", F.explode("_ls")).where(F.col("_l").between(1, F.length(text)))
    return cuts.withColumn(name, F.substring(F.col(text), F.lit(1), F.col("_l"))).drop("_l", "_ls").join(names, name)


def resolve_aliases(modules: DataFrame, aliases: DataFrame) -> DataFrame:
    """Module paths with their alias replaced: the longest matching prefix, then the first in order."""
    m = modules.select("module").where("module IS NOT NULL").distinct()
    best = _prefix_join(m, "module", aliases.select("alias", "target").distinct(), "alias").groupBy("module").agg(F.max_by(F.struct("alias", "target"), F.struct(F.length("alias"), "alias")).alias("b"))
    done = best.select("module", F.concat(F.col("b.target"), F.substring(F.col("module"), F.length("b.alias") + 1, F.lit(1 << 30))).alias("resolved"))
    return m.join(done, "module", "left").select("module", F.coalesce("resolved", "module").alias("resolved"))


def forbidden(rules: DataFrame, deps: DataFrame) -> DataFrame:
    """Rules that forbid a dependency of their project: they hold ``no`` or ``forbidden:`` and then its name, in any case.

    ``rules``: project_id, rule and others.  ``deps``: project_id, dep.  What
    follows the marks is cut to the lengths names have and joined.
    """
    marks = F.regexp_extract_all(F.lower("rule"), F.lit(r"(?=(?:no |forbidden: )([^\n]{1,200}))"), F.lit(1))
    behind = rules.withColumn("_behind", F.explode(F.array_distinct(marks)))
    names = deps.where(F.length("dep").between(1, 200)).select(F.col("project_id").alias("_p"), F.lower("dep").alias("dep")).distinct()
    return _prefix_join(behind, "_behind", names, "dep").where("_p = project_id").drop("_p", "_behind").distinct()


def impact_radius(chunks: DataFrame, symbol: str) -> DataFrame:
    """Chunks that call or relate to a symbol, with the chunk that defines it in their project, if any: name, chunk_id, rel_path, definition."""
    names = F.concat(F.coalesce("calls", F.array().cast("array<string>")), F.coalesce("relationships", F.array().cast("array<string>")))
    users = chunks.where(F.array_contains(names, symbol)).select("project_id", "chunk_id", "rel_path")
    defs = chunks.where(F.array_contains("symbols", symbol)).groupBy("project_id").agg(F.min("chunk_id").alias("definition"))
    return users.join(defs, "project_id", "left").select(F.lit(symbol).alias("name"), "chunk_id", "rel_path", "definition").distinct()


def dependents(rows: DataFrame, changed: DataFrame) -> DataFrame:
    """Packages that call or relate to a name defined in another package that changed: project_id, package, n_changed, n_names.

    Names join within their project; the defining packages of a name, and the
    using ones, are distinct before they meet.
    """
    names = F.concat(F.coalesce("calls", F.array().cast("array<string>")), F.coalesce("relationships", F.array().cast("array<string>")))
    used = rows.select("project_id", "package", F.explode(names).alias("name")).distinct()
    defined = changed.select("project_id", F.col("package").alias("changed"), F.explode("symbols").alias("name")).distinct()
    met = used.join(defined, ["project_id", "name"]).where("package <> changed")
    return met.groupBy("project_id", "package").agg(F.countDistinct("changed").alias("n_changed"), F.countDistinct("name").alias("n_names"))
