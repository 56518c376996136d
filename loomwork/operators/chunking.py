"""Cutting texts into windows, and what is read off a chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import newline_count

#: Windows: size and overlap in code points (fixed values).
WINDOW, WINDOW_OVERLAP, SPLIT, SPLIT_OVERLAP = 3000, 500, 8000, 800
#: Imports, each pattern with what is imported in group 1 (fixed values).
IMPORTS = {
    "js module": r"(?:import|from|require)\s*\(?\s*['\"]([^'\"]+)['\"]",
    "js names": r"import\s*\{([^}]+)\}",
    "go single": r"import\s+(?:[a-zA-Z0-9_.]+\s+)?[\"']([^\"']+)[\"']",
    "go block": r"import\s+\(([\s\S]*?)\)",
    "go inner": r"(?:[a-zA-Z0-9_.]+\s+)?[\"']([^\"']+)[\"']",
    "php file": r"(?:require|require_once|include|include_once)\s*\(?\s*['\"]([^'\"]+)['\"]",
    "php names": r"use\s+([^;]+);",
}


def windows(df: DataFrame, id_col: str, text_col: str, size: int = WINDOW, overlap: int = WINDOW_OVERLAP, first_line: Column | None = None) -> DataFrame:
    """Overlapping windows of every text: id, chunk_no, char_start, content, start_line, end_line.

    The windows start ``size - overlap`` apart and stop with the one that
    reaches the end; null and empty texts have none.
    """
    step = size - overlap
    n = F.length(text_col)
    count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / F.lit(step)) + 1).cast("int")
    rows = df.where(n > 0).select(id_col, F.col(text_col).alias("_t"), (first_line if first_line is not None else F.lit(1)).alias("_l"), F.sequence(F.lit(0), count - 1).alias("_k"))
    cuts = rows.select(id_col, "_t", "_l", F.explode("_k").alias("chunk_no"))
    cuts = cuts.withColumn("char_start", F.col("chunk_no") * step).withColumn("content", F.expr(f"substring(_t, chunk_no * {step} + 1, {size})"))
    before = newline_count(F.expr("substring(_t, 1, char_start)"))
    cuts = cuts.withColumn("start_line", (F.col("_l") + before).cast("int"))
    return cuts.withColumn("end_line", (F.col("start_line") + newline_count(F.col("content"))).cast("int")).drop("_t", "_l")


def function_score(start_line: Column, end_line: Column, calls: Column) -> Column:
    """1; less 0.3 under three lines, plus 0.2 over ten, plus 0.1 a call."""
    lines = end_line - start_line + 1
    n = F.greatest(F.coalesce(F.size(calls), F.lit(0)), F.lit(0))
    return F.round(1.0 - F.when(lines < 3, 0.3).otherwise(0.0) + F.when(lines > 10, 0.2).otherwise(0.0) + 0.1 * n, 4)


def contextual_string(path: Column, entity: Column, parent: Column, kind: Column, docstring: Column, calls: Column, structure: Column, content: Column) -> Column:
    """What is embedded of a chunk: its attributes in a fixed order, then the code; map entries sorted."""
    text = lambda c, other: F.when(F.length(F.coalesce(c, F.lit(""))) > 0, c).otherwise(F.lit(other))
    called = F.when(F.size(calls) > 0, F.array_join(calls, ", ")).otherwise(F.lit("None"))
    entries = F.array_sort(F.transform(F.map_entries(structure), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))))
    shape = F.when(F.size(entries) > 0, F.concat(F.lit(" [Structure: "), F.array_join(entries, " "), F.lit(" ]"))).otherwise(F.lit(""))
    parts = F.when(F.length(F.coalesce(parent, F.lit(""))) > 0, F.concat(F.lit("Parent: "), parent, F.lit(". "))).otherwise(F.lit(""))
    return F.concat(
        F.lit("File: "), F.coalesce(path, F.lit("")), F.lit(". Entity: "), text(entity, "Global"), F.lit(". "), parts,
        F.lit("Type: "), F.coalesce(kind, F.lit("")), F.lit(". Docstring: "), text(docstring, "None"), F.lit(". Calls: "), called, F.lit("."),
        shape, F.lit(" Code:\n"), F.coalesce(content, F.lit("")),
    )


def language_of(path: Column) -> Column:
    ending = F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1)
    return F.when(ending.isin(".ts", ".tsx", ".js", ".jsx"), "js").when(ending == ".go", "go").when(ending == ".php", "php")


def imports(path: Column, content: Column) -> Column:
    """Imported modules and names in order of pattern and place, each once, without aliases; none for other languages."""

    def every(key: str, text: Column = content) -> Column:
        return F.regexp_extract_all(text, F.lit(IMPORTS[key]), F.lit(1))

    def names(key: str) -> Column:
        bare = lambda n: F.regexp_replace(F.split(n, " as ")[0], r"^\s+|\s+$", "")
        return F.flatten(F.transform(every(key), lambda b: F.transform(F.split(b, ","), bare)))

    lang = language_of(path)
    found = (
        F.when(lang == "js", F.concat(every("js module"), names("js names")))
        .when(lang == "go", F.concat(every("go single"), F.flatten(F.transform(every("go block"), lambda b: every("go inner", b)))))
        .when(lang == "php", F.concat(every("php file"), names("php names")))
    )
    return F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))


def html_tags(content: Column) -> Column:
    return F.transform(F.regexp_extract_all(content, F.lit(r"<([A-Za-z][A-Za-z0-9]*)"), F.lit(1)), lambda t: F.lower(t))


def html_links(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(r"href=\"([^\"]*)\""), F.lit(1))


def category(path: Column) -> Column:
    return F.when(F.lower(path).rlike(r"\.(pdf|md|txt)$"), "document").otherwise("code")


def priority(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("adr/")) | F.contains(path, F.lit("architecture")), 1.5).otherwise(1.0)
