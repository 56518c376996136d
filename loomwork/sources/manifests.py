"""Dependency manifests and settings."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Names of the files that list dependencies (fixed values).
MANIFESTS = ["package.json", "go.mod", "requirements.txt"]


def joined_pieces(files: DataFrame, keep: list[str], records_col: str, out: str, which: Column | None = None) -> DataFrame:
    """Files with their text put together from pieces, by the number that ends their ids."""
    rows = files if which is None else files.where(which)
    pieces = F.transform(F.filter(records_col, lambda r: r["content"].isNotNull()), lambda r: F.struct(F.regexp_extract(r["id"], r"(\d+)$", 1).try_cast("int").alias("n"), r["content"].alias("c")))
    return rows.select(*keep, F.array_join(F.transform(F.array_sort(pieces), lambda x: x["c"]), "").alias(out))


def manifest_packages(files: DataFrame, name_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """Packages that manifests name: package.json (dependencies and devDependencies),
    go.mod (first field of lines of two and more), requirements.txt (before ``==``)."""
    name = F.element_at(F.split(name_col, "/"), -1)
    deps = lambda key: F.map_keys(F.from_json(F.get_json_object(text_col, f"$.{key}"), "map<string,string>"))
    none = F.array().cast("array<string>")
    npm = F.array_union(F.coalesce(deps("dependencies"), none), F.coalesce(deps("devDependencies"), none))
    lines = F.transform(F.split(text_col, r"\r?\n"), lambda x: F.trim(x, F.lit(" \t")))
    go = F.transform(F.filter(lines, lambda x: F.size(F.split(x, r"\s+")) >= 2), lambda x: F.split(x, r"\s+")[0])
    pip = F.filter(F.transform(lines, lambda x: F.trim(F.split(x, "==")[0])), lambda x: (x != "") & ~x.startswith("#"))
    found = F.when(name == "package.json", npm).when(name == "go.mod", go).when(name == "requirements.txt", pip)
    return files.select(*keep, F.explode(found).alias("package")).distinct()


def strip_jsonc(text: str) -> str:
    """JSON without comments and trailing commas; strings stay as they are."""
    token = re.compile(r'"(?:[^"\\]|\\.)*"|//[^\n]*|/\*.*?\*/', re.S)
    bare = token.sub(lambda m: m[0] if m[0][0] == '"' else "", text)
    return re.sub(r'("(?:[^"\\]|\\.)*")|,(\s*[}\]])', lambda m: m[1] or m[2], bare)


def alias_table(tsconfig: str) -> list[tuple[str, str]]:
    """(alias, target) of a tsconfig's paths, without the closing star."""
    paths = json.loads(strip_jsonc(tsconfig)).get("compilerOptions", {}).get("paths", {})
    return [(a.rstrip("*"), t[0].rstrip("*")) for a, t in paths.items() if t]
