"""File trees: what a scan takes up, what it passes over."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import glob_regex

#: Folders never entered, files never read, endings taken up (fixed values).
IGNORED_DIRS = ["node_modules", ".git", ".next", ".turbo", "dist", "build", "generated", "coverage", "out", "vendor", ".vector-db", ".data"]
IGNORED_FILES = ["package-lock.json", "pnpm-lock.yaml", "yarn.lock", "go.sum"]
IGNORED_ENDINGS = [".map", ".min.js", ".svg", ".png", ".jpg", ".jpeg", ".gif", ".ico", ".pdf"]
ENDINGS = [".ts", ".tsx", ".js", ".jsx", ".prisma", ".json", ".css", ".html", ".md", ".env", ".yml", ".yaml", ".go", ".py", ".rs", ".sh", ".txt", ".pdf"]


def allowed(path: Column) -> Column:
    """Whether a scan takes up a path: no ignored folder or file, a known ending in its exact case."""
    parts = F.split(path, "/")
    name = F.lower(F.element_at(parts, -1))
    in_ignored = F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda d: d.isin(IGNORED_DIRS))
    ignored = name.isin(IGNORED_FILES)
    for ending in IGNORED_ENDINGS:
        ignored = ignored | name.endswith(ending)
    return ~in_ignored & ~ignored & F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1).isin(ENDINGS)


def ignore_patterns(text: str) -> list[tuple[bool, str]]:
    """An ignore file as (keep, expression) in order; later ones win."""
    out = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        keep, line = line.startswith("!"), line.lstrip("!")
        folder = line.endswith("/")
        body = line.strip("/")
        rx = "/".join(".*" if p == "**" else glob_regex(p)[1:-1] for p in body.split("/"))
        start = "^" if "/" in body or line.startswith("/") else "(^|.*/)"
        out.append((keep, f"{start}{rx}(/.*)$" if folder else f"{start}{rx}(/.*)?$"))
    return out


def not_ignored(path: Column, patterns: list[tuple[bool, str]]) -> Column:
    ignored = F.lit(False)
    for keep, rx in patterns:
        ignored = F.when(path.rlike(rx), F.lit(not keep)).otherwise(ignored)
    return ~ignored


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path there."""
    return fs.FileSystem.from_uri(re.sub(r"^(?:file:)?/+", "file:///", uri))


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """rel_path, content, hash of the files under a root; the first of .vector-ignore and .gitignore applies.

    The tree is listed without contents, the paths are filtered, and only the
    files that are left are read, by the tasks that hold their paths.  A file
    that is gone by then gives no row; bytes that are no UTF-8 are replaced.
    """
    system, base = _opened(root)
    if system.get_file_info(base).type != fs.FileType.Directory:
        raise FileNotFoundError(root)
    patterns: list[tuple[bool, str]] = []
    for name in (".vector-ignore", ".gitignore"):
        if system.get_file_info(f"{base}/{name}").type == fs.FileType.File:
            with system.open_input_stream(f"{base}/{name}") as f:
                patterns = ignore_patterns(f.read().decode("utf-8"))
            break
    inside = base.rstrip("/") + "/"
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    rel = F.substring("path", F.instr("path", inside) + len(inside), F.length("path"))
    kept = paths.withColumn("rel_path", rel).where(allowed(F.col("rel_path")) & not_ignored(F.col("rel_path"), patterns))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, rel_path in zip(batch.column("path").to_pylist(), batch.column("rel_path").to_pylist()):
                at, path = _opened(uri)
                try:
                    with at.open_input_stream(path) as f:
                        data = f.read()
                except FileNotFoundError:
                    continue
                yield pa.RecordBatch.from_pydict({"rel_path": [rel_path], "content": [data.decode("utf-8", "replace")], "hash": [hashlib.sha256(data).hexdigest()]})

    return kept.repartition(spark.sparkContext.defaultParallelism).mapInArrow(read, "rel_path string, content string, hash string")


def path_tree(paths: DataFrame, path_col: str, keep: list[str], depth: int = 3) -> DataFrame:
    """Folders and files down to a depth, each once: keep, parent, name, is_dir, depth."""
    parts = F.split(path_col, "/")
    rows = paths.select(*keep, parts.alias("_p")).withColumn("_d", F.explode(F.sequence(F.lit(1), F.least(F.size("_p"), F.lit(max(1, depth))))))
    return rows.select(
        *keep,
        F.array_join(F.slice("_p", F.lit(1), F.col("_d") - 1), "/").alias("parent"),
        F.element_at("_p", F.col("_d")).alias("name"),
        (F.col("_d") < F.size("_p")).alias("is_dir"),
        F.col("_d").alias("depth"),
    ).distinct()
