"""Registered queries: chunking, code analytics, incremental indexing, measures, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import guards
from ..functions.text import glob_regex, newline_count
from ..operators import analysis, chunking, incremental, kpi, lexical
from ..operators.records import delete_prefix, latest, meta, upsert
from ..session import scratch, table
from ..sources.manifests import MANIFESTS, joined_pieces, manifest_packages
from ..sources.tree import allowed, path_tree
from ..streaming import events as stream
from . import sql
from .catalogue import query
from .retrieval import documents, records


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks")


def one_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk once, the last version."""
    return latest(chunks(spark, sf_dir), ["chunk_id"], ["indexed_at", "updated_at"])


_CHUNK = "ch AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY indexed_at DESC NULLS LAST, updated_at DESC NULLS LAST) = 1)"


def _windows_sql(source: str, id_col: str, text: str, size: int, overlap: int, line: str) -> str:
    step = size - overlap
    nl = "length({0}) - length(replace({0}, chr(10), ''))"
    return (
        f"WITH {source} b AS (SELECT {id_col}, {text} AS t, {line} AS l, CASE WHEN length({text}) <= {size} THEN 1 ELSE ceil((length({text}) - {size}) / {step}.0)::BIGINT + 1 END AS n FROM src WHERE length({text}) > 0), "
        f"k AS (SELECT {id_col}, t, l, unnest(range(0, n)) AS i FROM b), w AS (SELECT {id_col}, i::INT AS chunk_no, (i * {step})::INT AS char_start, substring(t, i * {step} + 1, {size}) AS content, "
        f"l + {nl.format(f'left(t, i * {step})')} AS start_line FROM k) SELECT {id_col}, chunk_no, char_start, sha256(content) AS hash, start_line::INT AS start_line, "
        f"(start_line + {nl.format('content')})::INT AS end_line FROM w"
    )


@query(_windows_sql("src AS (FROM documents),", "doc_id", "text", 3000, 500, "1"))
def window_chunks_3000(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows over every document."""
    w = chunking.windows(documents(spark, sf_dir), "doc_id", "text")
    return w.select("doc_id", "chunk_no", "char_start", F.sha2("content", 256).alias("hash"), "start_line", "end_line")


@query(_windows_sql(_CHUNK + ", src AS (FROM ch),", "chunk_id", "content", 8000, 800, "coalesce(start_line, 1)"))
def split_chunks_8000(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oversize split at fixed places."""
    w = chunking.windows(one_chunk(spark, sf_dir), "chunk_id", "content", chunking.SPLIT, chunking.SPLIT_OVERLAP, F.coalesce("start_line", F.lit(1)))
    return w.select("chunk_id", "chunk_no", "char_start", F.sha2("content", 256).alias("hash"), "start_line", "end_line")


@query("SELECT chunk_id, length(content) - length(replace(content, chr(10), '')) AS newlines, count(*) AS n FROM chunks GROUP BY ALL")
def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newline counts."""
    return chunks(spark, sf_dir).groupBy("chunk_id", newline_count(F.col("content")).cast("bigint").alias("newlines")).agg(F.count("*").alias("n"))


@query(
    "WITH " + _CHUNK + " SELECT chunk_id, round(1.0::DOUBLE - CASE WHEN end_line - start_line + 1 < 3 THEN 0.3 ELSE 0 END + CASE WHEN end_line - start_line + 1 > 10 THEN 0.2 ELSE 0 END + "
    "0.1::DOUBLE * coalesce(len(calls), 0), 4) AS score FROM ch"
)
def function_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score from lines and calls."""
    return one_chunk(spark, sf_dir).select("chunk_id", chunking.function_score(F.col("start_line"), F.col("end_line"), F.col("calls")).alias("score"))


@query("SELECT DISTINCT chunk_id, sha256(content) AS hash FROM chunks WHERE content IS NOT NULL")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11: SHA-256 of the content."""
    return chunks(spark, sf_dir).where("content is not null").select("chunk_id", F.sha2("content", 256).alias("hash")).distinct()


@query(
    "WITH " + _CHUNK + ", s AS (SELECT *, array_to_string(list_sort(list_transform(map_entries(structural_metadata), lambda e: e.key || '=' || coalesce(e.value, ''))), ' ') AS st FROM ch) "
    "SELECT chunk_id, sha256('File: ' || coalesce(rel_path, '') || '. Entity: ' || CASE WHEN symbols[1] <> '' THEN symbols[1] ELSE 'Global' END || '. ' || CASE WHEN parent_symbol <> '' THEN 'Parent: ' || parent_symbol || '. ' ELSE '' END || "
    "'Type: ' || coalesce(type, '') || '. Docstring: ' || CASE WHEN docstring <> '' THEN docstring ELSE 'None' END || '. Calls: ' || CASE WHEN len(calls) > 0 THEN array_to_string(calls, ', ') ELSE 'None' END || '.' || "
    "CASE WHEN st <> '' THEN ' [Structure: ' || st || ' ]' ELSE '' END || ' Code:' || chr(10) || coalesce(content, '')) AS hash FROM s"
)
def contextual_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is embedded of each chunk, as a hash."""
    c = F.col
    entity = F.try_element_at("symbols", F.lit(1))
    text = chunking.contextual_string(c("rel_path"), entity, c("parent_symbol"), c("type"), c("docstring"), c("calls"), c("structural_metadata"), c("content"))
    return one_chunk(spark, sf_dir).select("chunk_id", F.sha2(text, 256).alias("hash"))


@query(
    "WITH " + _CHUNK + ", t AS (SELECT chunk_id, unnest(list_transform(regexp_extract_all(content, '<([A-Za-z][A-Za-z0-9]*)', 1), lambda x: lower(x))) AS tag FROM ch WHERE ends_with(rel_path, '.html')) "
    "SELECT chunk_id, tag, count(*) AS n FROM t GROUP BY ALL"
)
def html_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of HTML chunks."""
    rows = one_chunk(spark, sf_dir).where(F.endswith("rel_path", F.lit(".html")))
    return rows.select("chunk_id", F.explode(chunking.html_tags(F.col("content"))).alias("tag")).groupBy("chunk_id", "tag").agg(F.count("*").alias("n"))


@query("SELECT doc_id, unnest(regexp_extract_all(text, 'href=\"([^\"]*)\"', 1)) AS link FROM documents")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of captured pages."""
    return documents(spark, sf_dir).select("doc_id", F.explode(chunking.html_links(F.col("text"))).alias("link"))


def _imports_sql(content: str) -> str:
    p = {k: v.replace("'", "''") for k, v in chunking.IMPORTS.items()}

    def every(key: str, text: str = content) -> str:
        return f"regexp_extract_all({text}, '{p[key]}', 1)"

    def names(key: str) -> str:
        one = "regexp_replace(string_split(n, ' as ')[1], '^\\s+|\\s+$', '', 'g')"
        return f"flatten(list_transform({every(key)}, lambda b: list_transform(string_split(b, ','), lambda n: {one})))"

    inner = f"flatten(list_transform({every('go block')}, lambda b: {every('go inner', 'b')}))"
    ends = "regexp_extract(rel_path, '(\\.[A-Za-z0-9]+)$', 1)"
    return (
        f"CASE WHEN {ends} IN ('.ts', '.tsx', '.js', '.jsx') THEN list_concat({every('js module')}, {names('js names')}) "
        f"WHEN {ends} = '.go' THEN list_concat({every('go single')}, {inner}) WHEN {ends} = '.php' THEN list_concat({every('php file')}, {names('php names')}) END"
    )


@query("WITH " + _CHUNK + f", i AS (SELECT chunk_id, unnest({_imports_sql('content')}) AS module FROM ch) SELECT DISTINCT chunk_id, module FROM i")
def import_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imported modules of each chunk."""
    return one_chunk(spark, sf_dir).select("chunk_id", F.explode(chunking.imports(F.col("rel_path"), F.col("content"))).alias("module"))


@query(
    "SELECT rel_path, CASE WHEN regexp_matches(lower(rel_path), '\\.(pdf|md|txt)$') THEN 'document' ELSE 'code' END AS category, "
    "CASE WHEN contains(rel_path, 'adr/') OR contains(rel_path, 'architecture') THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS priority, count(*) AS n FROM chunks GROUP BY ALL"
)
def path_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """category and priority by path."""
    p = F.col("rel_path")
    return chunks(spark, sf_dir).groupBy("rel_path", chunking.category(p).alias("category"), chunking.priority(p).cast("double").alias("priority")).agg(F.count("*").alias("n"))


_IGN = "(node_modules|\\.git|\\.next|\\.turbo|dist|build|generated|coverage|out|vendor|\\.vector-db|\\.data)"


@query(
    f"SELECT DISTINCT project_id, rel_path FROM scan_results WHERE NOT regexp_matches(rel_path, '(^|/){_IGN}/') AND NOT regexp_matches(lower(rel_path), '\\.(map|svg|png|jpg|jpeg|gif|ico|pdf)$|\\.min\\.js$') "
    "AND regexp_matches(rel_path, '\\.(ts|tsx|js|jsx|prisma|json|css|html|md|env|yml|yaml|go|py|rs|sh|txt|pdf)$') AND NOT regexp_matches(lower(rel_path), '(^|/)(package-lock\\.json|pnpm-lock\\.yaml|yarn\\.lock|go\\.sum)$')"
)
def scan_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths a scan takes up."""
    return table(spark, sf_dir, "scan_results").where(allowed(F.col("rel_path"))).select("project_id", "rel_path").distinct()


_LINES = "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)"


@query(_LINES + " SELECT doc_id, line_no::INT AS line_no, trim(line, ' ') AS line FROM l WHERE regexp_matches(line, 'WARN|ERROR: [a-z]+')")
def grep_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines that match a pattern."""
    pattern = "WARN|ERROR: [a-z]+"
    assert guards.check_regex(pattern) is None
    return analysis.grep(documents(spark, sf_dir), "text", ["doc_id"], F.col("line").rlike(pattern), F.col("text").rlike(pattern))


@query(_LINES + " SELECT doc_id, line_no::INT AS line_no, trim(line, ' ') AS line FROM l WHERE contains(lower(line), 'retry')")
def grep_literal_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines that hold a text in any case."""
    has = lambda c: F.contains(F.lower(c), F.lit("retry"))
    return analysis.grep(documents(spark, sf_dir), "text", ["doc_id"], has("line"), has("text"))


@query(
    _LINES + ", k AS (SELECT *, unnest(['TODO', 'FIXME', 'HACK', 'DEPRECATED']) AS keyword FROM l) SELECT doc_id, line_no::INT AS line_no, keyword, "
    "'[' || keyword || ']: ' || regexp_extract(line, '(?i)' || keyword || '[:\\s]+(.*)', 1) AS message FROM k WHERE regexp_matches(line, '(?i)' || keyword || '[:\\s]+(.*)')"
)
def pattern_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """marks of work to do."""
    lines = analysis.split_lines(documents(spark, sf_dir).where("text is not null"), "text", ["doc_id"])
    return analysis.pattern_issues(lines).select("doc_id", "line_no", "keyword", "message")


@query("SELECT DISTINCT rel_path FROM chunks WHERE regexp_matches(string_split(rel_path, '/')[-1], '^[^/]*_[a-m][^/]*\\.go$')")
def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file names by a glob."""
    rows = chunks(spark, sf_dir).select("rel_path").distinct()
    return rows.where(F.element_at(F.split("rel_path", "/"), -1).rlike(glob_regex("*_[a-m]*.go")))


_DISK = "disk AS (SELECT project_id, rel_path, max_by(hash, (loaded_at, result_id)) AS hash FROM scan_results WHERE coalesce(err, '') = '' AND NOT skipped AND project_id IS NOT NULL GROUP BY 1, 2)"
_STORE = "store AS (SELECT project_id, rel_path, max_by(hash, (indexed_at, chunk_id)) AS hash FROM chunks WHERE project_id IS NOT NULL AND rel_path IS NOT NULL GROUP BY 1, 2)"
_KEYS = ["project_id", "rel_path"]


def _disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last good scan of each file."""
    rows = table(spark, sf_dir, "scan_results").where((F.coalesce("err", F.lit("")) == "") & ~F.col("skipped") & F.col("project_id").isNotNull())
    return rows.groupBy(*_KEYS).agg(F.max_by("hash", F.struct("loaded_at", "result_id")).alias("hash"))


def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes in the store, as the scans before the last ones left them."""
    rows = table(spark, sf_dir, "scan_results").where((F.coalesce("err", F.lit("")) == "") & ~F.col("skipped") & F.col("project_id").isNotNull() & (F.col("loaded_at") < F.lit("2025-06-01").cast("timestamp_ntz")))
    return rows.groupBy(*_KEYS).agg(F.max_by("hash", F.struct("loaded_at", "result_id")).alias("hash"))


_OLD = _DISK.replace("disk AS", "store AS").replace("GROUP BY", "AND loaded_at < TIMESTAMP '2025-06-01' GROUP BY")
_BOTH = (
    f"WITH {_DISK}, {_OLD}, c AS (SELECT coalesce(d.project_id, s.project_id) AS project_id, coalesce(d.rel_path, s.rel_path) AS rel_path, CASE WHEN s.hash IS NULL THEN 'missing' "
    "WHEN d.hash IS NULL THEN 'deleted' WHEN d.hash = s.hash THEN 'indexed' ELSE 'modified' END AS state FROM disk d FULL JOIN store s ON d.project_id = s.project_id AND d.rel_path = s.rel_path)"
)


@query(_BOTH + " SELECT project_id, state, count(*) AS n FROM c GROUP BY ALL")
def index_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths by state."""
    return incremental.compare(_disk(spark, sf_dir), _store(spark, sf_dir), _KEYS).groupBy("project_id", "state").agg(F.count("*").alias("n"))


@query(f"WITH {_DISK}, {_OLD} SELECT d.project_id, d.rel_path, d.hash FROM disk d WHERE NOT EXISTS (SELECT 1 FROM store s WHERE s.project_id = d.project_id AND s.rel_path = d.rel_path AND s.hash = d.hash)")
def incremental_to_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New and changed paths."""
    return incremental.to_index(_disk(spark, sf_dir), _store(spark, sf_dir), _KEYS)


@query(f"WITH {_DISK}, {_STORE} SELECT s.project_id, s.rel_path, s.hash FROM store s WHERE NOT EXISTS (SELECT 1 FROM disk d WHERE d.project_id = s.project_id AND d.rel_path = s.rel_path)")
def stale_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored paths that no scan found."""
    rows = chunks(spark, sf_dir).where("project_id is not null and rel_path is not null")
    store = rows.groupBy(*_KEYS).agg(F.max_by("hash", F.struct("indexed_at", "chunk_id")).alias("hash"))
    return incremental.stale(_disk(spark, sf_dir), store, _KEYS)


@query("WITH " + sql.RECORDS + " SELECT id, rec_no, sha256(coalesce(content, '')) AS hash FROM rec")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Early rows, then late ones put over them by id."""
    rows = table(spark, sf_dir, "records")
    line = F.lit("2025-06-01").cast("timestamp_ntz")
    late = F.coalesce(F.col("indexed_at") >= line, F.lit(False))
    old, new = (latest(rows.where(c), ["id"], ["indexed_at", "rec_no"]) for c in (~late, late))
    return upsert(old, new, "id").select("id", "rec_no", F.sha2(F.coalesce("content", F.lit("")), 256).alias("hash"))


@query("WITH " + sql.RECORDS + " SELECT id FROM rec WHERE NOT coalesce(metadata['path'] = 'api' OR starts_with(metadata['path'], 'api/'), false)")
def delete_by_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a prefix delete leaves."""
    return delete_prefix(records(spark, sf_dir), meta(F.col("metadata"), "path"), "api").select("id")


@query("WITH " + sql.RECORDS + " SELECT DISTINCT metadata['path'] AS path FROM rec WHERE starts_with(metadata['path'], 'api/')")
def dry_run_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths a delete would take."""
    path = meta(F.col("metadata"), "path")
    return records(spark, sf_dir).where(path.startswith("api/")).select(path.alias("path")).distinct()


@query(
    "WITH p AS (SELECT DISTINCT project_id, string_split(rel_path, '/') AS p FROM scan_results), d AS (SELECT *, unnest(range(1, least(len(p), 3) + 1)) AS d FROM p) "
    "SELECT DISTINCT project_id, array_to_string(p[1:d - 1], '/') AS parent, p[d] AS name, d < len(p) AS is_dir, d::INT AS depth FROM d"
)
def directory_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders and files down to three levels."""
    rows = table(spark, sf_dir, "scan_results").select("project_id", "rel_path").distinct()
    return path_tree(rows, "rel_path", ["project_id"], 3)


_TEST = "(ends_with(rel_path, '_test.go') OR contains(rel_path, '/test/') OR contains(rel_path, '/tests/'))"
_KINDS = ", ".join(f"'{k}'" for k in analysis.DEFINING)
_DEFS = (
    f"d0 AS (SELECT DISTINCT project_id, rel_path, unnest(symbols) AS symbol FROM chunks WHERE type IN ({_KINDS}) AND NOT {_TEST}), "
    "d AS (SELECT *, CASE WHEN contains(symbol, '.') THEN regexp_extract(symbol, '^[^.]*\\.(.*)$', 1) ELSE symbol END AS short FROM d0 WHERE symbol <> '' AND project_id IS NOT NULL "
    "AND NOT regexp_matches(symbol, '^(main|NewServer|Test.*|Benchmark.*|Example.*)$'))"
)


def _used(test: str, names: str) -> str:
    return f"u AS (SELECT DISTINCT project_id, name FROM (SELECT project_id, unnest({names}) AS name FROM chunks WHERE {test} {_TEST} AND project_id IS NOT NULL) WHERE name <> '')"


_ANTI = " WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.project_id = d.project_id AND (u.name = d.symbol OR u.name = d.short))"
_NAMES = "list_concat(coalesce(calls, []), coalesce(relationships, []))"


@query(f"WITH {_DEFS}, {_used('NOT', _NAMES)} SELECT project_id, rel_path, symbol FROM d" + _ANTI)
def dead_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1: symbols nobody outside tests uses."""
    return analysis.dead_symbols(chunks(spark, sf_dir))


@query(
    f"WITH {_DEFS}, " + _used("", "list_concat(" + _NAMES + ", coalesce(regexp_split_to_array(content, '[^\\w.$]+'), []))")
    + " SELECT project_id, rel_path, symbol FROM d" + _ANTI + " AND NOT starts_with(symbol, '_')"
)
def missing_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q2: public symbols no test mentions."""
    return analysis.missing_tests(chunks(spark, sf_dir))


_REL = "r AS (SELECT DISTINCT project_id, rel_path, unnest(relationships) AS module FROM chunks)"
_PKG = "CASE WHEN starts_with(module, '@') THEN regexp_extract(module, '^(@[^/]+/[^/]+)', 1) ELSE regexp_extract(module, '^([^/]+)', 1) END"


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chunks(spark, sf_dir).select("project_id", "rel_path", F.explode("relationships").alias("module"))
    return rows.distinct()


@query(
    f"WITH {_REL}, n AS (SELECT *, {_PKG} AS package FROM r WHERE NOT regexp_matches(module, '^[./\\\\]')), "
    "f AS (SELECT project_id, string_split(rel_path, '/')[-1] AS name, string_agg(p.content, '' ORDER BY try_cast(regexp_extract(p.id, '(\\d+)$', 1) AS INT)) AS text FROM scan_results, unnest(records) AS u(p) "
    "WHERE string_split(rel_path, '/')[-1] IN ('package.json', 'go.mod', 'requirements.txt') GROUP BY result_id, 1, 2), "
    "l AS (SELECT project_id, name, trim(unnest(string_split(replace(text, chr(13), ''), chr(10))), ' ' || chr(9)) AS line FROM f WHERE name <> 'package.json'), "
    "m AS (SELECT project_id, unnest(list_concat(json_keys(text, '$.dependencies'), json_keys(text, '$.devDependencies'))) AS package FROM f WHERE name = 'package.json' AND json_valid(text) "
    "UNION SELECT project_id, regexp_split_to_array(line, '\\s+')[1] FROM l WHERE name = 'go.mod' AND regexp_matches(line, '\\S\\s+\\S') "
    "UNION SELECT project_id, trim(string_split(line, '==')[1]) FROM l WHERE name = 'requirements.txt' AND line <> '' AND NOT starts_with(line, '#')) "
    "SELECT n.project_id, n.package, count(DISTINCT rel_path) AS n_files, min(rel_path) AS first_file FROM n WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.project_id = n.project_id AND m.package = n.package) GROUP BY 1, 2"
)
def missing_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imported packages that no manifest among the project's scanned files names."""
    files = joined_pieces(table(spark, sf_dir, "scan_results"), ["result_id", "project_id", "rel_path"], "records", "text", F.element_at(F.split("rel_path", "/"), -1).isin(MANIFESTS))
    manifest = manifest_packages(files, "rel_path", "text", ["project_id"])
    return analysis.missing_dependencies(relations(spark, sf_dir), manifest)


@query(
    f"WITH {_REL}, e AS (SELECT project_id, string_split(rel_path, '/') AS p, module AS target FROM r) "
    "SELECT DISTINCT project_id, CASE WHEN p[1] IN ('apps', 'packages') AND len(p) > 2 THEN p[1] || '/' || p[2] ELSE p[1] END AS source, target FROM e"
)
def arch_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4: which package relates to which module."""
    return analysis.edges(relations(spark, sf_dir))


_METHODS = "SELECT DISTINCT project_id, parent_symbol AS t, s AS method FROM chunks, unnest(symbols) AS u(s) WHERE parent_symbol <> '' AND s <> '' AND project_id IS NOT NULL AND s <> parent_symbol"


@query(
    f"WITH m AS ({_METHODS}), need AS (SELECT project_id, t AS interface, count(*) AS n FROM m GROUP BY 1, 2), j AS (SELECT project_id, a.t AS interface, b.t AS type, count(*) AS n FROM m a JOIN m b USING (project_id, method) WHERE a.t <> b.t GROUP BY 1, 2, 3) "
    "SELECT project_id, interface, type, n AS n_methods FROM j JOIN need USING (project_id, interface, n)"
)
def implements_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that offer every method another one of their project has."""
    rows = chunks(spark, sf_dir).where("parent_symbol <> '' and project_id is not null")
    m = rows.select("project_id", F.col("parent_symbol").alias("t"), F.explode("symbols").alias("method"))
    m = m.where("method <> '' and method <> t").distinct()
    found = analysis.implementations(m.withColumnRenamed("t", "interface"), m.withColumnRenamed("t", "type"))
    return found.where("interface <> type")


@query("SELECT DISTINCT chunk_id, k[7:] AS field, structural_metadata[k] AS value FROM (SELECT *, unnest(map_keys(structural_metadata)) AS k FROM chunks) WHERE starts_with(k, 'field:')")
def field_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6: fields by chunk."""
    rows = chunks(spark, sf_dir).select("chunk_id", F.explode("structural_metadata").alias("k", "value")).where(F.col("k").startswith("field:"))
    return rows.select("chunk_id", F.substring("k", 7, 1 << 20).alias("field"), "value").distinct()


@query("SELECT DISTINCT chunk_id, s AS name FROM chunks, unnest(symbols) AS u(s) WHERE contains(lower(s), 'snapshot')")
def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q7: entities by part of their name."""
    rows = chunks(spark, sf_dir).select("chunk_id", F.explode("symbols").alias("name"))
    return rows.where(F.contains(F.lower("name"), F.lit("snapshot"))).distinct()


@query(
    "WITH c AS (SELECT project_id, rel_path, unnest(calls) AS symbol FROM chunks) SELECT symbol, count(DISTINCT rel_path) AS n_files, count(*) AS n_refs, "
    "CASE WHEN count(DISTINCT rel_path) > 10 THEN 'High' WHEN count(DISTINCT rel_path) > 3 THEN 'Medium' ELSE 'Low' END AS risk FROM c GROUP BY 1"
)
def impact_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that refer to each symbol, and the risk of a change."""
    rows = chunks(spark, sf_dir).select("rel_path", F.explode("calls").alias("symbol"))
    return rows.groupBy("symbol").agg(F.countDistinct("rel_path").alias("n_files"), F.count("*").alias("n_refs")).withColumn("risk", analysis.risk(F.col("n_files")))


@query(
    f"WITH {_REL}, m AS (SELECT DISTINCT module FROM r), a(alias, target) AS (VALUES ('@/', 'src/'), ('pe', 'packages/pe'), ('pem', 'packages/x/pem')), "
    "h AS (SELECT module, alias, target FROM m JOIN a ON starts_with(module, alias) QUALIFY row_number() OVER (PARTITION BY module ORDER BY length(alias) DESC, alias DESC) = 1) "
    "SELECT module, coalesce(target || substring(module, length(alias) + 1), module) AS resolved FROM m LEFT JOIN h USING (module)"
)
def alias_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.7: the longest alias wins."""
    aliases = spark.createDataFrame([("@/", "src/"), ("pe", "packages/pe"), ("pem", "packages/x/pem")], "alias string, target string")
    return analysis.resolve_aliases(relations(spark, sf_dir), aliases)


@query(
    f"WITH {_REL} SELECT DISTINCT doc_id, lower(module) AS dep FROM documents JOIN r USING (project_id) WHERE doc_type IN ('decision', 'summary') AND module <> '' "
    "AND (contains(lower(text), 'no ' || lower(module)) OR contains(lower(text), 'forbidden: ' || lower(module)))"
)
def forbidden_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions and summaries that rule out a module their project depends on."""
    rules = documents(spark, sf_dir).where(F.col("doc_type").isin("decision", "summary")).select("doc_id", "project_id", F.col("text").alias("rule"))
    deps = relations(spark, sf_dir).select("project_id", F.col("module").alias("dep"))
    return analysis.forbidden(rules, deps).select("doc_id", "dep").distinct()


@query(
    "WITH c AS (SELECT project_id, regexp_replace(rel_path, '/?[^/]*$', '') AS package, symbols[1] AS name, type, coalesce(relationships, []) AS rels FROM chunks WHERE symbols[1] <> ''), "
    "x AS (SELECT *, coalesce(regexp_matches(name, '^[A-Z]') OR regexp_matches(type, 'class|interface'), false) AS e FROM c), "
    "b AS (SELECT project_id, package, count(*) FILTER (WHERE e) AS n_exported, count(*) FILTER (WHERE NOT e) AS n_internal, count(DISTINCT type) AS n_types, "
    "coalesce(array_to_string(list_sort(list_distinct(list(name) FILTER (WHERE e)))[1:6], ','), '') AS names FROM x GROUP BY 1, 2), "
    "d AS (SELECT project_id, package, count(DISTINCT dep) AS n_deps FROM (SELECT project_id, package, unnest(rels) AS dep FROM c) GROUP BY 1, 2) "
    "SELECT b.project_id, b.package, n_exported, n_internal, n_types, coalesce(n_deps, 0) AS n_deps, names FROM b LEFT JOIN d ON b.project_id = d.project_id AND b.package = d.package WHERE b.project_id IS NOT NULL"
)
def package_distillation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q12: what each folder exports, uses and holds."""
    return analysis.distill(chunks(spark, sf_dir).where("project_id is not null"))


@query(
    "WITH f AS (SELECT DISTINCT project_id, rel_path, unnest(calls) AS name FROM chunks), d AS (SELECT DISTINCT project_id, unnest(symbols) AS name, rel_path AS def_path FROM chunks) "
    "SELECT f.project_id, f.rel_path, d.def_path, count(DISTINCT f.name) AS n_names FROM f JOIN d ON f.project_id = d.project_id AND f.name = d.name AND f.rel_path <> d.def_path GROUP BY ALL"
)
def related_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q9: files that define what a file calls."""
    f = chunks(spark, sf_dir).select("project_id", "rel_path", F.explode("calls").alias("name")).distinct()
    d = chunks(spark, sf_dir).select("project_id", F.explode("symbols").alias("name"), F.col("rel_path").alias("def_path")).distinct()
    return f.join(d, ["project_id", "name"]).where("rel_path <> def_path").groupBy("project_id", "rel_path", "def_path").agg(F.countDistinct("name").alias("n_names"))


@query("SELECT project_id, coalesce(nullif(trim(status), ''), 'unknown') AS status, main_language FROM projects")
def status_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every project."""
    status = F.when(F.trim("status") == "", None).otherwise(F.trim("status"))
    return table(spark, sf_dir, "projects").select("project_id", F.coalesce(status, F.lit("unknown")).alias("status"), "main_language")


@query(
    "WITH h AS (SELECT rel_path AS query, s AS item, row_number() OVER (PARTITION BY rel_path ORDER BY min(chunk_no), s) AS rank FROM chunks, unnest(calls) AS u(s) WHERE rel_path IS NOT NULL GROUP BY 1, 2), "
    "e AS (SELECT rel_path AS query, max(s) AS item FROM chunks, unnest(calls) AS u(s) WHERE rel_path IS NOT NULL GROUP BY 1), p AS (SELECT e.query, CASE WHEN rank <= 10 THEN rank END AS rank FROM e LEFT JOIN h USING (query, item)) "
    "SELECT count(*) AS n_queries, round(avg((rank IS NOT NULL)::INT::DOUBLE), 6) AS recall, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr, round(avg(coalesce(1.0::DOUBLE / log2(rank + 1.0), 0)), 6) AS ndcg FROM p"
)
def recall_mrr_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q21: retrieval measures; a file's calls in order are the hits, its last call by name is expected."""
    from pyspark.sql import Window as W

    c = chunks(spark, sf_dir).where("rel_path is not null").select(F.col("rel_path").alias("query"), "chunk_no", F.explode("calls").alias("item"))
    firsts = c.groupBy("query", "item").agg(F.min("chunk_no").alias("n"))
    hits = firsts.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("n", "item")))
    return kpi.retrieval_kpis(hits, c.groupBy("query").agg(F.max("item").alias("item")), 10)


@query("SELECT event_type, percentile_disc(0.5) WITHIN GROUP (ORDER BY value) AS p50, percentile_disc(0.95) WITHIN GROUP (ORDER BY value) AS p95, count(*) AS n FROM events GROUP BY 1")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(kpi.nearest_rank("value", 0.5).alias("p50"), kpi.nearest_rank("value", 0.95).alias("p95"), F.count("*").alias("n"))


@query(
    "WITH b(le) AS (VALUES (1.0::DOUBLE), (5), (10), (25), (50), (100), (250), (500), ('inf'::DOUBLE)) SELECT le, count(value) FILTER (WHERE value <= le) AS n FROM events, b GROUP BY le"
)
def histogram_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative histogram."""
    return kpi.histogram(table(spark, sf_dir, "events"), "value", [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0])


@query("SELECT project_id, round(avg((indexed AND NOT skipped)::INT::DOUBLE), 6) AS hit_rate FROM scan_results GROUP BY 1")
def hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: share of scans that were indexed."""
    return table(spark, sf_dir, "scan_results").groupBy("project_id").agg(kpi.hit_rate(F.col("indexed") & ~F.col("skipped")).alias("hit_rate"))


_SESSIONS = (
    "WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM e)"
)


@query(_SESSIONS + " SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n_events, max_by(event_type, (ts, event_type)) AS last_op FROM s GROUP BY user_id, sid")
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of events with no longer gap, and the last operation of each."""
    return stream.debounce(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", "30 minutes")


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS last_op, count(*) AS n_events FROM events GROUP BY 1")
def last_op_per_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last operation of each key."""
    return stream.last_operations(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", "event_id")


@query(_SESSIONS + " SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n_events, max_by(event_type, (ts, event_type)) AS last_op FROM s GROUP BY user_id, sid")
def stream_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1-T3 as a stream over the events there are; equal to the batch."""
    rows = stream.stream_events(spark, sf_dir).withWatermark("ts", "1 hour")
    sessions = stream.debounce(rows, "user_id", "ts", "event_type", "30 minutes")
    out = stream.run_to_folder(sessions, scratch(spark, "debounced"), "complete")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query(
    "WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts)::DOUBLE / 1e6::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), "
    "b AS (SELECT user_id, event_id, n, t, 2::DOUBLE AS tokens, true AS allowed FROM e WHERE n = 1 UNION ALL "
    "SELECT user_id, event_id, n, t, x - CASE WHEN x >= 1 THEN 1 ELSE 0 END, x >= 1 FROM (SELECT e.*, least(3::DOUBLE, b.tokens + greatest(0::DOUBLE, e.t - b.t) * (1::DOUBLE / 3600::DOUBLE)) AS x FROM b JOIN e ON e.user_id IS NOT DISTINCT FROM b.user_id AND e.n = b.n + 1)) "
    "SELECT user_id, event_id, allowed FROM b"
)
def stream_token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rate limit per user as a stateful stream."""
    rows = stream.stream_events(spark, sf_dir).select("user_id", "event_id", "ts")
    return stream.run_to_folder(stream.token_bucket(rows, "user_id", "ts", 1 / 3600, 3.0), scratch(spark, "bucket"))


@query(
    "SELECT doc_id, regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g') AS text FROM documents"
)
def strip_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """texts without control characters."""
    return documents(spark, sf_dir).select("doc_id", guards.strip_control(F.col("text")).alias("text"))


@query(
    "SELECT DISTINCT rel_path, NOT regexp_matches(rel_path, '^[/~]') AND NOT list_contains(string_split(rel_path, '/'), '..') AND len(list_filter(string_split(rel_path, '/'), lambda p: p NOT IN ('', '.'))) BETWEEN 1 AND 20 AS safe FROM scan_results"
)
def safe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paths that stay below their root."""
    return table(spark, sf_dir, "scan_results").select("rel_path", guards.is_safe_path(F.col("rel_path")).alias("safe")).distinct()


@query(
    "WITH " + _CHUNK + ", p AS (SELECT project_id, string_agg(content, chr(10) ORDER BY chunk_id) AS text, count(*) AS n FROM (SELECT * FROM ch WHERE type = 'Unknown' AND content IS NOT NULL "
    "QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY chunk_id) <= 50) GROUP BY 1) SELECT project_id, n, sha256(CASE WHEN length(text) > 10000 THEN left(text, 10000) || '...' ELSE text END) AS hash FROM p"
)
def knowledge_distillation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q13, V7: the first 50 chunks of a kind per project, joined and cut at 10,000 code points."""
    from pyspark.sql import Window as W

    from ..functions.text import truncate_runes

    rows = one_chunk(spark, sf_dir).where("type = 'Unknown' and content is not null").select("project_id", "chunk_id", "content")
    few = rows.withColumn("_r", F.row_number().over(W.partitionBy("project_id").orderBy("chunk_id"))).where("_r <= 50")
    joined = few.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "content"))).alias("c"), F.count("*").alias("n"))
    text = F.array_join(F.transform("c", lambda x: x["content"]), "\n")
    return joined.select("project_id", "n", F.sha2(truncate_runes(text, 10000), 256).alias("hash"))


@query(
    "WITH " + sql.tokens("chunks", "chunk_id", "content") + ", " + _CHUNK.replace("chunks", "chunks", 1)
    + ", t AS (SELECT type, term, count(*) AS n FROM toks JOIN ch ON ch.chunk_id = toks.id GROUP BY 1, 2) SELECT type, count(*) AS n_terms, sum(n)::BIGINT AS n_tokens FROM t GROUP BY 1"
)
def vocabulary_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A2: distinct terms and tokens by syntax node."""
    kinds = one_chunk(spark, sf_dir).select("chunk_id", "type")
    toks = lexical.tokens(chunks(spark, sf_dir), "chunk_id", "content").join(kinds, "chunk_id").groupBy("type", "term").agg(F.count("*").alias("n"))
    return toks.groupBy("type").agg(F.count("*").alias("n_terms"), F.sum("n").alias("n_tokens"))
