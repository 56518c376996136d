"""Registered queries: lookups and changes of the store, stored postings, capped matches, impact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import word_overlap
from ..operators import analysis, detect, hooks, lexical
from ..operators.records import clear_project, meta, upsert
from ..session import cut, scratch, table
from . import sql
from .catalogue import query
from .code import _ANTI, _CHUNK, _DEFS, _LINES, _NAMES, _used, chunks, one_chunk
from .retrieval import _DOC_BM25, SEARCH, TERMS, documents, records, store_text

_PATH = "metadata['path']"
#: A path of the store, told by the data: the least one of any chunk.
_FIRST = f"(SELECT min({_PATH}) FROM records WHERE metadata['type'] = 'chunk' AND {_PATH} <> '')"


def first_path(rows: DataFrame) -> DataFrame:
    """One row: the least path of a stored chunk."""
    path = meta(F.col("metadata"), "path")
    return rows.where((meta(F.col("metadata"), "type") == "chunk") & (path != "")).agg(F.min(path).alias("path"))


def at_path(rows: DataFrame) -> DataFrame:
    return rows.withColumn("path", meta(F.col("metadata"), "path")).join(F.broadcast(first_path(rows)), "path", "left_semi")  # one row


@query("WITH " + sql.RECORDS + f" SELECT id, {_PATH} AS path, coalesce(metadata['project_id'], '') AS project_id FROM rec WHERE {_PATH} = {_FIRST}")
def records_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the store holds of one path."""
    return at_path(records(spark, sf_dir)).select("id", "path", meta(F.col("metadata"), "project_id").alias("project_id"))


@query("WITH " + sql.RECORDS + f" SELECT arg_min(coalesce(metadata['hash'], ''), id) AS hash FROM rec WHERE {_PATH} = {_FIRST}")
def single_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored hash of one file, that of its first record."""
    return at_path(records(spark, sf_dir)).agg(F.min_by(meta(F.col("metadata"), "hash"), "id").alias("hash"))


@query("WITH " + sql.RECORDS + " SELECT id, coalesce(metadata['name'], '') AS name, coalesce(metadata['type'], '') AS type, sha256(coalesce(content, '')) AS hash FROM rec WHERE id IN (SELECT max(id) FROM records UNION ALL SELECT min(id) FROM records)")
def node_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q8: nodes by their id: the first and the last one of the store."""
    rows = records(spark, sf_dir)
    ends = rows.agg(F.array(F.min("id"), F.max("id")).alias("_ids")).select(F.explode("_ids").alias("id"))
    found = rows.join(F.broadcast(ends.distinct()), "id", "left_semi")  # two rows
    return found.select("id", meta(F.col("metadata"), "name").alias("name"), meta(F.col("metadata"), "type").alias("type"), F.sha2(F.coalesce("content", F.lit("")), 256).alias("hash"))


_MOST = "(SELECT metadata['project_id'] FROM records WHERE metadata['project_id'] <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


def largest_project(spark: SparkSession, sf_dir: str) -> str:
    project = meta(F.col("metadata"), "project_id")
    counts = table(spark, sf_dir, "records").where(project != "").groupBy(project.alias("p")).agg(F.count("*").alias("n"))
    row = counts.orderBy(F.desc("n"), "p").first()
    return row["p"] if row else ""


@query("WITH " + sql.RECORDS + f" SELECT id FROM rec WHERE coalesce(metadata['project_id'], '') <> {_MOST}")
def cleared_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store without its largest project."""
    return clear_project(records(spark, sf_dir), largest_project(spark, sf_dir)).select("id")


@query(
    "WITH " + sql.RECORDS + ", k AS (SELECT id FROM rec WHERE coalesce(metadata['project_id'], '') <> " + _MOST + "), "
    + sql.tokens("(SELECT rec_no, content FROM rec JOIN k USING (id))", "rec_no", "content") + " SELECT term, count(DISTINCT id) AS n_docs FROM toks GROUP BY term"
)
def cleared_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms that are left in the index when a project is cleared."""
    left = clear_project(records(spark, sf_dir), largest_project(spark, sf_dir))
    return lexical.postings(left, "rec_no", "content").groupBy("term").agg(F.count("*").alias("n_docs"))


@query(
    "WITH " + sql.RECORDS + ", new AS (SELECT DISTINCT 'context:' || project_id AS id, 'notes of ' || project_id AS content, 'manual_context' AS type FROM projects WHERE project_id IS NOT NULL) "
    "SELECT type, count(*) AS n, max(content) AS last FROM (SELECT coalesce(metadata['type'], '') AS type, NULL AS content FROM rec WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT type, content FROM new) GROUP BY 1"
)
def store_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note stored for each project, over the one there was."""
    notes = table(spark, sf_dir, "projects").where("project_id is not null").select(
        F.concat(F.lit("context:"), "project_id").alias("id"), F.lit("manual_context").alias("type"), F.concat(F.lit("notes of "), "project_id").alias("content")
    )
    store = records(spark, sf_dir).select("id", meta(F.col("metadata"), "type").alias("type"), F.lit(None).cast("string").alias("content"))
    return upsert(store, notes.distinct(), "id").groupBy("type").agg(F.count("*").alias("n"), F.max("content").alias("last"))


@query(
    "WITH " + sql.RECORDS + ", r AS (SELECT metadata['project_id'] AS project_id, count(*) AS n_records, count(DISTINCT nullif(metadata['path'], '')) AS n_files FROM rec GROUP BY 1), "
    "s AS (SELECT project_id, count(DISTINCT result_id) FILTER (WHERE err <> '') AS n_failed, count(DISTINCT result_id) FILTER (WHERE skipped) AS n_skipped FROM scan_results GROUP BY 1) "
    "SELECT p.project_id, coalesce(nullif(trim(status), ''), 'unknown') AS status, coalesce(n_records, 0) AS n_records, coalesce(n_files, 0) AS n_files, coalesce(n_failed, 0) AS n_failed, coalesce(n_skipped, 0) AS n_skipped "
    "FROM projects p LEFT JOIN r USING (project_id) LEFT JOIN s USING (project_id)"
)
def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q15: per project its status, what is stored, and the files that failed or were skipped."""
    project = meta(F.col("metadata"), "project_id").alias("project_id")
    stored = records(spark, sf_dir).groupBy(project).agg(F.count("*").alias("n_records"), F.countDistinct(F.nullif(meta(F.col("metadata"), "path"), F.lit(""))).alias("n_files"))
    scans = table(spark, sf_dir, "scan_results").groupBy("project_id").agg(
        F.countDistinct(F.when(F.col("err") != "", F.col("result_id"))).alias("n_failed"), F.countDistinct(F.when(F.col("skipped"), F.col("result_id"))).alias("n_skipped")
    )
    rows = table(spark, sf_dir, "projects").select("project_id", F.coalesce(F.nullif(F.trim("status"), F.lit("")), F.lit("unknown")).alias("status"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_records", "n_files", "n_failed", "n_skipped")]
    return rows.join(stored, "project_id", "left").join(scans, "project_id", "left").select("project_id", "status", *zero)


@query(_LINES + ", m AS (SELECT doc_id, line_no::INT AS line_no, trim(line, ' ') AS line FROM l WHERE contains(lower(line), 'the')) SELECT *, (SELECT count(*) FROM m) > 100 AS limit_reached FROM m ORDER BY doc_id, line_no LIMIT 100")
def grep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the first hundred matches in order, and whether there are more."""
    has = lambda c: F.contains(F.lower(c), F.lit("the"))
    found = analysis.grep(documents(spark, sf_dir), "text", ["doc_id"], has("line"), has("text"))
    return analysis.first_matches(found, ["doc_id", "line_no"], 100)


_ENTRY = " AND ".join(f"NOT contains(rel_path, '{p}')" for p in analysis.ENTRY_PATHS)


@query(f"WITH {_DEFS}, {_used('NOT', _NAMES)} SELECT project_id, rel_path, symbol FROM d{_ANTI} AND {_ENTRY}")
def dead_symbols_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unused symbols outside the usual entry points."""
    return analysis.dead_symbols(chunks(spark, sf_dir), analysis.ENTRY_PATHS)


@query(f"WITH {_DEFS}, {_used('NOT', _NAMES)} SELECT project_id, rel_path, symbol FROM d{_ANTI} AND (contains(rel_path, 'internal/') OR contains(rel_path, 'private/') OR regexp_matches(rel_path, '(^|/)_[^/]*$'))")
def dead_symbols_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unused symbols of a library, which may only be internal ones."""
    return analysis.dead_symbols(chunks(spark, sf_dir), analysis.ENTRY_PATHS, library=True)


_TOP_CALL = "(SELECT c FROM chunks, unnest(calls) AS u(c) WHERE c <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@query(
    f"WITH s AS (SELECT {_TOP_CALL} AS name), d AS (SELECT project_id, min(chunk_id) AS definition FROM chunks, s WHERE list_contains(symbols, name) GROUP BY 1) "
    "SELECT DISTINCT name, chunk_id, rel_path, definition FROM chunks CROSS JOIN s LEFT JOIN d USING (project_id) WHERE list_contains(list_concat(coalesce(calls, []), coalesce(relationships, [])), name)"
)
def impact_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q7: who uses the most called name, and where it is defined."""
    calls = chunks(spark, sf_dir).select(F.explode("calls").alias("c")).where("c <> ''").groupBy("c").agg(F.count("*").alias("n"))
    first = calls.orderBy(F.desc("n"), "c").first()
    return analysis.impact_radius(chunks(spark, sf_dir), first["c"] if first else "")


@query(_DOC_BM25 + " SELECT id AS doc_id, score FROM scored ORDER BY score DESC, id LIMIT 10")
def bm25_stored_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents from postings that were written sorted by term, and read back for the query's terms alone."""
    folder = scratch(spark, "postings")
    built = cut(lexical.postings(documents(spark, sf_dir), "doc_id", "text"))
    built.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.parquet(f"{folder}/postings")
    lexical.lengths_of(built, "doc_id").write.parquet(f"{folder}/lengths")
    stored, lengths = spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/lengths")
    return lexical.top(lexical.bm25_stored(stored, lengths, "doc_id", SEARCH), "doc_id", 10)



_STORE_DOCS = f"docs AS (SELECT rec_no, metadata, {sql.STORE_TEXT} AS text FROM rec WHERE coalesce(metadata['type'], '') NOT IN ('file_meta', 'project_status'))"


@query("WITH " + sql.RECORDS + ", " + _STORE_DOCS + ", " + sql.bm25("docs", "rec_no", "text", TERMS) + " SELECT id AS rec_no, score FROM scored")
def bm25_store_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores over names, paths, symbols and calls as well as the content."""
    rows = records(spark, sf_dir).where(~meta(F.col("metadata"), "type").isin("file_meta", "project_status"))
    return lexical.bm25(store_text(rows), "rec_no", "text", SEARCH)


@query(
    "WITH c AS (SELECT project_id, regexp_replace(rel_path, '/?[^/]*$', '') AS package, * EXCLUDE (project_id) FROM chunks WHERE project_id IS NOT NULL), "
    "d AS (SELECT DISTINCT project_id, package AS changed, unnest(symbols) AS name FROM c WHERE indexed_at >= TIMESTAMP '2025-06-01'), "
    "u AS (SELECT DISTINCT project_id, package, unnest(list_concat(coalesce(calls, []), coalesce(relationships, []))) AS name FROM c) "
    "SELECT project_id, package, count(DISTINCT changed) AS n_changed, count(DISTINCT name) AS n_names FROM u JOIN d USING (project_id, name) WHERE package <> changed GROUP BY 1, 2"
)
def redistill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q19, T5: packages that use a name which a package changed since a day defines."""
    rows = chunks(spark, sf_dir).where("project_id is not null").withColumn("package", F.regexp_replace("rel_path", r"/?[^/]*$", ""))
    changed = rows.where(F.col("indexed_at") >= F.lit("2025-06-01").cast("timestamp_ntz"))
    return analysis.dependents(rows, changed)


# The SQL of the chunk attributes spells its patterns out, apart from the operators' constants.
@query(
    "WITH " + _CHUNK + ", p AS (SELECT chunk_id, nullif(regexp_extract(content, '^// Context: ([^\\n]*?) -> ', 1), '') AS a, "
    "nullif(CASE WHEN ends_with(lower(rel_path), '.go') THEN regexp_extract(content, '(?m)^func\\s*\\(\\s*(?:[A-Za-z_][A-Za-z0-9_]*\\s+)?\\*?([A-Za-z_][A-Za-z0-9_]*)', 1) "
    "ELSE regexp_extract(content, '(?m)^[ \\t]*(?:export\\s+)?(?:default\\s+)?(?:abstract\\s+)?class\\s+([A-Za-z_$][A-Za-z0-9_$]*)', 1) END, '') AS b FROM ch WHERE content IS NOT NULL AND rel_path IS NOT NULL) "
    "SELECT chunk_id, coalesce(a, b, '') AS parent FROM p"
)
def parent_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: the class or receiver a chunk belongs to."""
    rows = one_chunk(spark, sf_dir).where("content is not null and rel_path is not null")
    return rows.select("chunk_id", detect.parent_symbol(F.col("rel_path"), F.col("content")).alias("parent"))


_DOC_SQL = "(?m)^((?:[ \\t]*(?://|#)[^\\n]*\\n)+)[ \\t]*(?:(?:export|default|pub|async|static|public|private|protected)\\s+)*(?:func|function|def|fn|class|struct|type|interface)\\s+(?:\\([^)\\n]*\\)\\s*)?([A-Za-z_][A-Za-z0-9_]*)"


@query(
    "WITH " + _CHUNK + ", b AS (SELECT chunk_id, regexp_replace(replace(content, chr(13) || chr(10), chr(10)), '^// Context: ([^\\n]*?) -> [^\\n]*\\n', '') AS t FROM ch), "
    f"x AS (SELECT chunk_id, unnest(regexp_extract_all(t, '{_DOC_SQL}', 1)) AS c, unnest(regexp_extract_all(t, '{_DOC_SQL}', 2)) AS name FROM b) "
    "SELECT chunk_id, name, trim(regexp_replace(c, '(?m)^[ \\t]*(?://+|#+)[ \\t]?', '', 'g'), chr(10)) AS docstring FROM x"
)
def docstrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions with the comment right above them."""
    return detect.documented(one_chunk(spark, sf_dir), "chunk_id", "content")


@query(
    "WITH " + _CHUNK + ", s AS (SELECT chunk_id, unnest(regexp_extract_all(content, '\\bstruct\\s*\\{([^{}]*)\\}', 1)) AS b FROM ch), i AS (SELECT chunk_id, unnest(regexp_extract_all(content, '\\binterface\\s*\\{([^{}]*)\\}', 1)) AS b FROM ch), "
    "f AS (SELECT chunk_id, unnest(regexp_extract_all(b, '(?m)^[ \\t]+([A-Za-z_][A-Za-z0-9_]*)[ \\t]+([*\\[\\]A-Za-z_][A-Za-z0-9_.*\\[\\]]*)', 1)) AS n, unnest(regexp_extract_all(b, '(?m)^[ \\t]+([A-Za-z_][A-Za-z0-9_]*)[ \\t]+([*\\[\\]A-Za-z_][A-Za-z0-9_.*\\[\\]]*)', 2)) AS t FROM s), "
    "m AS (SELECT chunk_id, unnest(regexp_extract_all(b, '(?m)^[ \\t]+([A-Za-z_][A-Za-z0-9_]*)\\(', 1)) AS n FROM i) "
    "SELECT DISTINCT chunk_id, 'field:' || n AS key, t AS value FROM f UNION SELECT chunk_id, 'method:' || n, 'defined' FROM m"
)
def structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields and methods of structs and interfaces."""
    return detect.structure(one_chunk(spark, sf_dir), "chunk_id", "content")


_WANTED = ", ".join(f"'{w}'" for w in sorted({w.lower() for w in SEARCH.split()}))


@query(
    _DOC_BM25 + ", t AS (SELECT id, score, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '') AS ws FROM scored JOIN documents ON doc_id = id ORDER BY score DESC, id LIMIT 30), "
    f"r AS (SELECT id, score, len(list_filter(ws, lambda w: w IN ({_WANTED}))) / {len(set(SEARCH.lower().split()))} AS o, max(score) OVER () AS ms FROM t), "
    "z AS (SELECT *, max(o) OVER () AS mo FROM r) SELECT id AS doc_id, round(0.5 * score / ms + 0.5 * CASE WHEN mo > 0 THEN o / mo ELSE 0 END, 6) AS reranked FROM z ORDER BY reranked DESC, id LIMIT 10"
)
def rerank_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H7: a search's result through a pluggable re-ranker, here the overlap of words."""
    docs = documents(spark, sf_dir)
    best = lexical.top(lexical.bm25(docs, "doc_id", "text", SEARCH), "doc_id", 30).join(docs.select("doc_id", "text"), "doc_id")
    return hooks.rerank(best, "doc_id", "text", "score", lambda text: word_overlap(SEARCH, text), 10).select("doc_id", "reranked")


@query(
    "SELECT doc_id, analyzer, finding FROM (SELECT doc_id, 'issue' AS analyzer, unnest(regexp_extract_all(text, '[A-Z]{2,}-\\d+')) AS finding FROM documents "
    "UNION ALL SELECT doc_id, 'url', unnest(regexp_extract_all(text, 'https?://[A-Za-z0-9./_-]+')) FROM documents)"
)
def analyzer_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of pluggable analyzers."""
    found = {
        "issue": lambda t: F.regexp_extract_all(t, F.lit(r"([A-Z]{2,}-\d+)"), F.lit(1)),
        "url": lambda t: F.regexp_extract_all(t, F.lit(r"(https?://[A-Za-z0-9./_-]+)"), F.lit(1)),
    }
    return hooks.analyze(documents(spark, sf_dir), ["doc_id"], found, "text")


_ROUTE_TERMS = ", ".join(f"('{w}', '{t}', {lexical.query_terms(w).count(t)})" for w in lexical.ROUTE_KEYWORDS for t in dict.fromkeys(lexical.query_terms(w)))


@query(
    "WITH " + sql.RECORDS + ", " + _STORE_DOCS + ", " + sql.tokens("docs", "rec_no", "text") + ", per AS (SELECT id, count(*) AS dl FROM toks GROUP BY id), stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM per), "
    f"k(kw, term, w) AS (VALUES {_ROUTE_TERMS}), tf AS (SELECT id, term, count(*) AS tf FROM toks WHERE term IN (SELECT term FROM k) GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), "
    "s AS (SELECT id, kw, round(sum(w * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN df USING (term) JOIN k USING (term) JOIN per USING (id), stats GROUP BY 1, 2), "
    "b AS (SELECT id, kw, score FROM s JOIN docs ON rec_no = id WHERE score > 0 AND metadata['category'] = 'code' QUALIFY row_number() OVER (PARTITION BY kw ORDER BY score DESC, id) <= 20) "
    "SELECT coalesce(metadata['path'], '') AS path, coalesce(metadata['start_line'], '') AS start_line, max(score) AS score, max(rec_no) AS rec_no FROM b JOIN docs ON rec_no = id GROUP BY 1, 2"
)
def api_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code that the route keywords find in the store, once per path and line."""
    m = F.col("metadata")
    rows = records(spark, sf_dir).where(~meta(m, "type").isin("file_meta", "project_status"))
    code = rows.where(meta(m, "category") == "code").select("rec_no", meta(m, "path").alias("path"), meta(m, "start_line").alias("start_line"))
    found = lexical.keyword_search(store_text(rows), "rec_no", "text", lexical.ROUTE_KEYWORDS, 20, code)
    return found.join(code, "rec_no").groupBy("path", "start_line").agg(F.max("score").alias("score"), F.max("rec_no").alias("rec_no"))
