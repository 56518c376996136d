"""Registered queries: detectors, definitions, sections of results, status changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import truncate_runes
from ..operators import detect, lexical
from ..operators.records import meta, set_status
from ..session import table
from . import sql
from .catalogue import query
from .code import _CHUNK, one_chunk
from .retrieval import SEARCH, TERMS, documents, records


def _quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_EXT = "lower(regexp_extract(coalesce(path, ''), '\\.([A-Za-z0-9]+)$', 1))"
_SIGNS = " + ".join(f"contains(lower(coalesce(text, '')), '{s}')::INT" for s in detect.CODE_SIGNS)
_LANG = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in detect.LANGUAGES.items()) + "}"


@query(
    f"SELECT doc_id, coalesce(({_LANG})[{_EXT}], '') AS language, CASE WHEN {_EXT} IN ({_quoted([k for k in detect.LANGUAGES if k != 'cxx'])}) THEN 'code' "
    f"WHEN {_EXT} IN ({_quoted(detect.DOC_ENDINGS)}) THEN 'documentation' WHEN {_EXT} IN ({_quoted(detect.CONFIG_ENDINGS)}) THEN 'config' WHEN {_SIGNS} >= 2 THEN 'code' ELSE 'general' END AS content_type FROM documents"
)
def content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """language and content type of each document."""
    path = F.coalesce("path", F.lit(""))
    return documents(spark, sf_dir).select("doc_id", detect.language(path).alias("language"), detect.content_type(path, F.col("text")).alias("content_type"))


_CALLS = f"list_sort(list_distinct(list_filter(regexp_extract_all(content, '([A-Za-z_][A-Za-z0-9_]*)\\(', 1), lambda x: x NOT IN ({_quoted(detect.CONTROL_WORDS)}))))"


@query("WITH " + _CHUNK + f" SELECT chunk_id, array_to_string({_CALLS}, ' ') AS calls FROM ch WHERE content IS NOT NULL")
def extracted_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names called in each chunk."""
    return one_chunk(spark, sf_dir).where("content is not null").select("chunk_id", F.array_join(detect.calls(F.col("content")), " ").alias("calls"))


_DEF = detect.DEFINITION.replace("'", "''")


@query(
    f"WITH p AS (SELECT doc_id, string_split(regexp_replace(text, '{_DEF}', chr(1) || '\\1', 'g'), chr(1)) AS parts FROM documents WHERE length(text) > 0), "
    "e AS (SELECT doc_id, unnest(parts) AS content, generate_subscripts(parts, 1) - 1 AS chunk_no FROM p), "
    "l AS (SELECT *, coalesce(sum(length(content) - length(replace(content, chr(10), ''))) OVER (PARTITION BY doc_id ORDER BY chunk_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS start_line FROM e) "
    f"SELECT doc_id, chunk_no::INT AS chunk_no, start_line::INT AS start_line, sha256(content) AS hash, len({_CALLS})::INT AS n_calls FROM l WHERE length(content) > 0"
)
def definition_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut where top-level definitions begin."""
    found = detect.definition_chunks(documents(spark, sf_dir), "doc_id", "text")
    return found.select("doc_id", "chunk_no", "start_line", F.sha2("content", 256).alias("hash"), F.size("calls").alias("n_calls"))


@query(
    "WITH " + sql.bm25("documents", "doc_id", "text", TERMS) + ", j AS (SELECT id AS doc_id, score, CASE WHEN source = 'code_scan' THEN 'code' ELSE 'document' END AS section "
    "FROM scored JOIN documents d ON d.doc_id = scored.id) SELECT doc_id, section, score FROM j QUALIFY row_number() OVER (PARTITION BY section ORDER BY score DESC, doc_id) <= CASE WHEN section = 'code' THEN 10 ELSE 5 END"
)
def verification_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents and the best code for one question, as sections."""
    docs = documents(spark, sf_dir).select("doc_id", "text", F.when(F.col("source") == "code_scan", "code").otherwise("document").alias("section"))
    scored = lexical.bm25(docs, "doc_id", "text", SEARCH).join(docs.select("doc_id", "section"), "doc_id")
    code = lexical.top(scored.where("section = 'code'"), "doc_id", 10)
    return code.unionByName(lexical.top(scored.where("section = 'document'"), "doc_id", 5)).select("doc_id", "section", "score")


@query(
    "WITH " + sql.bm25("documents", "doc_id", "text", TERMS) + ", b AS (SELECT id, score, text FROM (SELECT * FROM scored ORDER BY score DESC, id LIMIT 5) s JOIN documents d ON d.doc_id = s.id), "
    "t AS (SELECT string_agg(text, chr(10) || chr(10) ORDER BY score DESC, id) AS text FROM b) SELECT CASE WHEN length(text) > 12000 THEN left(text, 12000) || '...' ELSE text END AS text FROM t"
)
def summarized_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of the best five, joined in rank order and cut."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    best = lexical.top(lexical.bm25(docs, "doc_id", "text", SEARCH), "doc_id", 5).join(docs, "doc_id")
    listed = best.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "doc_id", "text"))).alias("l"))
    return listed.select(truncate_runes(F.array_join(F.transform("l", lambda x: x["text"]), "\n\n"), 12000).alias("text"))


@query(
    "WITH " + sql.RECORDS + ", s AS (SELECT project_id, status, created_at AS changed FROM projects UNION ALL SELECT metadata['project_id'], content, indexed_at FROM rec WHERE metadata['type'] = 'project_status') "
    "SELECT project_id, status FROM s QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY changed DESC NULLS LAST, status DESC NULLS LAST) = 1"
)
def status_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One status per project, status records put over the table's."""
    old = table(spark, sf_dir, "projects").select("project_id", "status", F.col("created_at").alias("at"))
    rows = records(spark, sf_dir).where(meta(F.col("metadata"), "type") == "project_status")
    new = rows.select(F.try_element_at("metadata", F.lit("project_id")).alias("project_id"), F.col("content").alias("status"), F.col("indexed_at").alias("at"))
    return set_status(old, new).select("project_id", "status")
