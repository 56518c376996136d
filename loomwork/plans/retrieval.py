"""Registered queries: lexical, vector and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fnv32a, fragments, token_estimate, truncate_runes, words
from ..operators import fusion, lexical, vector
from ..operators.records import latest, meta, under
from ..session import table
from . import sql
from .catalogue import query

SEARCH = "rebuild snapshotIndex cluster budget"
TERMS = lexical.query_terms(SEARCH)
NOW = 1767225600
DIM = 64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last version of each record."""
    return latest(table(spark, sf_dir, "records"), ["id"], ["indexed_at", "rec_no"])


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).where(vector.usable(F.col("embedding"), DIM))


def store_text(rows: DataFrame) -> DataFrame:
    """Records with what is indexed of them: content, name, path, symbols and calls."""
    m = F.col("metadata")
    return rows.select("rec_no", lexical.document_text(F.col("content"), meta(m, "name"), meta(m, "path"), meta(m, "symbols"), meta(m, "calls")).alias("text"))


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of the usable record with the smallest number."""
    return list(vectors(spark, sf_dir).orderBy("rec_no").select("embedding").first()[0])


_DOC_BM25 = "WITH " + sql.bm25("documents", "doc_id", "text", TERMS)


@query(_DOC_BM25 + " SELECT id AS doc_id, score FROM scored ORDER BY score DESC, id LIMIT 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents by BM25."""
    return lexical.top(lexical.bm25(documents(spark, sf_dir), "doc_id", "text", SEARCH), "doc_id", 10)


@query(_DOC_BM25 + " SELECT id AS doc_id, score FROM scored")
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document that has a query term."""
    return lexical.bm25(documents(spark, sf_dir), "doc_id", "text", SEARCH)


@query("WITH " + sql.bm25("documents", "doc_id", "text", ["budget", "budget", "cluster"]) + " SELECT id AS doc_id, score FROM scored ORDER BY score DESC, id LIMIT 20")
def bm25_dup_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repeated query term counts twice."""
    return lexical.top(lexical.bm25(documents(spark, sf_dir), "doc_id", "text", "budget budget cluster"), "doc_id", 20)


@query(
    _DOC_BM25 + ", best AS (SELECT * FROM scored ORDER BY score DESC, id LIMIT 60) "
    "SELECT doc_id, score, source FROM best JOIN documents d ON d.doc_id = best.id WHERE source = 'repo_docs' ORDER BY score DESC, doc_id LIMIT 20"
)
def bm25_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over-fetch on the whole corpus, then filter and cut."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return lexical.lexical_search(docs, "doc_id", "text", SEARCH, 20, F.col("source") == "repo_docs").select("doc_id", "score", "source")


@query("WITH " + sql.tokens("documents", "doc_id", "text") + " SELECT term, count(*) AS cf, count(DISTINCT id) AS df FROM toks GROUP BY term")
def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2, A1: collection and document frequency of every term."""
    return lexical.postings(documents(spark, sf_dir), "doc_id", "text").groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))


@query("WITH " + sql.tokens("documents", "doc_id", "text") + " SELECT term, id AS doc_id, count(*) AS tf FROM toks GROUP BY ALL")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4: the inverted index."""
    return lexical.postings(documents(spark, sf_dir), "doc_id", "text")


@query(
    "WITH " + sql.tokens("documents", "doc_id", "text") + ", per AS (SELECT id, count(*) AS dl FROM toks GROUP BY id) SELECT count(*) AS n, round(avg(dl), 6) AS avgdl FROM per"
)
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed documents and their mean length."""
    return lexical.corpus_stats(documents(spark, sf_dir), "doc_id", "text").select("n", F.round("avgdl", 6).alias("avgdl"))


@query(
    "WITH " + sql.tokens("(SELECT * FROM documents WHERE source IS DISTINCT FROM 'code_scan')", "doc_id", "text")
    + ", per AS (SELECT id, count(*) AS dl FROM toks GROUP BY id) SELECT count(*) AS n, round(avg(dl), 6) AS avgdl FROM per"
)
def corpus_stats_after_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics once a source is removed from the index."""
    left = documents(spark, sf_dir).where(~F.col("source").eqNullSafe("code_scan"))
    return lexical.corpus_stats(left, "doc_id", "text").select("n", F.round("avgdl", 6).alias("avgdl"))


@query(
    "WITH r AS (SELECT DISTINCT unnest(symbols) AS raw FROM chunks) SELECT raw AS symbol, "
    f"array_to_string({sql.FRAGMENTS}, ' ') AS parts FROM r WHERE raw <> '' AND raw IS NOT NULL"
)
def identifier_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: every symbol of the chunks and its parts."""
    raw = table(spark, sf_dir, "chunks").select(F.explode("symbols").alias("symbol")).where("symbol <> ''").distinct()
    return raw.select("symbol", F.array_join(fragments(F.col("symbol")), " ").alias("parts"))


@query(
    "WITH "
    + sql.bm25(
        f"(SELECT rec_no, {sql.STORE_TEXT} AS text FROM (SELECT * FROM records QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC NULLS LAST, rec_no DESC NULLS LAST) = 1) "
        "WHERE coalesce(metadata['type'], '') NOT IN ('file_meta', 'project_status'))",
        "rec_no", "text", TERMS,
    )
    + " SELECT id AS rec_no, score FROM scored ORDER BY score DESC, id LIMIT 25"
)
def bm25_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L8 over the store without bookkeeping rows."""
    rows = records(spark, sf_dir).where(~meta(F.col("metadata"), "type").isin("file_meta", "project_status"))
    return lexical.top(lexical.bm25(store_text(rows), "rec_no", "text", SEARCH), "rec_no", 25)


@query(
    "WITH " + sql.bm25("chunks", "chunk_id", "content", ["router"], "a")
    + " SELECT id AS chunk_id, score FROM (SELECT * FROM a ORDER BY score DESC, id LIMIT 20)"
)
def endpoint_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One keyword of the route search over the chunks."""
    found = lexical.keyword_search(table(spark, sf_dir, "chunks"), "chunk_id", "content", ["router"], 20)
    return found.select("chunk_id", "score")


_ROUTES = ["router", "handler", "gateway", "server"]


@query(
    "WITH " + sql.tokens("chunks", "chunk_id", "content") + ", per AS (SELECT id, count(*) AS dl FROM toks GROUP BY id), stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM per), "
    f"tf AS (SELECT id, term, count(*) AS tf FROM toks WHERE term IN ({', '.join(repr(w) for w in _ROUTES)}) GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), "
    "s AS (SELECT id, term, round(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score FROM tf JOIN df USING (term) JOIN per USING (id), stats), "
    "b AS (SELECT * FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY term ORDER BY score DESC, id) <= 20) "
    "SELECT id AS chunk_id, max(score) AS score, array_to_string(list_sort(list(term)), ' ') AS keywords FROM b GROUP BY id"
)
def endpoint_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best chunks of several route keywords, each once."""
    found = lexical.keyword_search(table(spark, sf_dir, "chunks"), "chunk_id", "content", _ROUTES, 20)
    return found.select("chunk_id", "score", F.array_join("keywords", " ").alias("keywords"))


_VQ = "WITH " + sql.RECORDS + ", " + sql.VECTORS + ", q AS (SELECT v AS qv FROM vec ORDER BY rec_no LIMIT 1)"
_PRIO = "coalesce(try_cast(metadata['priority'] AS FLOAT)::DOUBLE, 1)"


@query(_VQ + f", s AS (SELECT rec_no, round({sql.COSINE}, 6) AS similarity FROM vec, q) SELECT * FROM s ORDER BY similarity DESC, rec_no LIMIT 10")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1, V2: the 10 most similar records of a vector."""
    return vector.search(records(spark, sf_dir), "rec_no", "embedding", query_vector(spark, sf_dir), 10, DIM).select("rec_no", "similarity")


@query(
    _VQ + f", s AS (SELECT rec_no, round({sql.COSINE}, 6) AS similarity, {_PRIO} AS p FROM vec, q), "
    "b AS (SELECT rec_no, similarity, round(similarity * p, 6) AS boosted FROM s ORDER BY similarity DESC, rec_no LIMIT 50) SELECT * FROM b"
)
def vector_topk_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: cut first, boost by priority afterwards."""
    boost = fusion.number_or(meta(F.col("metadata"), "priority"))
    return vector.search(records(spark, sf_dir), "rec_no", "embedding", query_vector(spark, sf_dir), 50, DIM, boost)


@query(
    _VQ + f", s AS (SELECT rec_no, metadata['project_id'] AS project_id, round({sql.COSINE}, 6) AS similarity FROM vec, q WHERE metadata['category'] = 'code' "
    "AND metadata['project_id'] IN (SELECT metadata['project_id'] FROM rec WHERE metadata['project_id'] <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)) "
    "SELECT * FROM s ORDER BY similarity DESC, rec_no LIMIT 20"
)
def vector_topk_multi_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """category and several projects, one top-k over all of them."""
    rows = records(spark, sf_dir).withColumn("project_id", meta(F.col("metadata"), "project_id"))
    most = rows.where("project_id <> ''").groupBy("project_id").count().orderBy(F.desc("count"), "project_id").limit(3)
    picked = rows.where(meta(F.col("metadata"), "category") == "code").join(F.broadcast(most.select("project_id")), "project_id", "left_semi")
    found = vector.search(picked, "rec_no", "embedding", query_vector(spark, sf_dir), 20, DIM)
    return found.join(picked.select("rec_no", "project_id"), "rec_no").select("rec_no", "project_id", "similarity")


@query(
    "WITH " + sql.RECORDS + ", " + sql.VECTORS + " SELECT rec_no, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, round(v[64] / sqrt(list_dot_product(v, v)), 6) AS last FROM vec"
)
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: unit vectors."""
    unit = vector.l2_normalize(F.col("embedding"))
    return vectors(spark, sf_dir).select("rec_no", unit.alias("u")).select("rec_no", F.round(F.col("u")[0], 6).alias("first"), F.round(F.col("u")[63], 6).alias("last"))


@query(
    "WITH " + sql.RECORDS + f", vec AS (SELECT rec_no, list_transform(embedding[1:16], lambda x: x::DOUBLE) AS v FROM rec WHERE {sql.USABLE}), "
    f"q AS (SELECT v AS qv FROM vec ORDER BY rec_no LIMIT 1), s AS (SELECT rec_no, round({sql.COSINE}, 6) AS similarity FROM vec, q) "
    "SELECT * FROM s ORDER BY similarity DESC NULLS LAST, rec_no LIMIT 10"
)
def matryoshka_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: search by the first 16 entries, normalised again."""
    rows = vectors(spark, sf_dir).withColumn("short", vector.matryoshka(F.col("embedding"), 16))
    return vector.search(rows, "rec_no", "short", query_vector(spark, sf_dir)[:16], 10, 16).select("rec_no", "similarity")


@query("SELECT coalesce(len(embedding), -1)::INT AS width, count(*) AS n FROM records GROUP BY 1")
def dim_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: widths of the stored vectors."""
    width = F.when(F.col("embedding").isNull(), -1).otherwise(F.size("embedding"))
    return table(spark, sf_dir, "records").groupBy(width.cast("int").alias("width")).agg(F.count("*").alias("n"))


@query(
    "WITH " + sql.RECORDS + ", " + sql.VECTORS + ", p AS (SELECT a.rec_no AS query, b.rec_no AS neighbor, "
    "round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS similarity FROM vec a, vec b "
    "WHERE a.rec_no % 100 = 0 AND a.rec_no <> b.rec_no) SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbor) <= 5"
)
def duplicate_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6, Q10: a stated query set (numbers divisible by 100) against all records, 5 nearest each."""
    rows = vectors(spark, sf_dir)
    return vector.nearest_of_queries(rows, rows.where("rec_no % 100 = 0"), "rec_no", "embedding", DIM, 5)


@query(
    "WITH " + sql.RECORDS + " SELECT id FROM rec WHERE metadata['category'] = 'code' AND metadata['type'] = 'chunk' ORDER BY id LIMIT 50"
)
def category_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7: the first 50 ids of a category, without a vector."""
    rows = records(spark, sf_dir).where((meta(F.col("metadata"), "category") == "code") & (meta(F.col("metadata"), "type") == "chunk"))
    return rows.select("id").orderBy("id").limit(50)


def _legs(spark: SparkSession, sf_dir: str, text: str, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = records(spark, sf_dir).where(~meta(F.col("metadata"), "type").isin("file_meta", "project_status"))
    boost = fusion.number_or(meta(F.col("metadata"), "priority"))
    v = vector.search(rows, "rec_no", "embedding", query_vector(spark, sf_dir), 2 * k, DIM, boost)
    return rows, v, lexical.top(lexical.bm25(store_text(rows), "rec_no", "text", text), "rec_no", 2 * k)


def _legs_sql(terms: list[str], k: int) -> str:
    body = f"(SELECT rec_no, {sql.STORE_TEXT} AS text FROM ({sql.RECORDS.split(' AS ', 1)[1][1:-1]}) WHERE coalesce(metadata['type'], '') NOT IN ('file_meta', 'project_status'))"
    return (
        f"WITH {sql.RECORDS}, {sql.VECTORS}, q AS NOT MATERIALIZED (SELECT v AS qv FROM vec ORDER BY rec_no LIMIT 1), "
        + sql.bm25(body, "rec_no", "text", terms).replace("q(term, w)", "qt(term, w)").replace("JOIN q USING", "JOIN qt USING")
        + f", vs AS (SELECT rec_no, round({sql.COSINE}, 6) AS similarity, {_PRIO} AS p FROM vec, q WHERE coalesce(metadata['type'], '') NOT IN ('file_meta', 'project_status')), "
        f"vb AS (SELECT rec_no, similarity, round(similarity * p, 6) AS boosted FROM vs ORDER BY similarity DESC, rec_no LIMIT {2 * k}), "
        "vr AS (SELECT rec_no, similarity, row_number() OVER (ORDER BY boosted DESC, rec_no) AS vec_rank FROM vb), "
        f"lb AS (SELECT id AS rec_no, score FROM scored ORDER BY score DESC, id LIMIT {2 * k}), "
        "lr AS (SELECT rec_no, row_number() OVER (ORDER BY score DESC, rec_no) AS lex_rank FROM lb)"
    )


def _rrf_sql(weight: float) -> str:
    return (
        ", f AS (SELECT coalesce(vr.rec_no, lr.rec_no) AS rec_no, vec_rank, lex_rank, similarity, "
        f"coalesce(1.0::DOUBLE / (60 + vec_rank), 0) + coalesce({weight}::DOUBLE / (60 + lex_rank), 0) AS rrf FROM vr FULL JOIN lr ON vr.rec_no = lr.rec_no)"
    )


@query(_legs_sql(lexical.query_terms("budget cluster"), 20) + _rrf_sql(1.0) + " SELECT rec_no, vec_rank::INT AS vec_rank, lex_rank::INT AS lex_rank, round(rrf, 8) AS rrf FROM f")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1, H5: both lists fused by reciprocal ranks."""
    _, v, x = _legs(spark, sf_dir, "budget cluster", 20)
    return fusion.rrf(v, x, "rec_no", "budget cluster").select("rec_no", "vec_rank", "lex_rank", F.round("rrf", 8).alias("rrf"))


@query(_legs_sql(TERMS, 20) + _rrf_sql(1.5) + " SELECT rec_no, vec_rank::INT AS vec_rank, lex_rank::INT AS lex_rank, round(rrf, 8) AS rrf FROM f")
def rrf_identifier_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query with an identifier gives the lexical list more weight."""
    _, v, x = _legs(spark, sf_dir, SEARCH, 20)
    return fusion.rrf(v, x, "rec_no", SEARCH).select("rec_no", "vec_rank", "lex_rank", F.round("rrf", 8).alias("rrf"))


_HYBRID = (
    _legs_sql(TERMS, 20) + _rrf_sql(1.5) + ", h AS (SELECT f.rec_no, content, metadata, round(rrf * coalesce(try_cast(metadata['function_score'] AS FLOAT)::DOUBLE, 1) * "
    f"{_PRIO} * CASE WHEN metadata['category'] = 'document' AND try_cast(metadata['updated_at'] AS DOUBLE) IS NOT NULL THEN 1 + 0.5 * pow(2.0, "
    f"-greatest(({NOW} - try_cast(metadata['updated_at'] AS DOUBLE)) / 86400.0, 0) / 14) ELSE 1 END, 8) AS score FROM f JOIN rec USING (rec_no))"
)


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, v, x = _legs(spark, sf_dir, SEARCH, 20)
    fused = fusion.rrf(v, x, "rec_no", SEARCH).join(rows.select("rec_no", "content", "metadata"), "rec_no")
    m = F.col("metadata")
    return fusion.boosted(fused, meta(m, "category"), meta(m, "function_score"), meta(m, "priority"), meta(m, "updated_at"), NOW)


@query(_HYBRID + " SELECT rec_no, score FROM h ORDER BY score DESC, rec_no LIMIT 20")
def hybrid_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1-H5: fusion with function score, recency and priority, cut to 20."""
    return lexical.top(hybrid(spark, sf_dir), "rec_no", 20).select("rec_no", "score")


@query(
    _HYBRID + r", b AS (SELECT *, list_filter(regexp_split_to_array(lower(content), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM (SELECT * FROM (SELECT * FROM h ORDER BY score DESC, rec_no LIMIT 40) "
    "WHERE contains(coalesce(metadata['path'], ''), '.ts') ORDER BY score DESC, rec_no LIMIT 20)) "
    "SELECT rec_no, round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: x IN ('rebuild', 'snapshotindex', 'cluster', 'budget'))) / 4.0 ELSE score END, 6) AS rerank FROM b"
)
def hybrid_path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The path filter comes after the retrieval, and the re-ranking after the filter."""
    best = lexical.top(hybrid(spark, sf_dir), "rec_no", 40)
    kept = lexical.top(best.where(F.contains(meta(F.col("metadata"), "path"), F.lit(".ts"))), "rec_no", 20)
    return fusion.overlap_rerank(kept, "rec_no", "content", SEARCH).select("rec_no", "rerank")


@query(
    _HYBRID + r", b AS (SELECT *, list_filter(regexp_split_to_array(lower(content), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM (SELECT * FROM h ORDER BY score DESC, rec_no LIMIT 20)) "
    "SELECT rec_no, round(CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: x IN ('rebuild', 'snapshotindex', 'cluster', 'budget'))) / 4.0 ELSE score END, 6) AS rerank FROM b"
)
def overlap_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H9: re-rank by word overlap."""
    best = lexical.top(hybrid(spark, sf_dir), "rec_no", 20)
    return fusion.overlap_rerank(best, "rec_no", "content", SEARCH).select("rec_no", "rerank")


_ADAPT = (
    _DOC_BM25 + ", b AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank, round(lag(score) OVER (ORDER BY score DESC, id) - score, 9) AS gap "
    "FROM (SELECT * FROM scored ORDER BY score DESC, id LIMIT 60)), c AS (SELECT *, max(CASE WHEN rank > 5 AND gap >= 0.1 THEN 1 ELSE 0 END) OVER (ORDER BY rank) AS stop FROM b)"
)


@query(_ADAPT + " SELECT id AS doc_id, score, rank::INT AS rank FROM c WHERE stop = 0 AND rank <= 32")
def adaptive_rerank_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of the list until the score falls by 0.1."""
    best = lexical.top(lexical.bm25(documents(spark, sf_dir), "doc_id", "text", SEARCH), "doc_id", 60)
    return fusion.adaptive_cut(best, "doc_id", "score")


@query(
    _legs_sql(TERMS, 20) + " SELECT rec_no, round(0.4::DOUBLE * coalesce(similarity, 0) + 0.5::DOUBLE * coalesce(score, 0), 6) AS blend FROM vb FULL JOIN lb USING (rec_no)"
)
def score_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic and re-ranker scores joined by id, then weighted."""
    _, v, x = _legs(spark, sf_dir, SEARCH, 20)
    both = v.select("rec_no", "similarity").join(x.select("rec_no", "score"), "rec_no", "full").na.fill(0.0, ["similarity", "score"])
    return fusion.score_blend(both, "similarity", "score").select("rec_no", "blend")


@query("SELECT doc_id, coalesce(floor(len(" + sql.WORDS.format("text") + ") * 4 / 3), 0)::BIGINT AS tokens FROM documents")
def token_estimate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words times 4/3."""
    return documents(spark, sf_dir).select("doc_id", token_estimate(F.col("text")).alias("tokens"))


_BUDGET = (
    _DOC_BM25 + ", b AS (SELECT id AS doc_id, score, source, coalesce(floor(len(" + sql.WORDS.format("text") + ") * 4 / 3), 0)::BIGINT AS tokens "
    "FROM (SELECT * FROM scored ORDER BY score DESC, id LIMIT 100) s JOIN documents d ON d.doc_id = s.id)"
)


@query(_BUDGET + ", u AS (SELECT doc_id, tokens, sum(tokens) OVER (ORDER BY score DESC, doc_id)::BIGINT AS used FROM b) SELECT * FROM u WHERE used <= 4000")
def token_budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results in rank order until the budget is spent."""
    best = lexical.top(lexical.bm25(documents(spark, sf_dir), "doc_id", "text", SEARCH), "doc_id", 100).join(documents(spark, sf_dir).select("doc_id", "text"), "doc_id")
    return fusion.budget_prefix(best, "text", [F.desc("score"), F.asc("doc_id")], 4000).select("doc_id", "tokens", "used")


@query(
    _BUDGET.replace("WITH ", "WITH RECURSIVE ", 1)
    + ", r AS (SELECT coalesce(source, '-') AS source, doc_id, tokens, row_number() OVER (PARTITION BY coalesce(source, '-') ORDER BY score DESC, doc_id) AS rank FROM b), "
    "g AS (SELECT source, 0::BIGINT AS rank, 0::BIGINT AS used, ''::VARCHAR AS taken FROM (SELECT DISTINCT source FROM r) UNION ALL "
    "SELECT g.source, r.rank, CASE WHEN g.used + tokens <= 1200 THEN g.used + tokens ELSE g.used END, CASE WHEN g.used + tokens <= 1200 THEN g.taken || doc_id || ' ' ELSE g.taken END "
    "FROM g JOIN r ON r.source = g.source AND r.rank = g.rank + 1) SELECT source, used, trim(taken) AS taken FROM g QUALIFY row_number() OVER (PARTITION BY source ORDER BY rank DESC) = 1"
)
def token_budget_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First fit per source over the ranked results."""
    best = lexical.top(lexical.bm25(documents(spark, sf_dir), "doc_id", "text", SEARCH), "doc_id", 100)
    rows = best.join(documents(spark, sf_dir).select("doc_id", "text", F.coalesce("source", F.lit("-")).alias("source")), "doc_id")
    rows = rows.withColumn("rank", F.struct((-F.col("score")).alias("s"), "doc_id"))
    return fusion.budget_greedy(rows, "doc_id", "text", "rank", 1200, "source").select("source", "used", F.array_join("taken", " ").alias("taken"))


@query("SELECT doc_id, CASE WHEN length(text) > 1000 THEN left(text, 1000) || '...' ELSE text END AS text FROM documents")
def truncate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 1,000 code points."""
    return documents(spark, sf_dir).select("doc_id", truncate_runes(F.col("text"), 1000).alias("text"))


@query(
    "WITH " + sql.RECORDS + ", h AS (SELECT rec_no, list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(content, ''))), '..'), lambda x: ('0x' || x)::BIGINT), lambda a, x: (xor(a, x) * 16777619) & 4294967295, 2166136261::BIGINT) AS h FROM rec) "
    "SELECT rec_no, h, list_transform(range(0, 8), lambda i: ((h + i * 31) % 4294967296 % 1000) / 1000.0::DOUBLE) AS v FROM h"
)
def embed_fnv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§2.13: a deterministic embedder as a column expression, 8 wide, from a hash of each text."""
    h = fnv32a(F.coalesce("content", F.lit("")))
    rows = records(spark, sf_dir)
    v = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: ((F.col("h") + i * 31) % 4294967296 % 1000) / 1000.0)
    return rows.select("rec_no", h.alias("h")).select("rec_no", "h", v.alias("v"))


@query("WITH " + sql.RECORDS + " SELECT metadata['type'] AS kind, count(*) AS n FROM rec GROUP BY 1")
def record_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by kind, bookkeeping included."""
    return records(spark, sf_dir).groupBy(F.try_element_at("metadata", F.lit("type")).alias("kind")).agg(F.count("*").alias("n"))


@query(
    "WITH " + sql.RECORDS + " SELECT id, metadata['path'] AS path FROM rec WHERE metadata['path'] = 'src' OR starts_with(metadata['path'], 'api/')"
)
def prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and paths below a prefix."""
    rows = records(spark, sf_dir).select("id", F.try_element_at("metadata", F.lit("path")).alias("path"))
    return rows.where((F.col("path") == "src") | under(F.col("path"), "api"))


@query(
    "WITH " + sql.RECORDS + " SELECT metadata['project_id'] AS project_id, metadata['path'] AS path, max(metadata['hash']) AS hash FROM rec WHERE metadata['type'] = 'file_meta' GROUP BY 1, 2"
)
def path_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path to hash of the indexed files."""
    rows = records(spark, sf_dir).where(meta(F.col("metadata"), "type") == "file_meta")
    m = lambda k: F.try_element_at("metadata", F.lit(k))
    return rows.groupBy(m("project_id").alias("project_id"), m("path").alias("path")).agg(F.max(m("hash")).alias("hash"))


@query(
    "WITH w AS (SELECT doc_id, " + sql.WORDS.format("text") + " AS w FROM documents) SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, len(list_distinct(w))::BIGINT AS n_distinct FROM w WHERE w IS NOT NULL"
)
def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String functions: words and distinct words of each text."""
    w = words(F.col("text"))
    rows = documents(spark, sf_dir).where("text is not null")
    return rows.select("doc_id", F.size(w).cast("bigint").alias("n_words"), F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct"))
