"""Lexical search: postings, corpus statistics, BM25."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import expand_token, raw_tokens

#: BM25 parameters (fixed values).
K1, B = 1.2, 0.75


def document_text(content: Column, name: Column, path: Column, symbols: Column, calls: Column) -> Column:
    """What is indexed of a record: trimmed, non-empty parts joined by blanks.

    ``symbols`` and ``calls`` are JSON arrays in strings; a string that is no
    JSON array, or an empty one, is taken as it is.
    """

    def parts(column: Column) -> Column:
        listed = F.from_json(column, "array<string>")
        return F.when(F.size(listed) > 0, listed).otherwise(F.array(F.coalesce(column, F.lit(""))))

    texts = F.concat(F.array(content, name, path), parts(symbols), parts(calls))
    return F.array_join(F.filter(F.transform(texts, lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != ""), " ")


def tokens(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per token occurrence: id, term.  Fragments of identifiers are tokens too."""
    raws = df.select(id_col, F.explode(raw_tokens(F.col(text_col))).alias("raw"))
    return raws.select(id_col, F.explode(expand_token(F.col("raw"))).alias("term"))


def postings(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Inverted index: term, id, tf; combined map-side before the one shuffle."""
    return tokens(df, id_col, text_col).groupBy("term", id_col).agg(F.count("*").alias("tf"))


def document_lengths(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return tokens(df, id_col, text_col).groupBy(id_col).agg(F.count("*").alias("dl"))


def corpus_stats(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row: n documents with any token, their mean length."""
    return document_lengths(df, id_col, text_col).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def query_terms(query: str) -> list[str]:
    """Terms of a query as the tokenizer cuts them, repetitions kept."""
    out: list[str] = []
    for raw in re.findall(r"\w+", query):
        low = raw.lower()
        out.append(low)
        parts = re.split(r"_+|(?<=[a-z])(?=[A-Z])|(?<=\d)(?=[^\d_])|(?<=[^\d_])(?=\d)|(?<=[A-Z])(?=[A-Z][a-z])", raw)
        out += [p.lower() for p in parts if p and p.lower() != low]
    return out


def _counted(df: DataFrame, id_col: str, text_col: str, terms: list[str]) -> DataFrame:
    """Per document its length and the count of each term, with the corpus statistics beside them."""
    per = tokens(df, id_col, text_col).groupBy(id_col).agg(F.count("*").alias("dl"), *[F.count_if(F.col("term") == t).alias(f"_tf{i}") for i, t in enumerate(terms)])
    stats = per.agg(F.count("*").alias("_n"), F.avg("dl").alias("_avg"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(terms))])
    hits = per.where(F.greatest(*[F.col(f"_tf{i}") for i in range(len(terms))], F.lit(0)) > 0)
    return hits.join(F.broadcast(stats))  # one row


def _score(places: list[int], k1: float, b: float) -> Column:
    """BM25 of the terms at these places; a place given twice counts twice."""
    total = F.lit(0.0)
    for i in dict.fromkeys(places):
        tf, df_ = F.col(f"_tf{i}").cast("double"), F.col(f"_df{i}").cast("double")
        idf = F.ln((F.col("_n") - df_ + 0.5) / (df_ + 0.5) + 1)
        total = total + places.count(i) * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("_avg")))
    return F.round(total, 6)


def bm25(df: DataFrame, id_col: str, text_col: str, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """id, score of every document with at least one query term.

    One aggregation per document counts its length and each query term, so the
    index of other terms is never built; document frequencies and the mean
    length come from the same exchange.  Statistics are those of the whole
    corpus that is passed in.  Repeated query terms count as often as given.
    """
    terms = query_terms(query)
    distinct = list(dict.fromkeys(terms))
    if not distinct:
        return df.select(id_col, F.lit(0.0).alias("score")).limit(0)
    return _counted(df, id_col, text_col, distinct).select(id_col, _score([distinct.index(t) for t in terms], k1, b).alias("score"))


def lengths_of(stored: DataFrame, id_col: str) -> DataFrame:
    """Document lengths from stored postings."""
    return stored.groupBy(id_col).agg(F.sum("tf").alias("dl"))


def bm25_stored(stored: DataFrame, lengths: DataFrame, id_col: str, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """The same scores as ``bm25`` from stored postings (term, id, tf) and lengths (id, dl).

    Only the postings of the query's terms are read, which the store prunes if
    it is sorted or bucketed by term; no text is cut into tokens again.
    """
    terms = query_terms(query)
    times = {t: terms.count(t) for t in terms}
    if not times:
        return lengths.select(id_col, F.lit(0.0).alias("score")).limit(0)
    weight = F.create_map(*[F.lit(x) for t, n in times.items() for x in (t, n)])
    hits = stored.where(F.col("term").isin(list(times)))
    found = hits.groupBy("term").agg(F.count("*").alias("_df"))  # one row a query term
    stats = lengths.agg(F.count("*").alias("_n"), F.avg("dl").alias("_avg"))
    rows = hits.join(F.broadcast(found), "term").join(lengths, id_col).join(F.broadcast(stats))
    idf = F.ln((F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5) + 1)
    each = weight[F.col("term")] * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("_avg")))
    return rows.groupBy(id_col).agg(F.round(F.sum(each), 6).alias("score"))


def top(scored: DataFrame, id_col: str, k: int, score_col: str = "score") -> DataFrame:
    """The k best; ties go to the smaller id.  k of 0 or less gives nothing."""
    return scored.orderBy(F.desc(score_col), F.asc(id_col)).limit(max(0, k))


def lexical_search(df: DataFrame, id_col: str, text_col: str, query: str, k: int, keep: Column | None = None, over: int = 3) -> DataFrame:
    """BM25 over the whole corpus, the ``over`` x k best of it, and only then the filter and the cut to k.

    A match of the filter beyond the over-fetched ones is left out on purpose:
    term statistics and the over-fetch belong to the whole corpus.
    """
    best = top(bm25(df, id_col, text_col, query), id_col, over * k)
    rows = best.join(df.select(id_col, *[c for c in df.columns if c not in (id_col, text_col)]), id_col)
    return top(rows if keep is None else rows.where(keep), id_col, k)


#: Words that calls which register routes hold (fixed values).
ROUTE_KEYWORDS = ["HandleFunc", "mux.Handle", "app.GET", "app.POST", "router.Register", "Route(", "@app.route", "FastAPI()"]


def keyword_search(df: DataFrame, id_col: str, text_col: str, keywords: list[str], k: int, keep: DataFrame | None = None) -> DataFrame:
    """The k best documents of each keyword, each id once with its best score and the keywords it was found by.

    The texts are tokenized once for all keywords; the ranking keeps k rows per
    keyword before its shuffle.  ``keep`` (ids) limits what is ranked, never the
    corpus whose statistics count.
    """
    cut = {w: query_terms(w) for w in keywords}
    distinct = list(dict.fromkeys(t for terms in cut.values() for t in terms))
    if not distinct:
        return df.select(id_col, F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("keywords")).limit(0)
    places = {w: [distinct.index(t) for t in terms] for w, terms in cut.items() if terms}
    each = F.array(*[F.struct(F.lit(w).alias("keyword"), _score(at, K1, B).alias("score")) for w, at in places.items()])
    found = _counted(df, id_col, text_col, distinct).select(id_col, F.explode(each).alias("_e")).select(id_col, "_e.keyword", "_e.score").where("score > 0")
    if keep is not None:
        found = found.join(keep.select(id_col), id_col, "left_semi")
    w = W.partitionBy("keyword").orderBy(F.desc("score"), F.asc(id_col))
    best = found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return best.groupBy(id_col).agg(F.max("score").alias("score"), F.array_sort(F.collect_set("keyword")).alias("keywords"))
