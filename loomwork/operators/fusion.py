"""Fusing lexical and vector rankings, boosts, re-ranking, token budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import is_code_like, token_estimate, word_overlap

#: Reciprocal-rank fusion and recency (fixed values).
RRF_K, CODE_WEIGHT, HALF_LIFE_DAYS, RECENCY_GAIN = 60, 1.5, 14.0, 0.5


def ranked(best: DataFrame, id_col: str, score_col: str, rank_col: str) -> DataFrame:
    """Ranks of a short list (the k best of a search), from 1."""
    return best.withColumn(rank_col, F.row_number().over(W.orderBy(F.desc(score_col), F.asc(id_col))))


def rrf(vector: DataFrame, lexical: DataFrame, id_col: str, query: str) -> DataFrame:
    """id, vec_rank, lex_rank, similarity, rrf of two short ranked lists.

    The lexical weight is higher for queries that look like code.  Both ranks
    and the similarity are kept for hits of either list.
    """
    w_lex = CODE_WEIGHT if is_code_like(query) else 1.0
    v = ranked(vector, id_col, "boosted", "vec_rank").select(id_col, "vec_rank", "similarity")
    x = ranked(lexical, id_col, "score", "lex_rank").select(id_col, "lex_rank")
    both = v.join(x, id_col, "full")
    score = F.coalesce(1.0 / (RRF_K + F.col("vec_rank")), F.lit(0.0)) + F.coalesce(F.lit(w_lex) / (RRF_K + F.col("lex_rank")), F.lit(0.0))
    return both.withColumn("rrf", score)


def recency_boost(age_days: Column) -> Column:
    """1.5 for what is new, falling to 1 with a half-life of two weeks."""
    return 1 + RECENCY_GAIN * F.pow(F.lit(2.0), -F.greatest(age_days, F.lit(0.0)) / HALF_LIFE_DAYS)


def number_or(text: Column, default: float = 1.0) -> Column:
    """A number written as text, in single precision; the default if it is none."""
    return F.coalesce(text.try_cast("float").cast("double"), F.lit(default))


def boosted(fused: DataFrame, category: Column, function_score: Column, priority: Column, updated: Column, now: float) -> DataFrame:
    """Adds ``score``: the fused score times function score, priority and, for documents, recency.

    ``now`` is given, never read from the clock.
    """
    age = (F.lit(float(now)) - updated.try_cast("double")) / 86400.0
    recency = F.when((category == "document") & age.isNotNull(), recency_boost(age)).otherwise(1.0)
    return fused.withColumn("score", F.round(F.col("rrf") * number_or(function_score) * number_or(priority) * recency, 8))


def overlap_rerank(hits: DataFrame, id_col: str, text_col: str, query: str, score_col: str = "score") -> DataFrame:
    """Reorder a short list by word overlap; hits without words keep their score."""
    return hits.withColumn("rerank", F.round(F.coalesce(word_overlap(query, F.col(text_col)), F.col(score_col)), 6))


def adaptive_cut(hits: DataFrame, id_col: str, score_col: str, few: int = 5, gap: float = 0.1, most: int = 32) -> DataFrame:
    """The head of a short list worth re-ranking: all of up to ``few``; else on
    from there while the score falls by less than ``gap``, ``most`` at most."""
    w = W.orderBy(F.desc(score_col), F.asc(id_col))
    r = hits.withColumn("rank", F.row_number().over(w)).withColumn("_gap", F.round(F.lag(score_col).over(w) - F.col(score_col), 9))
    stop = F.max(F.when((F.col("rank") > few) & (F.col("_gap") >= gap), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0))
    return r.withColumn("_stop", stop).where((F.col("_stop") == 0) & (F.col("rank") <= most)).drop("_gap", "_stop")


def score_blend(hits: DataFrame, semantic: str, reranked: str) -> DataFrame:
    """0.4 of the semantic and 0.5 of the re-ranker's score, joined by id beforehand."""
    return hits.withColumn("blend", F.round(0.4 * F.col(semantic) + 0.5 * F.col(reranked), 6))


def budget_prefix(hits: DataFrame, text_col: str, order: list[Column], budget: int, group: list[str] | None = None) -> DataFrame:
    """Hits in rank order until the running sum of token estimates would exceed the budget."""
    w = W.partitionBy(*(group or [])).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = hits.withColumn("tokens", token_estimate(F.col(text_col)))
    return rows.withColumn("used", F.sum("tokens").over(w)).where(F.col("used") <= budget)


def budget_greedy(hits: DataFrame, id_col: str, text_col: str, rank_col: str, budget: int, group: str) -> DataFrame:
    """First fit: a hit that does not fit is skipped, later ones are still tried.

    Each group must be a short ranked list (the k best of a search), as the
    order-dependent fold holds it in one row.  Result: group, taken and skipped
    ids in rank order, used.
    """
    rows = hits.select(group, F.struct(F.col(rank_col).alias("r"), F.col(id_col).alias("i"), token_estimate(F.col(text_col)).alias("t")).alias("h"))
    lists = rows.groupBy(group).agg(F.array_sort(F.collect_list("h")).alias("hs"))
    kind = dict(hits.dtypes)[id_col]
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast(f"array<{kind}>").alias("taken"), F.array().cast(f"array<{kind}>").alias("skipped"))

    def step(acc: Column, h: Column) -> Column:
        fits = acc["used"] + h["t"] <= budget
        return F.struct(
            F.when(fits, acc["used"] + h["t"]).otherwise(acc["used"]).alias("used"),
            F.when(fits, F.concat(acc["taken"], F.array(h["i"]))).otherwise(acc["taken"]).alias("taken"),
            F.when(fits, acc["skipped"]).otherwise(F.concat(acc["skipped"], F.array(h["i"]))).alias("skipped"),
        )

    return lists.select(group, F.aggregate("hs", start, step).alias("a")).select(group, "a.taken", "a.skipped", "a.used")
