"""Retrieval measures, latencies, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Upper bounds of a latency histogram, in seconds (fixed values).
BOUNDS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]


def retrieval_kpis(hits: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """One row: queries, recall@k, mean reciprocal rank, binary NDCG@k.

    ``hits``: query, item, rank (from 1).  ``expected``: query, item.  An item
    that comes twice counts where it comes first.
    """
    w = W.partitionBy("query").orderBy("first")
    ranks = hits.groupBy("query", "item").agg(F.min("rank").alias("first")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    per = expected.join(ranks, ["query", "item"], "left").groupBy("query").agg(F.min("rank").alias("rank"))
    rr = F.coalesce(1.0 / F.col("rank"), F.lit(0.0))
    gain = F.coalesce(1.0 / F.log2(F.col("rank") + 1.0), F.lit(0.0))
    return per.agg(
        F.count("*").alias("n_queries"),
        F.round(F.avg(F.col("rank").isNotNull().cast("double")), 6).alias("recall"),
        F.round(F.avg(rr), 6).alias("mrr"),
        F.round(F.avg(gain), 6).alias("ndcg"),
    )


def nearest_rank(value: str, p: float) -> Column:
    """Nearest-rank percentile."""
    return F.expr(f"percentile_disc({p}) within group (order by {value})")


def histogram(df: DataFrame, value: str, bounds: list[float] | None = None) -> DataFrame:
    """Cumulative counts by upper bound, the last bound being infinite: le, n; one pass, no shuffle of rows."""
    bounds = bounds or BOUNDS
    counts = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    one = df.agg(*counts, F.count(value).alias("inf"))
    pairs = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    pairs.append(F.struct(F.lit(float("inf")).alias("le"), F.col("inf").alias("n")))
    return one.select(F.explode(F.array(*pairs)).alias("p")).select("p.le", "p.n")


def hit_rate(hit: Column) -> Column:
    """Share of hits; null without traffic."""
    return F.round(F.avg(hit.cast("double")), 6)
