"""Plug-in points: embedders, re-rankers and analyzers as functions from columns to columns.

A model that runs in the JVM is an expression; one that needs Python is a
Pandas UDF over Arrow batches.  Either is called with columns and gives one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Embedder = Callable[[Column], Column]
Scorer = Callable[[Column], Column]


def embed(df: DataFrame, text_col: str, models: dict[str, Embedder], dim: int, route: Column | None = None, out: str = "embedding") -> DataFrame:
    """Adds an embedding by the model that ``route`` names for a row; ``default`` serves the other rows.

    A vector of another width than ``dim`` fails the job, as it would spoil the
    index silently.  Null texts have a null vector.
    """
    text, chosen = F.col(text_col), models["default"](F.col(text_col))
    for name, model in models.items():
        if route is not None and name != "default":
            chosen = F.when(route == name, model(text)).otherwise(chosen)
    right = F.when(chosen.isNull() | (F.size(chosen) == dim), chosen).otherwise(F.raise_error(F.concat(F.lit(f"embedding of another width than {dim}: "), F.size(chosen).cast("string"))))
    return df.withColumn(out, F.when(text.isNotNull(), right))


def rerank(df: DataFrame, id_col: str, text_col: str, score_col: str, scorer: Scorer, k: int, weight: float = 0.5) -> DataFrame:
    """The k best of a search's result by a blend of its score and a re-ranker's, both scaled to their greatest value.

    Without a score of the re-ranker (null) a row keeps its own.  Only what a
    search has found, a bounded list, is scored.
    """
    whole = W.partitionBy()
    scored = df.withColumn("_r", scorer(F.col(text_col)))
    top, best = F.max(F.col(score_col)).over(whole), F.max("_r").over(whole)
    own = F.when(top > 0, F.col(score_col) / top).otherwise(F.lit(0.0))
    other = F.when(best > 0, F.col("_r") / best).otherwise(F.lit(0.0))
    blend = F.round(F.when(F.col("_r").isNull(), own).otherwise((1 - weight) * own + weight * other), 6)
    return scored.withColumn("reranked", blend).drop("_r").orderBy(F.desc("reranked"), F.asc(id_col)).limit(max(0, k))


def analyze(df: DataFrame, keep: list[str], analyzers: dict[str, Callable[[Column], Column]], text_col: str) -> DataFrame:
    """Findings of several analyzers, each of which gives an array of strings per text: keep, analyzer, finding."""
    each = F.array(*[F.struct(F.lit(name).alias("analyzer"), F.coalesce(f(F.col(text_col)), F.array().cast("array<string>")).alias("found")) for name, f in analyzers.items()])
    return df.select(*keep, F.explode(each).alias("_a")).select(*keep, "_a.analyzer", F.explode("_a.found").alias("finding"))
