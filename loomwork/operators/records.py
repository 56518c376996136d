"""The store: latest versions, upserts, deletes, lookups, scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last by ``order``; a row_number filter that keeps the first row of each key map-side."""
    w = W.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(store: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The store with ``fresh`` in place of rows of the same key."""
    return store.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def meta(df_map: Column, key: str) -> Column:
    """A metadata value; a missing one reads as empty."""
    return F.coalesce(F.try_element_at(df_map, F.lit(key)), F.lit(""))


def under(path: Column, prefix: str) -> Column:
    """The path itself or below it; an empty prefix is everything."""
    prefix = prefix.rstrip("/")
    return F.lit(True) if not prefix else (path == prefix) | path.startswith(prefix + "/")


def delete_prefix(df: DataFrame, path: Column, prefix: str, also: Column | None = None) -> DataFrame:
    gone = under(path, prefix) if also is None else under(path, prefix) & also
    return df.where(~F.coalesce(gone, F.lit(False)))


def clear_project(df: DataFrame, project: str) -> DataFrame:
    """Everything but the records of a project; those without one stay."""
    return df.where(meta(F.col("metadata"), "project_id") != project)


def replace_by_path(store: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows of the paths that come anew are dropped before the new ones are added."""
    return store.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def set_status(statuses: DataFrame, changes: DataFrame) -> DataFrame:
    """One status per project, the last change winning: project_id, status, at."""
    return latest(statuses.unionByName(changes), ["project_id"], ["at", "status"])
