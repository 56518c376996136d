"""Incremental indexing: what is on disk against what is in the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare(disk: DataFrame, store: DataFrame, keys: list[str]) -> DataFrame:
    """State of each path by its hashes: indexed, modified, missing (not in the store) or deleted (not on disk)."""
    a = disk.select(*keys, F.col("hash").alias("disk_hash"))
    b = store.select(*keys, F.col("hash").alias("store_hash"))
    state = (
        F.when(F.col("store_hash").isNull(), "missing")
        .when(F.col("disk_hash").isNull(), "deleted")
        .when(F.col("disk_hash") == F.col("store_hash"), "indexed")
        .otherwise("modified")
    )
    return a.join(b, keys, "full").withColumn("state", state)


def to_index(disk: DataFrame, store: DataFrame, keys: list[str]) -> DataFrame:
    """Paths on disk that are new or changed: an anti join on path and hash."""
    return disk.join(store.select(*keys, "hash"), [*keys, "hash"], "left_anti")


def stale(disk: DataFrame, store: DataFrame, keys: list[str]) -> DataFrame:
    """Paths in the store that are no longer on disk."""
    return store.join(disk.select(*keys), keys, "left_anti")
