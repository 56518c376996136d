"""Exact vector search on array columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def usable(vector: Column, dim: int) -> Column:
    """Of the right width, all entries finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(v: Column, eps: float = 1e-9) -> Column:
    """Divided by its length, unless that is next to nothing."""
    n = norm(v)
    return F.when(n > eps, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def matryoshka(v: Column, dim: int) -> Column:
    """The first entries only, normalised again."""
    return l2_normalize(F.slice(v, 1, dim))


def cosine(v: Column, query: list[float]) -> Column:
    """Cosine with a constant vector, in double precision; null for zero vectors."""
    q = np.asarray(query, dtype=np.float64)
    literal = F.array(*[F.lit(float(x)) for x in q])
    n = norm(v)
    return F.when(n > 0, dot(v, literal) / (n * F.lit(float(np.sqrt((q * q).sum())))))


def search(df: DataFrame, id_col: str, vec_col: str, query: list[float], k: int, dim: int, priority: Column | None = None, boost_first: bool = False) -> DataFrame:
    """id, similarity, boosted: the k best by cosine, then multiplied by the priority and ordered anew.

    By default the boost comes after the cut, so a boosted row just beyond k
    never enters; ``boost_first`` turns that round.  Ties go to the smaller id.
    """
    scored = df.where(usable(F.col(vec_col), dim)).select(
        id_col, F.round(cosine(F.col(vec_col), query), 6).alias("similarity"), (priority if priority is not None else F.lit(1.0)).alias("_p")
    )
    scored = scored.withColumn("boosted", F.round(F.col("similarity") * F.col("_p"), 6)).drop("_p")
    first = "boosted" if boost_first else "similarity"
    best = scored.orderBy(F.desc(first), F.asc(id_col)).limit(max(0, k))
    return best.orderBy(F.desc("boosted"), F.asc(id_col))


def nearest_of_queries(rows: DataFrame, queries: DataFrame, id_col: str, vec_col: str, dim: int, k: int, part_rows: int = 50_000) -> DataFrame:
    """For each query its k nearest rows, exactly: query, neighbor, similarity.

    The rows are hashed into parts of about ``part_rows`` and every query is
    sent to every part, as what is asked is a small share of the rows.  A task
    holds one part as a matrix, in the order of a sort, and streams the queries
    past it in Arrow batches; the k best of each part are merged after one
    small shuffle.  Nothing passes the driver.
    """
    spark = rows.sparkSession
    v = F.col(vec_col).cast("array<float>")
    good = rows.where(usable(F.col(vec_col), dim)).select(F.col(id_col).cast("bigint").alias("_id"), v.alias("_v"))
    asked = queries.where(usable(F.col(vec_col), dim)).select(F.col(id_col).cast("bigint").alias("_id"), v.alias("_v"))
    parts = max(1, -(-good.count() // part_rows))
    held = good.select(F.pmod(F.xxhash64("_id"), F.lit(parts)).cast("int").alias("_part"), F.lit(False).alias("_asks"), "_id", "_v")
    sent = asked.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"), F.lit(True).alias("_asks"), "_id", "_v")

    def unit(column: pa.Array) -> np.ndarray:
        x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, entries, matrix = None, [], None
        for batch in batches:
            part, asks = batch.column("_part").to_numpy(), batch.column("_asks").to_numpy(zero_copy_only=False)
            ends = np.flatnonzero((part[1:] != part[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip([0, *ends], [*ends, len(part)]):
                if hi <= lo:
                    continue
                if part[lo] != at:
                    at, entries, matrix = part[lo], [], None
                seg = batch.slice(lo, hi - lo)
                if not asks[lo]:
                    entries.append((seg.column("_id").to_numpy(), unit(seg.column("_v"))))
                    continue
                if matrix is None and entries:
                    ids, x = np.concatenate([e[0] for e in entries]), np.concatenate([e[1] for e in entries])
                    order = np.argsort(ids, kind="stable")  # equal similarities stay in the order of ids
                    matrix = ids[order], x[order]
                if matrix is None:
                    continue
                ids, x = matrix
                mine, q = seg.column("_id").to_numpy(), unit(seg.column("_v"))
                for a in range(0, len(q), 256):
                    sims = np.round(q[a : a + 256] @ x.T, 6)
                    sims[mine[a : a + 256, None] == ids[None, :]] = -np.inf
                    m = min(k, len(ids))
                    # all that reach the k-th similarity, then the first k by id
                    least = -np.partition(-sims, m - 1, axis=1)[:, m - 1]
                    r, c = np.nonzero(sims >= least[:, None])
                    order = np.lexsort((ids[c], -sims[r, c], r))
                    r, c = r[order], c[order]
                    nth = np.arange(len(r)) - np.searchsorted(r, r)
                    keep = (nth < m) & (sims[r, c] > -np.inf)
                    r, c = r[keep], c[keep]
                    yield pa.RecordBatch.from_arrays([pa.array(mine[a + r]), pa.array(ids[c]), pa.array(sims[r, c])], names=["query", "neighbor", "similarity"])

    width = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = held.unionByName(sent).repartition(width, "_part").sortWithinPartitions("_part", "_asks").mapInArrow(run, "query bigint, neighbor bigint, similarity double")
    first = W.partitionBy("query").orderBy(F.desc("similarity"), F.asc("neighbor"))
    return found.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= k).select("query", "neighbor", "similarity")
