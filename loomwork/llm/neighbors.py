"""Problem 3: the k most similar vectors of every vector, by an inverted multi-index."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

#: Rows of the sample the codebooks are fitted on; all rows are indexed.
SAMPLE_ROWS = 20_000
#: Entries of one block of the index; a cell with more is salted over several.
BLOCK_ROWS = 8_000
#: Codes per half at most: its square bounds the table of cell sizes.  Where more
#: rows would need more, the candidates rise as the cells do.
MOST_CODES = 1_024


def _kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """Centroids of a bounded sample."""
    rng = np.random.default_rng(seed)
    k = min(k, len(points))
    centers = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        near = ((centers**2).sum(1) - 2 * points @ centers.T).argmin(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, points)
        counts = np.bincount(near, minlength=k)
        full = counts > 0
        centers[full] = sums[full] / counts[full, None]
    return centers


def codes_for(total: int) -> float:
    """Codes per half for so many vectors: sqrt(rows / 90), from 52,000 rows on growing with their power of 0.85.

    With codes by the root alone the recall falls as the data grow (0.85 at
    519,000 vectors); finer cells bring the walk nearer to the query.
    """
    return max(4.0, math.ceil(math.sqrt(total / 90)), 25 * (total / 52_000) ** 0.85)


def _half_distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] + (book**2).sum(1) - 2 * x @ book.T


def multi_sequence(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, want: int) -> list[tuple[int, int]]:
    """Cells (centroid pairs) in the order of their summed distance until ``want`` entries are met.

    A heap holds the frontier; empty cells are passed over.
    """
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    a, b = d1[o1], d2[o2]
    heap, seen, cells, got = [(float(a[0] + b[0]), 0, 0)], {(0, 0)}, [], 0
    while heap and got < want:
        _, i, j = heapq.heappop(heap)
        n = int(counts[o1[i], o2[j]])
        if n:
            cells.append((int(o1[i]), int(o2[j])))
            got += n
        for u, v in ((i + 1, j), (i, j + 1)):
            if u < len(a) and v < len(b) and (u, v) not in seen:
                seen.add((u, v))
                heapq.heappush(heap, (float(a[u] + b[v]), u, v))
    return cells


def lay_blocks(counts: np.ndarray, rows: int = BLOCK_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each cell.

    A block holds neighbouring cells of one first code, up to ``rows`` entries;
    a larger cell has blocks of its own.
    """
    first, width = np.zeros(counts.shape, np.int64), np.ones(counts.shape, np.int64)
    block = -1
    for i in range(counts.shape[0]):
        held = rows + 1
        for j in range(counts.shape[1]):
            n = int(counts[i, j])
            if n > rows:
                first[i, j], width[i, j] = block + 1, -(-n // rows)
                block += int(width[i, j])
                held = rows + 1
                continue
            if held + n > rows:
                block, held = block + 1, 0
            first[i, j] = block
            held += n
    return first, width


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # neither over- nor underflow in the squares
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def valid_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int) -> DataFrame:
    """Usable vectors: _id, _key (128 bits that stand for the vector), _raw."""
    v = F.col(vec_col).cast("array<float>")
    rows = df.where(F.col(id_col).isNotNull() & (F.size(v) == dim)).select(F.col(id_col).cast("bigint").alias("_id"), v.alias("_raw"))
    finite = F.forall("_raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(finite & F.exists("_raw", lambda x: x != 0))
    key = F.concat(F.hex(F.xxhash64("_raw")), F.lit("-"), F.hex(F.xxhash64(F.lit(1), F.col("_raw"))))
    return rows.select("_id", key.alias("_key"), "_raw")


def _best(q: np.ndarray, entries: tuple[np.ndarray, np.ndarray, np.ndarray], m: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact similarities and ids of the m best entries for each row of q, ties by id."""
    eid, ex, ef = entries
    more = min(m + 8, len(eid))
    rough = q.astype(np.float32) @ ef
    top = np.argpartition(-rough, more - 1, axis=1)[:, :more]
    lowest = np.take_along_axis(rough, top, 1).min(1)
    exact = np.round(np.einsum("qd,qmd->qm", q, ex[top]), 12)
    ids = eid[top]
    order = np.lexsort((ids, -exact), axis=1)[:, :m]
    sims, ids = np.take_along_axis(exact, order, 1), np.take_along_axis(ids, order, 1)
    if more < len(eid):  # where single precision can't tell the last ones apart, all of them are looked at
        for r in np.flatnonzero(sims[:, -1] - lowest < 1e-5):
            near = np.flatnonzero(rough[r] >= lowest[r] - 1e-5)
            s = np.round(ex[near] @ q[r], 12)
            o = np.lexsort((eid[near], -s))[:m]
            sims[r], ids[r] = s[o], eid[near][o]
    return sims, ids


def _pairs(sims: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(-sims), pa.array(ids)], names=["d", "r"]))


def nearest(
    df: DataFrame,
    id_col: str = "rec_no",
    vec_col: str = "embedding",
    dim: int = 64,
    k: int = 10,
    candidates: int = 1_600,
    codes: int | None = None,
    queries: DataFrame | None = None,
    seed: int = 1,
) -> DataFrame:
    """For every vector its ``k`` most similar others: query, neighbor, similarity, rank.

    Inverted multi-index: the two halves of the unit vectors are quantised
    apart, with codebooks fitted on at most ``SAMPLE_ROWS`` rows; every row is
    indexed under its pair of codes.  A query walks the pairs by summed distance
    with a heap until it has met ``candidates`` distinct vectors; the entries of
    every block it met are reranked by exact cosine in double precision: the
    neighbours of the cells it met cost no further shuffle and raise the recall.
    With ``codes`` unset each half has ``codes_for(rows)`` codes.  With as many
    candidates as rows the result is exact.

    Identical vectors are one entry with the k + 1 smallest ids that hold it, as
    more can never be among anyone's nearest; all ids that hold it ask.  First
    each vector is compared with its own block, which moves only the entries
    and gives a bound; then it goes to the other blocks it met, and only what
    is not below the bound comes back.  Rows are sorted by block: a task holds one
    block, of at most ``BLOCK_ROWS`` entries, and streams the queries past it.

    ``queries`` (ids in its first column) limits who asks, never who is found.

    Defined cases: null vectors, vectors of another width, with null, NaN or
    infinite entries, or all zero, take no part; repeated ids count once, with
    the vector of the least key; identical vectors have similarity 1; similarities are
    rounded to 12 decimals and ties go to the smaller id; fewer than k others
    give fewer rows; an empty table gives an empty result; other columns are
    ignored.
    """
    spark = df.sparkSession
    half = dim // 2
    keyed = valid_vectors(df, id_col, vec_col, dim)
    rows = cut(keyed.groupBy("_id").agg(F.min("_key").alias("_key")))
    smallest = W.partitionBy("_key").orderBy("_id")
    holders = (
        rows.withColumn("_n", F.row_number().over(smallest))
        .where(F.col("_n") <= k + 1)
        .groupBy("_key")
        .agg(F.min("_id").alias("_rep"), F.array_sort(F.collect_list("_id")).alias("_ids"))
    )
    vectors = cut(keyed.groupBy("_key").agg(F.first("_raw").alias("_raw")).join(holders, "_key"))
    total = vectors.count()
    if not total:
        return spark.createDataFrame([], "query bigint, neighbor bigint, similarity double, rank int")
    mark = F.pmod(F.xxhash64(F.lit(seed), "_rep"), F.lit(1 << 20))
    share = min(1.0, 1.2 * SAMPLE_ROWS / total)
    sample = vectors.where(mark <= int(share * (1 << 20))).select("_raw").limit(SAMPLE_ROWS).toArrow()
    points = _unit(_matrix(sample.column("_raw").combine_chunks(), dim))
    size = codes or min(MOST_CODES, int(codes_for(total) + 0.5))
    if not codes:
        candidates = math.ceil(candidates * max(1.0, codes_for(total) / MOST_CODES) ** 2)
    books = (_kmeans(points[:, :half], size, seed=seed), _kmeans(points[:, half:], size, seed=seed + 1))
    n1, n2 = len(books[0]), len(books[1])

    def codes_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _half_distances(x[:, :half], books[0]).argmin(1), _half_distances(x[:, half:], books[1]).argmin(1)

    def count_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(n1 * n2, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                c1, c2 = codes_of(_unit(_matrix(batch.column("_raw"), dim)))
                sums += np.bincount(c1 * n2 + c2, minlength=n1 * n2)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], names=["c", "n"])

    cells = vectors.select("_raw").mapInArrow(count_cells, "c bigint, n bigint").groupBy("c").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(n1 * n2, dtype=np.int64)  # at most MOST_CODES squared
    counts[cells.column("c").to_numpy()] = cells.column("n").to_numpy()
    counts = counts.reshape(n1, n2)
    first, width = lay_blocks(counts)
    blocks = int((first + width).max())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Entries with the block they lie in."""
        for batch in batches:
            if batch.num_rows:
                c1, c2 = codes_of(_unit(_matrix(batch.column("_raw"), dim)))
                block = first[c1, c2] + (batch.column("_rep").to_numpy() * 2654435761 >> 7) % width[c1, c2]
                yield pa.RecordBatch.from_arrays([pa.array(block), batch.column("_rep"), batch.column("_raw")], names=["_block", "_rep", "_raw"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block: each entry with the best of its own block."""

        def flush(block: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reps = np.concatenate([p.column("_rep").to_numpy() for p in parts])
            raw = pa.concat_arrays([p.column("_raw") for p in parts])
            x = _unit(_matrix(raw, dim))
            held = reps, x, np.ascontiguousarray(x.T.astype(np.float32))
            m = min(k + 1, len(reps))
            for a in range(0, len(x), 512):
                sims, ids = _best(x[a : a + 512], held, m)
                n = len(sims)
                bound = sims[:, -1] if m == k + 1 else np.full(n, -2.0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(reps[a : a + n]), raw.slice(a, n), pa.array(np.full(n, block)), pa.array(bound), _pairs(sims.ravel(), ids.ravel(), np.full(n, m))],
                    names=["_rep", "_raw", "_block", "_bound", "_best"],
                )

        block, parts = None, []
        for batch in batches:
            at = batch.column("_block").to_numpy()
            ends = np.flatnonzero(at[1:] != at[:-1]) + 1
            for lo, hi in zip([0, *ends], [*ends, len(at)]):
                if hi <= lo:
                    continue
                if at[lo] != block and parts:
                    yield from flush(block, parts)
                    parts = []
                block = at[lo]
                parts.append(batch.slice(lo, hi - lo))
        if parts:
            yield from flush(block, parts)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per query and other block it has to see."""
        for batch in batches:
            for lo in range(0, batch.num_rows, 1_000):
                part = batch.slice(lo, 1_000)
                x = _unit(_matrix(part.column("_raw"), dim))
                mine = part.column("_block").to_numpy()
                d1, d2 = _half_distances(x[:, :half], books[0]), _half_distances(x[:, half:], books[1])
                take, block = [], []
                for r in range(len(x)):
                    met = {b for i, j in multi_sequence(d1[r], d2[r], counts, candidates) for b in range(first[i, j], first[i, j] + width[i, j])}
                    met.discard(mine[r])
                    take += [r] * len(met)
                    block += sorted(met)
                take = pa.array(take, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block, pa.int64()), *[part.column(c).take(take) for c in ("_rep", "_raw", "_bound")]], names=["_block", "_rep", "_raw", "_bound"]
                )

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block, entries (without a bound) before queries: what reaches the query's bound."""
        block, parts, held = None, [], None
        for batch in batches:
            at, bound = batch.column("_block").to_numpy(), batch.column("_bound").to_numpy(zero_copy_only=False)
            asks = ~np.isnan(bound)
            ends = np.flatnonzero((at[1:] != at[:-1]) | (asks[1:] != asks[:-1])) + 1
            for lo, hi in zip([0, *ends], [*ends, len(at)]):
                if hi <= lo:
                    continue
                if at[lo] != block:
                    block, parts, held = at[lo], [], None
                seg = batch.slice(lo, hi - lo)
                reps, x = seg.column("_rep").to_numpy(), _unit(_matrix(seg.column("_raw"), dim))
                if not asks[lo]:
                    parts.append((reps, x))
                    continue
                if held is None:
                    eid, ex = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                    held = eid, ex, np.ascontiguousarray(ex.T.astype(np.float32))
                m = min(k + 1, len(held[0]))
                for a in range(0, len(x), 512):
                    sims, ids = _best(x[a : a + 512], held, m)
                    ok = sims >= bound[lo + a : lo + a + len(sims), None]
                    some = ok.any(1)
                    yield pa.RecordBatch.from_arrays([pa.array(reps[a : a + len(sims)][some]), _pairs(sims[ok], ids[ok], ok.sum(1)[some])], names=["_rep", "_best"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(blocks, 2_000))
    entries = vectors.select("_rep", "_raw").mapInArrow(place, "_block bigint, _rep bigint, _raw array<float>")
    near_by = (
        entries.repartition(parts, "_block")
        .sortWithinPartitions("_block")
        .mapInArrow(own, "_rep bigint, _raw array<float>, _block bigint, _bound double, _best array<struct<d:double,r:bigint>>")
    )
    if queries is not None:
        ids = queries.select(F.col(queries.columns[0]).cast("bigint").alias("_id")).distinct()
        rows = rows.join(ids, "_id", "left_semi")
        near_by = near_by.join(vectors.join(rows.select("_key").distinct(), "_key", "left_semi").select("_rep"), "_rep", "left_semi")
    asked = near_by.select("_rep", "_raw", "_block", "_bound").mapInArrow(route, "_block bigint, _rep bigint, _raw array<float>, _bound double")
    found = (
        entries.withColumn("_bound", F.lit(None).cast("double"))
        .unionByName(asked)
        .repartition(parts, "_block")
        .sortWithinPartitions("_block", F.asc_nulls_first("_bound"))
        .mapInArrow(rerank, "_rep bigint, _best array<struct<d:double,r:bigint>>")
    )
    both = near_by.select("_rep", "_best").unionByName(found)
    best = both.groupBy("_rep").agg(F.slice(F.array_sort(F.flatten(F.collect_list("_best"))), 1, k + 1).alias("_best"))
    members = vectors.select(F.col("_rep").alias("_other"), F.col("_ids").alias("_oids"))
    near = (
        best.select("_rep", F.explode("_best").alias("_b"))
        .select("_rep", F.col("_b.d").alias("_d"), F.col("_b.r").alias("_other"))
        .join(members, "_other")
        .groupBy("_rep")
        .agg(F.flatten(F.collect_list(F.transform("_oids", lambda i: F.struct(F.col("_d").alias("d"), i.alias("i"))))).alias("_near"))
    )
    asks = rows.join(vectors.select("_key", "_rep"), "_key").join(near, "_rep")
    mine = F.slice(F.array_sort(F.filter("_near", lambda n: n["i"] != F.col("_id"))), 1, k)
    return asks.select("_id", F.posexplode(mine).alias("_p", "_n")).select(
        F.col("_id").alias("query"), F.col("_n.i").alias("neighbor"), (-F.col("_n.d")).alias("similarity"), (F.col("_p") + 1).alias("rank")
    )


def nearest_pairs(found: DataFrame) -> DataFrame:
    """Pairs where at least one is among the nearest of the other: rec_a < rec_b, each once."""
    return found.select(F.least("query", "neighbor").alias("rec_a"), F.greatest("query", "neighbor").alias("rec_b")).distinct()
