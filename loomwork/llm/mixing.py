"""Problem 7: mixing sources to target shares of the total size."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: First-level buckets of the seeded order, and second-level ones inside the
#: bucket where a source's fractional repetition ends.
BUCKETS = 4096


def water_fill(
    sizes: Mapping[str, float], targets: Mapping[str, float], repeats: Mapping[str, int], total: float | None = None, exact: bool = False
) -> tuple[float, dict[str, float]]:
    """Total size of the mix and the size each source gives.

    Sources that would need more than ``repeats`` passes are clamped there and
    what they lack goes to the others in proportion to their targets, until
    nothing changes.  Without a ``total`` it is the size of all sources that
    have both a target and content: as large as one pass over them.  With
    ``exact`` it is no larger than that at which every source still meets its
    target.  Sources without content or without a target give nothing.
    """
    caps = {s: float(sizes.get(s) or 0) * max(0, int(repeats.get(s) or 0)) for s in targets}
    live = {s: float(w) for s, w in targets.items() if w and w > 0 and caps[s] > 0}
    if not live:
        return 0.0, {}
    if total is None:
        total = sum(float(sizes[s]) for s in live)
    total = min(float(total), sum(caps[s] for s in live))
    if exact:
        total = min(total, min(caps[s] / w for s, w in live.items()) * sum(live.values()))
    give: dict[str, float] = {}
    open_, rest = dict(live), total
    while open_:
        weight = sum(open_.values())
        full = [s for s, w in open_.items() if rest * w / weight > caps[s] * (1 + 1e-12)]
        if not full:
            give |= {s: rest * w / weight for s, w in open_.items()}
            break
        for s in full:
            give[s] = caps[s]
            rest -= caps[s]
            del open_[s]
    return total, give


def mix_sources(
    docs: DataFrame,
    targets: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    size_col: str = "n_tokens",
    seed: int = 17,
    total: float | None = None,
    exact: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """``(mix, shares)``: how often each document is used, and what each source gives.

    Each source repeats whole passes over its documents and one fractional
    pass: a prefix of the documents in a seeded hash order whose sizes sum to
    the missing rest.  The end of that prefix is found from sums over hash
    buckets, first 4,096 per source, then 4,096 inside the one bucket it falls
    into, so that no source is ever ordered or collected as a whole.  The
    fraction thus ends within 1/16,777,216 of a source, or one document.

    ``mix``: id, source, size, repeats (at least 1).  ``shares``: source,
    target_share, available, max_repeats, wanted, actual, actual_share,
    clamped.  Only sums over sources and buckets reach the driver; both have a
    fixed bound: rows of ``targets`` times 4,096.

    Defined cases: sources without a target and documents of null source are
    not used; targets without documents are reported with 0 and their share
    goes to the others in proportion; repeated target rows count once (the
    greatest share); null or zero sizes take no part; empty tables give empty
    results; repeated ids are documents of their own; other columns are ignored.
    """
    plan = {
        r["source"]: (float(r["w"] or 0), int(r["m"] or 0))
        for r in targets.where(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("m"))
        .collect()
    }
    order = F.xxhash64(F.lit(seed), F.col(id_col).cast("string"))
    keyed = (
        docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.col(size_col).cast("bigint").alias("_size"), order.alias("_h"))
        .where((F.col("_size") > 0) & F.col("_source").isin(list(plan)))
        .withColumn("_b", F.shiftrightunsigned("_h", 52))
        .withColumn("_c", F.shiftrightunsigned("_h", 40).bitwiseAND(F.lit(BUCKETS - 1)))
    )
    first: dict[str, dict[int, int]] = {s: {} for s in plan}
    for r in keyed.groupBy("_source", "_b").agg(F.sum("_size").alias("n")).collect():
        first[r["_source"]][int(r["_b"])] = int(r["n"])
    sizes = {s: sum(b.values()) for s, b in first.items()}
    _, give = water_fill(sizes, {s: w for s, (w, _) in plan.items()}, {s: m for s, (_, m) in plan.items()}, total, exact)

    whole = {s: int(give.get(s, 0) / sizes[s] + 1e-12) if sizes[s] else 0 for s in plan}
    edge: dict[str, tuple[int, float]] = {}
    for s in plan:
        rest, at = give.get(s, 0.0) - whole[s] * sizes[s], 0.0
        for b in sorted(first[s]):
            if at + first[s][b] > rest:
                edge[s] = (b, rest - at)
                break
            at += first[s][b]
        else:
            edge[s] = (BUCKETS, 0.0)
    if edge:
        spark = docs.sparkSession
        ends = spark.createDataFrame([(s, b) for s, (b, _) in edge.items()], "_source string, _b bigint")
        second: dict[str, dict[int, int]] = {s: {} for s in plan}
        inside = keyed.join(F.broadcast(ends), ["_source", "_b"]).groupBy("_source", "_c").agg(F.sum("_size").alias("n"))
        for r in inside.collect():
            second[r["_source"]][int(r["_c"])] = int(r["n"])
    stops = []
    for s in plan:
        b, rest = edge[s]
        at, c = 0.0, 0
        for c in sorted(second[s]):  # the bucket that comes nearest to the rest ends the prefix
            if at + second[s][c] / 2 > rest:
                break
            at += second[s][c]
        else:
            c = BUCKETS
        stops.append((s, whole[s], b, c))
    spark = docs.sparkSession
    stop = spark.createDataFrame(stops or [("", 0, 0, 0)], "_source string, _whole int, _sb bigint, _sc bigint")
    extra = (F.col("_b") < F.col("_sb")) | ((F.col("_b") == F.col("_sb")) & (F.col("_c") < F.col("_sc")))
    mix = (
        keyed.join(F.broadcast(stop), "_source")
        .withColumn("repeats", F.col("_whole") + extra.cast("int"))
        .where("repeats > 0")
        .select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), F.col("_size").alias(size_col), "repeats")
    )
    wanted = spark.createDataFrame(
        [(s, w, sizes[s], m, float(give.get(s, 0.0)), bool(sizes[s] * m <= give.get(s, 0.0) * (1 + 1e-9))) for s, (w, m) in plan.items()],
        "source string, target_share double, available bigint, max_repeats int, wanted double, clamped boolean",
    )
    used = mix.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.col(size_col) * F.col("repeats")).alias("actual"))
    shares = wanted.join(used, "source", "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    sum_all = shares.agg(F.sum("actual").alias("_all"))
    shares = shares.join(F.broadcast(sum_all)).select(
        "source", "target_share", "available", "max_repeats", "wanted", "actual",
        F.when(F.col("_all") > 0, F.col("actual") / F.col("_all")).otherwise(F.lit(0.0)).alias("actual_share"), "clamped",
    )
    return mix, shares
