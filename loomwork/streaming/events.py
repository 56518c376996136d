"""File events: debouncing, last operation wins, upserts from a stream, rate limits."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Endings whose change is taken up at once (fixed values).
WATCHED = [".go", ".ts", ".tsx", ".js", ".jsx", ".md"]


def debounce(events: DataFrame, key: str, ts: str, op: str, gap: str = "500 milliseconds") -> DataFrame:
    """Sessions of events of a key with no longer gap: key, start, end, n_events, last operation.

    The same expression serves batches and streams; a stream needs a watermark
    on ``ts`` beforehand.
    """
    return (
        events.groupBy(F.session_window(ts, gap).alias("w"), key)
        .agg(F.count("*").alias("n_events"), F.max(F.struct(F.col(ts).alias("t"), F.col(op).alias("o"))).alias("last"))
        .select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events", F.col("last.o").alias("last_op"))
    )


def last_operations(events: DataFrame, path: str, ts: str, op: str, tie: str) -> DataFrame:
    """The last operation of each path; ties in time go to the greater ``tie``."""
    return events.groupBy(path).agg(F.max_by(op, F.struct(ts, tie)).alias("last_op"), F.count("*").alias("n_events"))


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table, one file or a folder of files, as a stream, its time with a zone."""
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    reader = spark.readStream.schema(batch.schema)
    single = all(f.endswith("/events.parquet") for f in batch.inputFiles())
    rows = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir) if single else reader.parquet(f"{sf_dir}/events.parquet")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_folder(stream: DataFrame, folder: str, mode: str = "append", hooks: list[Callable[[DataFrame, int], None]] | None = None) -> DataFrame:
    """Run a stream over what is there, its rows going to Parquet in a shared folder, and return them.

    A micro-batch writes a folder named by its number, so that one that is run
    again after a failure replaces its own rows.  In the mode ``complete`` the
    last batch holds the whole result.  ``hooks`` run after each batch with its
    rows and number.
    """
    written: list[str] = []

    def write(rows: DataFrame, number: int) -> None:
        at = f"{folder}/rows/batch={number}"
        rows.write.mode("overwrite").parquet(at)
        written.append(at)
        for hook in hooks or []:
            hook(rows.sparkSession.read.schema(stream.schema).parquet(at), number)

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    spark = stream.sparkSession
    if not written:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*(written[-1:] if mode == "complete" else written))


def apply_changes(store: DataFrame, events: DataFrame, fresh: DataFrame) -> DataFrame:
    """The store after a batch of events: rows of removed and renamed paths go, with all below
    them; rows of written and created ones are replaced by the fresh rows.

    ``store`` and ``fresh`` have a path column; ``events``: path, op.  Prefix
    deletes join on the ancestors of each stored path, never path against path.
    """
    last = events.groupBy("path").agg(F.max_by("op", "ts").alias("op"))
    gone = last.where(F.col("op").isin("remove", "rename")).select(F.col("path").alias("_a"))
    parts = F.split("path", "/")
    above = store.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("_a"))
    dropped = above.join(gone, "_a", "left_semi").select("path").distinct()
    written = last.where(F.col("op").isin("write", "create")).select("path")
    fits = F.regexp_extract("path", r"(\.[A-Za-z]+)$", 1).isin(WATCHED)
    new = fresh.join(written, "path", "left_semi").where(fits)
    return store.join(dropped, "path", "left_anti").join(new.select("path").distinct(), "path", "left_anti").unionByName(new)


def stream_changes(events: DataFrame, store: str, fresh: Callable[[DataFrame], DataFrame], progress: str, hooks: list[Callable[[DataFrame, int], None]] | None = None) -> str:
    """Apply a stream of file events (path, ts, op) to a store of versions in Parquet; the folder of the last version.

    Each micro-batch reads the version before it and writes the next one
    (``v=<number>``), so that a batch run again gives the same version.
    ``fresh`` gives the new rows of the changed files from a batch's events.
    """
    last = [f"{store}/v=-1"]

    def step(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        before = spark.read.parquet(last[0])
        apply_changes(before, rows, fresh(rows)).write.mode("overwrite").parquet(f"{store}/v={number}")
        last[0] = f"{store}/v={number}"
        for hook in hooks or []:
            hook(rows, number)

    events.writeStream.foreachBatch(step).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return last[0]


def token_bucket(events: DataFrame, key: str, ts: str, rate: float, burst: float) -> DataFrame:
    """Per key the requests a token bucket lets through, as a stateful stream: key, event_id, allowed.

    The state of a key is its tokens and the time of its last request.  Within a
    micro-batch a key's requests are folded in order of time and id, as two
    columns of numbers; how much a micro-batch brings is set by its source
    (``maxFilesPerTrigger``).
    """
    kind = dict(events.dtypes)[key]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (burst, None)
        times, ids = zip(*((b["t"].to_numpy(), b["event_id"].to_numpy()) for b in batches))
        t, event = np.concatenate(times), np.concatenate(ids)
        order = np.lexsort((event, t))
        t, event, ok = t[order], event[order], np.empty(len(t), bool)
        for i, now in enumerate(t.tolist()):
            tokens = burst if last is None else min(burst, tokens + max(0.0, now - last) * rate)
            last = now
            ok[i] = tokens >= 1
            tokens -= float(ok[i])
        state.update((float(tokens), float(last)))
        for a in range(0, len(t), 10_000):
            yield pd.DataFrame({key: k[0], "event_id": event[a : a + 10_000], "allowed": ok[a : a + 10_000]})

    rows = events.select(key, "event_id", F.unix_micros(ts).cast("double").__truediv__(1e6).alias("t"))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, event_id bigint, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)
