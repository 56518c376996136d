import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomwork.streaming import events as stream

T0 = dt.datetime(2025, 1, 1)
EVENTS = [("a", 0, "write"), ("a", 400, "write"), ("a", 800, "remove"), ("b", 100, "create"), ("a", 1400, "create"), ("b", 2000, "write")]


def rows(spark):
    data = [(i, p, T0 + dt.timedelta(milliseconds=ms), op) for i, (p, ms, op) in enumerate(EVENTS)]
    return spark.createDataFrame(data, "event_id bigint, path string, ts timestamp, op string")


def test_debounce(spark):
    got = {(r["path"], r["n_events"], r["last_op"]) for r in stream.debounce(rows(spark), "path", "ts", "op").collect()}
    assert got == {("a", 3, "remove"), ("a", 1, "create"), ("b", 1, "create"), ("b", 1, "write")}
    last = {r["path"]: r["last_op"] for r in stream.last_operations(rows(spark), "path", "ts", "op", "event_id").collect()}
    assert last == {"a": "create", "b": "write"}


def test_changes(spark):
    store = spark.createDataFrame([("x/a.go", 1), ("x/d/b.go", 1), ("xd/c.go", 1), ("m.md", 1)], "path string, v int")
    ev = spark.createDataFrame([("x", T0, "remove"), ("m.md", T0, "write"), ("n.ts", T0, "create"), ("o.bin", T0, "write")], "path string, ts timestamp, op string")
    fresh = spark.createDataFrame([("m.md", 2), ("n.ts", 2), ("o.bin", 2), ("p.go", 2)], "path string, v int")
    assert {(r["path"], r["v"]) for r in stream.apply_changes(store, ev, fresh).collect()} == {("xd/c.go", 1), ("m.md", 2), ("n.ts", 2)}


def test_stream_equals_batch_and_bucket(spark, tmp_path):
    events = rows(spark).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    live = stream.stream_events(spark, str(tmp_path))
    got = stream.run_to_folder(stream.debounce(live.withWatermark("ts", "1 hour"), "path", "ts", "op"), str(tmp_path / "c1"), "complete")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, stream.debounce(rows(spark), "path", "ts", "op").collect()), key=str)
    seen = []
    out = stream.run_to_folder(stream.token_bucket(live, "path", "ts", 1.0, 2.0), str(tmp_path / "c2"), hooks=[lambda rows, n: seen.append((n, rows.count()))])
    assert sum(n for _, n in seen) == len(EVENTS)
    allowed = {r["event_id"]: r["allowed"] for r in out.collect()}
    tokens, last, want = {"a": 2.0, "b": 2.0}, {}, {}
    for i, (p, ms, _) in enumerate(EVENTS):
        t = ms / 1000
        tokens[p] = min(2.0, tokens[p] + (t - last.get(p, t)) * 1.0)
        last[p] = t
        want[i] = tokens[p] >= 1
        tokens[p] -= want[i]
    assert allowed == want
    with pytest.raises(Exception):
        stream.stream_events(spark, str(tmp_path / "absent"))


def test_changes_as_a_stream(spark, tmp_path):
    store = str(tmp_path / "store")
    spark.createDataFrame([("x/a.go", 1), ("m.md", 1), ("k.py", 1)], "path string, v int").write.parquet(f"{store}/v=-1")
    ev = [("x/a.go", T0, "remove"), ("m.md", T0, "write"), ("n.ts", T0, "create")]
    spark.createDataFrame(ev, "path string, ts timestamp, op string").coalesce(1).write.parquet(str(tmp_path / "ev"))
    live = spark.readStream.schema("path string, ts timestamp, op string").parquet(str(tmp_path / "ev"))
    hooked = []
    last = stream.stream_changes(live, store, lambda rows: rows.select("path").distinct().withColumn("v", F.lit(2)), str(tmp_path / "p"), [lambda rows, n: hooked.append(rows.count())])
    assert {tuple(r) for r in spark.read.parquet(last).collect()} == {("m.md", 2), ("n.ts", 2), ("k.py", 1)} and hooked == [3]
