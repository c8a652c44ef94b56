from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from sparkloom.streaming import logs as L, run as R


def folder(spark, tmp_path, schema, *batches):
    """A file for each batch, read one at a time."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return L.event_stream(spark, f"{tmp_path}/in", schema, files_per_trigger=1)


def at(minute, second=0):
    return dt.datetime(2024, 1, 1, 12, minute, second)


def test_stalls(spark, tmp_path):
    rows = [[("a", at(0)), ("b", at(0))], [("b", at(0, 10))], [("b", at(0, 20))], [("c", at(30))], [("c", at(59))]]
    stream = folder(spark, tmp_path, "key string, ts timestamp", *rows).withWatermark("ts", "1 second")
    found = R.available_now(L.stall_alerts(stream, "key", 15))
    assert {(r["key"], r["last_ts"].second) for r in found.collect() if r["key"] in "ab"} == {("a", 0), ("b", 20)}


def test_board(spark, tmp_path):
    schema = "node string, action string, worker string, ts timestamp"
    rows = [[("n", "claim", "w", at(0)), ("m", "claim", "w", at(0))], [("m", "done", "w", at(1))], [("x", "add", None, at(30))], [("x", "add", None, at(59))]]
    stream = folder(spark, tmp_path, schema, *rows).withWatermark("ts", "1 second")
    states = []
    query = L.claim_board(stream).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(lambda b, n: states.extend(b.collect())).start()
    query.awaitTermination()
    last = {}
    for r in states:
        last[r["node"]] = (r["status"], r["requeues"])
    assert last["n"] == ("pending", 1) and last["m"] == ("done", 0)


def test_first_seen_and_refresh(spark, tmp_path):
    stream = folder(spark, tmp_path, "item string, ts timestamp", [("a", at(0)), ("b", at(0))], [("a", at(1)), ("c", at(1))])
    assert sorted(r["item"] for r in R.available_now(L.first_seen(stream, "item")).collect()) == ["a", "b", "c"]
    seen = []
    files = folder(spark, tmp_path / "x", "item string, ts timestamp", [("a", at(0))])
    L.refresh_index(files, lambda b, n: seen.append((n, b.count())), f"{tmp_path}/c").start().awaitTermination()
    assert seen == [(0, 1)]


def test_progress_and_sessions(spark, tmp_path):
    stream = folder(spark, tmp_path, "k string, text string, ts timestamp", [("a", "Indexing: 3/9 files", at(0)), ("a", "idle", at(1))], [("b", "Indexing: 9/9 files", at(50))])
    found = R.available_now(L.progress(stream, F.col("text")))
    assert sorted((r["done"], r["total"]) for r in found.collect()) == [(3, 9), (9, 9)]
    assert [(r["k"], r["n"]) for r in R.available_now(L.sessions(stream.drop("text"), "k")).collect()] == [("a", 2)]
