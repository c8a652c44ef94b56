"""Streaming forms of the log operators: events in, alerts and boards out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import StructType


def event_stream(spark: SparkSession, path: str, schema: StructType | str, kind: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """ST1: a folder of events as a stream; ids come from the files, so no event is lost to a slow reader."""
    reader = spark.readStream.format(kind).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def progress(events: DataFrame, text: Column) -> DataFrame:
    """ST3: done and total of ``Indexing: a/b files``, stateless."""
    from ..operators.logs import parse_progress

    done, total = parse_progress(text)
    return events.withColumns({"done": done, "total": total}).where("done is not null")


def edit_alerts(events: DataFrame, by: str, window: str = "5 minutes", slide: str = "1 minute", alert: int = 5, delay: str = "10 minutes") -> DataFrame:
    """ST5: windows in which a key has at least ``alert`` events."""
    counts = events.withWatermark("ts", delay).groupBy(F.window("ts", window, slide), by).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= alert).select(by, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n")


def sessions(events: DataFrame, by: str, gap: str = "20 minutes", delay: str = "10 minutes") -> DataFrame:
    """ST6: runs of a key's events without a gap; where one ends, the key has stagnated."""
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), by).agg(F.count("*").alias("n")).select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def fault_regressions(counts: DataFrame, by: str) -> DataFrame:
    """ST6: rows of counts (by, ts, faults) that have more faults than the one before; the first one counts against none."""
    before = F.lag("faults", 1, 0).over(Window.partitionBy(by).orderBy("ts"))
    return counts.withColumn("before", before).where("faults > before")


def running_budgets(events: DataFrame, by: str) -> DataFrame:
    """ST10: tokens (a quarter of the payload's length), hazardous calls and calls of each connection so far."""
    return events.groupBy(by).agg(F.sum(F.floor(F.coalesce(F.length("input"), F.lit(0)) / 4)).alias("tokens"), F.count_if("hazard").alias("hazardous"), F.count("*").alias("calls"))


def stall_alerts(events: DataFrame, by: str, seconds: int = 15) -> DataFrame:
    """ST4: (by, last_ts): keys without progress for that long by the watermark; events need column ts with a watermark."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({by: [key[0]], "last_ms": [last]})
            return
        last = state.get[0] if state.exists else 0
        for batch in batches:
            last = max(last, int(batch["ts"].max().value // 1_000_000))
        state.update((last,))
        state.setTimeoutTimestamp(max(last + 1000 * seconds, state.getCurrentWatermarkMs() + 1))

    kind = dict(events.dtypes)[by]
    found = events.groupBy(by).applyInPandasWithState(run, f"{by} {kind}, last_ms long", "last_ms long", "append", "EventTimeTimeout")
    return found.select(by, F.timestamp_millis("last_ms").alias("last_ts"))


BOARD = "node string, status string, worker string, heartbeat long, requeues long"


def claim_board(events: DataFrame, seconds: int = 300) -> DataFrame:
    """ST7: a row for each change of a node's board state. events: node, action (add, claim, heartbeat, done), worker, ts with a watermark. A claim whose heartbeat stays out is pending again."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, worker, beat, requeues = state.get if state.exists else ("pending", None, 0, 0)
        if state.hasTimedOut:
            status, worker, requeues = "pending", None, requeues + 1
        else:
            rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
            for row in rows.itertuples():
                at = int(row.ts.value // 1_000_000)
                if row.action == "claim" and status == "pending":
                    status, worker, beat = "claimed", row.worker, at
                elif row.action == "heartbeat" and status == "claimed" and row.worker == worker:
                    beat = at
                elif row.action == "done" and status == "claimed" and row.worker == worker:
                    status, beat = "done", at
        state.update((status, worker, beat, requeues))
        if status == "claimed":
            state.setTimeoutTimestamp(max(beat + 1000 * seconds, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"node": [key[0]], "status": [status], "worker": [worker], "heartbeat": [beat], "requeues": [requeues]})

    return events.groupBy("node").applyInPandasWithState(run, BOARD, "status string, worker string, heartbeat long, requeues long", "update", "EventTimeTimeout")


def first_seen(queue: DataFrame, item: str, delay: str = "1 hour") -> DataFrame:
    """ST8: each item once, when it first comes."""
    return queue.withWatermark("ts", delay).dropDuplicatesWithinWatermark([item])


def refresh_index(files: DataFrame, upsert: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """ST9: hands each micro-batch of changed files to upsert(batch, number), which must be idempotent by number: a batch may come again after a failure."""
    return files.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True)
