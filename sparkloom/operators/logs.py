"""Operation logs, in batch form: newest entries, chains, checkpoints, latencies, recency, stacks, boards, budgets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .lineage import cut


def newest(log: DataFrame, limit: int) -> DataFrame:
    """SC14, SC15: the last entries by seq."""
    return log.orderBy(F.desc("seq")).limit(limit)


#: Rank error of the sketches, as a share of a group's values, and groups that may be broadcast.
RANK_ERROR, BROADCAST_GROUPS = 1e-4, 100_000


def latency_stats(samples: DataFrame, group: str, value: str, digits: int = 4) -> DataFrame:
    """AG10: n, min, avg, p50, p95, max and total; a percentile is the element at round((n - 1) * q) of the sorted values.

    A mergeable sketch brackets each percentile; what lies below a bracket is only counted, and only the few values within it are
    sorted, so no task sorts a group."""
    rows = samples.where(F.col(value).isNotNull()).select(F.col(group).alias("group"), F.col(value).alias("v"))
    quantiles, margin = (0.5, 0.95), 5 * RANK_ERROR
    places = [min(1.0, max(0.0, q + m)) for q in quantiles for m in (-margin, margin)]
    sketch = rows.groupBy("group").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.min("v").alias("min"), F.max("v").alias("max"), F.percentile_approx("v", places, int(1 / RANK_ERROR)).alias("p"))
    sketch = cut(sketch.select("*", *(F.floor((F.col("n") - 1) * F.lit(q) + 0.5).alias(f"r{k}") for k, q in enumerate(quantiles))))
    known = F.broadcast(sketch) if sketch.count() <= BROADCAST_GROUPS else sketch
    rows = rows.join(known.select(F.col("group").alias("own"), "p", "r0", "r1"), F.col("group").eqNullSafe(F.col("own"))).drop("own")
    low, high = lambda k: F.col("p")[2 * k], lambda k: F.col("p")[2 * k + 1]
    # values below a bracket count as one, those within it by value
    brackets = F.array(*(F.when(F.col("v") <= high(k), F.struct(F.lit(k).alias("k"), F.when(F.col("v") >= low(k), F.col("v")).alias("at"), F.col(f"r{k}").alias("rank"))) for k in range(len(quantiles))))
    counts = rows.select("group", F.explode(F.array_compact(brackets)).alias("x")).groupBy("group", "x.k", "x.at", "x.rank").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("group", "k").orderBy(F.asc_nulls_first("at")).rowsBetween(Window.unboundedPreceding, 0))
    found = counts.withColumn("upto", upto).where(F.col("at").isNotNull() & (F.col("upto") > F.col("rank"))).groupBy("group").agg(*(F.min(F.when(F.col("k") == k, F.col("at"))).alias(f"q{k}") for k in range(len(quantiles))))
    own = sketch.alias("s").join(found.alias("f"), F.col("s.group").eqNullSafe(F.col("f.group")))
    return own.select(F.col("s.group").alias("group"), "n", F.round("min", digits).alias("min"), F.round(F.col("total") / F.col("n"), digits).alias("avg"), F.round("q0", digits).alias("p50"), F.round("q1", digits).alias("p95"), F.round("max", digits).alias("max"), F.round("total", digits).alias("total"))


def entry_text(*columns: str) -> Column:
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))


def entry_hash(*columns: str) -> Column:
    """A row's hash: of its columns and of prev_hash, so that no entry can be changed without all after it."""
    return F.sha2(entry_text(*columns, "prev_hash"), 256)


def chain(log: DataFrame, columns: Sequence[str], by: str) -> DataFrame:
    """A log with entry_hash of each row, which covers prev_hash, that of the one before by seq in its ``by`` group.

    A group is hashed in order, row by row with one hash in memory; groups go in parallel, so give one that bounds a chain."""
    schema = T.StructType([*log.schema.fields, T.StructField("entry_hash", T.StringType()), T.StructField("prev_hash", T.StringType())])
    place = log.columns.index(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last = None, None
        for batch in batches:
            own, before = [], []
            for name, text in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if (name,) != group:
                    group, last = (name,), None
                before.append(last)
                last = hashlib.sha256(f"{text}|{last or ''}".encode()).hexdigest()
                own.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(own, pa.string()), pa.array(before, pa.string())], names=[*batch.schema.names[:-1], "entry_hash", "prev_hash"])

    ordered = log.withColumn("entry text", entry_text(*columns)).repartition(by).sortWithinPartitions(by, "seq")
    return ordered.mapInArrow(run, schema)


def verify_chain(log: DataFrame, columns: Sequence[str], by: str) -> DataFrame:
    """(by, entries, valid, first_bad): whether each row's hash is that of its columns and prev_hash, and its prev_hash that of the row before. A row needs no other row's recomputed hash, so rows are checked in parallel."""
    before = F.lag("entry_hash").over(Window.partitionBy(by).orderBy("seq"))
    bad = ~F.col("entry_hash").eqNullSafe(entry_hash(*columns)) | ~F.col("prev_hash").eqNullSafe(F.col("before"))
    return log.withColumn("before", before).groupBy(by).agg(F.count("*").alias("entries"), F.min(F.when(bad, F.col("seq"))).alias("first_bad")).withColumn("valid", F.col("first_bad").isNull())


def checkpoints(log: DataFrame, every: int, by: str) -> DataFrame:
    """Each every-th entry of a group with the number of entries so far."""
    return log.withColumn("entries", F.row_number().over(Window.partitionBy(by).orderBy("seq"))).where(F.col("entries") % every == 0)


def recency(log: DataFrame, by: str, value: str, keep: int) -> DataFrame:
    """Each group's last distinct values, the newest first (rank 1)."""
    last = log.groupBy(by, value).agg(F.max("seq").alias("seq"))
    return last.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("seq")))).where(F.col("rank") <= keep)


def latest(log: DataFrame, by: str, *columns: str) -> DataFrame:
    """Each group's columns of its last entry."""
    return log.groupBy(by).agg(F.max_by(F.struct(*columns), "seq").alias("x")).select(by, "x.*")


#: Sources of diagnostics, the better known first.
SOURCE_SCORES = {"semantic": 2, "syntax": 1}


def dedup_diagnostics(diagnostics: DataFrame, order: str = "seq") -> DataFrame:
    """Of equal (message, line, column, severity) the one of the best source, then the first."""
    score = F.lit(0)
    for name, n in SOURCE_SCORES.items():
        score = F.when(F.col("source") == name, F.lit(n)).otherwise(score)
    w = Window.partitionBy("message", "line", "column", "severity").orderBy(F.desc("score"), order)
    return diagnostics.withColumn("score", score).withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth", "score")


def paginate(rows: DataFrame, order: Sequence[str], offset: int, limit: int) -> DataFrame:
    """T8."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def telescope(frames: Column, head: int = 3, tail: int = 2, marker: str = "...") -> Column:
    """An array's first and last elements with a marker between, if it has more than both."""
    long = F.concat(F.slice(frames, 1, head), F.array(F.lit(marker)), F.slice(frames, -tail, tail))
    return F.when(F.size(frames) > head + tail, long).otherwise(frames)


def frame_weights(stacks: DataFrame) -> DataFrame:
    """AG13: (frame, weight) of folded stacks (path array, weight): each frame's weight over the stacks it stands in."""
    return stacks.select(F.explode("path").alias("frame"), "weight").groupBy("frame").agg(F.sum("weight").alias("weight"))


def parse_folded(lines: DataFrame, column: str = "line") -> DataFrame:
    """(path, weight) of lines ``a;b;c 12``."""
    c = F.col(column)
    return lines.select(F.split(F.regexp_extract(c, r"^(.*) \d+\s*$", 1), ";").alias("path"), F.regexp_extract(c, r" (\d+)\s*$", 1).cast("long").alias("weight")).where("weight is not null")


def profile_diff(before: DataFrame, after: DataFrame, limit: int | None = None) -> DataFrame:
    """Frames by how much their weight changed, the greatest change first."""
    joined = before.withColumnRenamed("weight", "old").join(after.withColumnRenamed("weight", "new"), "frame", "full_outer").fillna(0, ["old", "new"])
    found = joined.withColumn("delta", F.col("new") - F.col("old")).orderBy(F.desc(F.abs("delta")), "frame")
    return found.limit(limit) if limit else found


def provenance(log: DataFrame, transaction: str) -> DataFrame:
    """Entries of a transaction."""
    return log.where(F.col("transaction_id") == transaction).select("ts", "operation", "input", "success")


def status_counts(board: DataFrame) -> DataFrame:
    """AG14."""
    return board.groupBy("status").agg(F.count("*").alias("n"))


def frequent(samples: DataFrame, column: str, limit: int = 5) -> DataFrame:
    """AG18: the most frequent values."""
    return samples.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(limit)


#: Keys of log payloads that name resources, with the prefix of each, fixed values.
RESOURCE_KEYS = {"uri": "symbol", "path": "file", "file": "file", "plan_id": "plan", "transaction_id": "transaction", "proposal_id": "proposal", "node_id": "node", "session_id": "session", "alias": "context"}


def resources(payload: Column, keys: dict[str, str] | None = None) -> Column:
    """PL10: resources that a JSON object names at its top level, each with its prefix."""
    found = [F.concat(F.lit(f"{prefix}:"), F.get_json_object(payload, f"$.{key}")) for key, prefix in (keys or RESOURCE_KEYS).items()]
    return F.array_compact(F.array(*found))


def edit_loops(log: DataFrame, by: str, seconds: int = 300, alert: int = 5) -> DataFrame:
    """ST5: entries with the number of their group's entries in the last seconds, themselves included, from ``alert`` on."""
    w = Window.partitionBy(by).orderBy("ts").rangeBetween(-seconds, 0)
    return log.withColumn("recent", F.count("*").over(w)).where(F.col("recent") >= alert)


def stalls(log: DataFrame, by: str, seconds: int) -> DataFrame:
    """ST4, ST6: entries that come more than seconds after the one before in their group."""
    gap = F.col("ts") - F.lag("ts").over(Window.partitionBy(by).orderBy("ts", "seq"))
    return log.withColumn("gap", gap).where(F.col("gap") > seconds)


def stale_claims(board: DataFrame, now: Column, seconds: int = 300) -> DataFrame:
    """ST7: board rows (status, heartbeat, requeue_count): claims without a heartbeat for long go back to pending."""
    stale = (F.col("status") == "claimed") & (now - F.col("heartbeat") > seconds)
    return board.withColumns({"requeue_count": F.col("requeue_count") + F.when(stale, 1).otherwise(0), "worker": F.when(~stale, F.col("worker")), "status": F.when(stale, "pending").otherwise(F.col("status"))})


def first_seen(queue: DataFrame, item: str, order: str = "seq") -> DataFrame:
    """ST8: each item once, where it first stood, numbered in that order within its ``queue``."""
    first = queue.groupBy("queue", item).agg(F.min(order).alias(order))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("queue").orderBy(order, item)))


def budgets(log: DataFrame, by: str) -> DataFrame:
    """ST10: running tokens (a quarter of the payload's length), hazardous calls and duration of a connection."""
    w = Window.partitionBy(by).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumns({
        "tokens": F.sum(F.floor(F.coalesce(F.length("input"), F.lit(0)) / 4)).over(w),
        "hazardous": F.sum(F.col("hazard").cast("int")).over(w),
        "elapsed": F.col("ts") - F.min("ts").over(w),
    })


def parse_progress(text: Column) -> tuple[Column, Column]:
    """ST3: (done, total) of ``Indexing: a/b files``."""
    part = lambda k: F.try_to_number(F.nullif(F.regexp_extract(text, r"Indexing: (\d+)/(\d+) files", k), F.lit("")), F.lit("9999999999")).cast("long")
    return part(1), part(2)


def retention(rows: DataFrame, by: Sequence[str], order: str, keep: int) -> DataFrame:
    """PL8: rows beyond the newest ``keep`` of their group, which go."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    return rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") > keep).drop("nth")
