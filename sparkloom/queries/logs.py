"""Log operators on events as an operation log, conversations as boards and order lines as stacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import adapters as A
from ..operators import logs as L
from ..streaming import logs as S
from .base import Registry, Tables

query = Registry()


@query("sc14_newest_entries", f"WITH {A.HISTORY} SELECT * FROM history ORDER BY seq DESC LIMIT 100")
def _(t: Tables) -> DataFrame:
    return L.newest(A.history(t), 100)


@query("ag10_latency_percentiles", """WITH s AS (SELECT event_type AS "group", list_sort(list(value)) AS v, count(value) AS n, sum(value) AS total FROM events WHERE value IS NOT NULL GROUP BY event_type)
SELECT "group", n, round(v[1], 4) AS min, round(total / n, 4) AS avg, round(v[CAST(floor((n - 1) * 0.5 + 0.5) AS BIGINT) + 1], 4) AS p50, round(v[CAST(floor((n - 1) * 0.95 + 0.5) AS BIGINT) + 1], 4) AS p95, round(v[n], 4) AS max, round(total, 4) AS total FROM s""")
def _(t: Tables) -> DataFrame:
    return L.latency_stats(t.events, "event_type", "value")


_CHAIN_COLUMNS = ("seq", "ts", "actor_id", "operation", "input")
_CHAIN = f"""WITH RECURSIVE {A.HISTORY}, bodies AS (SELECT *, seq || '|' || ts || '|' || actor_id || '|' || operation || '|' || coalesce(input, '') AS body, row_number() OVER (PARTITION BY actor_id ORDER BY seq) AS nth FROM history),
chained AS (SELECT seq, ts, actor_id, operation, input, nth, sha256(body || '|') AS entry_hash, NULL::VARCHAR AS prev_hash FROM bodies WHERE nth = 1
 UNION ALL SELECT b.seq, b.ts, b.actor_id, b.operation, b.input, b.nth, sha256(b.body || '|' || c.entry_hash), c.entry_hash FROM chained c JOIN bodies b ON b.actor_id = c.actor_id AND b.nth = c.nth + 1)"""


@query("w6_hash_chain", f"{_CHAIN} SELECT seq, entry_hash, prev_hash FROM chained")
def _(t: Tables) -> DataFrame:
    return L.chain(A.history(t), _CHAIN_COLUMNS, "actor_id").select("seq", "entry_hash", "prev_hash")


@query("w6_verify_chain", f"""{_CHAIN}, tampered AS (SELECT *, CASE WHEN seq % 1000 = 7 THEN 'forged' ELSE operation END AS op, CASE WHEN seq % 1000 = 13 THEN sha256('cut') ELSE prev_hash END AS prev FROM chained),
checked AS (SELECT actor_id, seq, entry_hash <> sha256(seq || '|' || ts || '|' || actor_id || '|' || op || '|' || coalesce(input, '') || '|' || coalesce(prev, '')) OR prev IS DISTINCT FROM lag(entry_hash) OVER (PARTITION BY actor_id ORDER BY seq) AS bad FROM tampered)
SELECT actor_id, count(*) AS entries, min(CASE WHEN bad THEN seq END) AS first_bad, count(*) FILTER (bad) = 0 AS valid FROM checked GROUP BY actor_id""")
def _(t: Tables) -> DataFrame:
    chained = L.chain(A.history(t), _CHAIN_COLUMNS, "actor_id")
    forged = chained.withColumns({"operation": F.when(F.col("seq") % 1000 == 7, "forged").otherwise(F.col("operation")), "prev_hash": F.when(F.col("seq") % 1000 == 13, F.sha2(F.lit("cut"), 256)).otherwise(F.col("prev_hash"))})
    return L.verify_chain(forged, _CHAIN_COLUMNS, "actor_id")


@query("w7_checkpoints", f"WITH {A.HISTORY} SELECT actor_id, seq, entries FROM (SELECT actor_id, seq, CAST(row_number() OVER (PARTITION BY actor_id ORDER BY seq) AS INTEGER) AS entries FROM history) WHERE entries % 5 = 0")
def _(t: Tables) -> DataFrame:
    return L.checkpoints(A.history(t), 5, "actor_id").select("actor_id", "seq", "entries")


@query("w10_recency", f"WITH {A.HISTORY}, last AS (SELECT actor_id, operation, max(seq) AS seq FROM history GROUP BY ALL) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY actor_id ORDER BY seq DESC) AS INTEGER) AS rank FROM last) WHERE rank <= 3")
def _(t: Tables) -> DataFrame:
    return L.recency(A.history(t), "actor_id", "operation", 3)


@query("w11_latest", f"WITH {A.HISTORY} SELECT actor_id, arg_max(operation, seq) AS operation, max(seq) AS seq FROM history GROUP BY actor_id")
def _(t: Tables) -> DataFrame:
    return L.latest(A.history(t), "actor_id", "operation", "seq")


@query("w5_dedup_best", "WITH d AS (SELECT event_id AS seq, event_type AS message, user_id % 5 AS line, user_id % 3 AS \"column\", 'error' AS severity, CASE event_id % 3 WHEN 0 THEN 'semantic' WHEN 1 THEN 'syntax' ELSE 'lint' END AS source FROM events) SELECT seq, message, line, \"column\", severity, source FROM (SELECT *, row_number() OVER (PARTITION BY message, line, \"column\", severity ORDER BY CASE source WHEN 'semantic' THEN 2 WHEN 'syntax' THEN 1 ELSE 0 END DESC, seq) AS nth FROM d) WHERE nth = 1")
def _(t: Tables) -> DataFrame:
    u, e = F.col("user_id"), F.col("event_id")
    d = t.events.select(e.alias("seq"), F.col("event_type").alias("message"), (u % 5).alias("line"), (u % 3).alias("column"), F.lit("error").alias("severity"), F.when(e % 3 == 0, "semantic").when(e % 3 == 1, "syntax").otherwise("lint").alias("source"))
    return L.dedup_diagnostics(d)


@query("t8_pagination", "SELECT doc_id, source FROM documents ORDER BY source, doc_id LIMIT 30 OFFSET 40")
def _(t: Tables) -> DataFrame:
    return L.paginate(t.documents.select("doc_id", "source"), ["source", "doc_id"], 40, 30)


@query("w9_telescope", "WITH w AS (SELECT item_id, string_split(text, ' ') AS f FROM benchmark) SELECT item_id, array_to_string(CASE WHEN len(f) > 5 THEN list_concat(list_concat(f[1:3], ['...']), f[-2:]) ELSE f END, ' ') AS frames FROM w")
def _(t: Tables) -> DataFrame:
    frames = F.split("text", " ")
    return t.benchmark.select("item_id", F.array_join(L.telescope(frames), " ").alias("frames"))


@query("ag13_frame_weights", "WITH s AS (SELECT string_split(c_mktsegment || ';' || c_nationkey || ';' || (c_custkey % 13), ';') AS path, c_custkey % 7 + 1 AS weight FROM customer) SELECT frame, CAST(sum(weight) AS BIGINT) AS weight FROM (SELECT unnest(path) AS frame, weight FROM s) GROUP BY frame")
def _(t: Tables) -> DataFrame:
    lines = t.customer.select(F.concat_ws(" ", F.concat_ws(";", "c_mktsegment", F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 13).cast("string")), (F.col("c_custkey") % 7 + 1).cast("string")).alias("line"))
    return L.frame_weights(L.parse_folded(lines))


@query("j21_t9_profile_diff", "WITH a AS (SELECT event_type AS frame, count(*) AS w FROM events WHERE ts < TIMESTAMP '2024-01-15' AND event_type <> 'click' GROUP BY 1), b AS (SELECT event_type AS frame, count(*) AS w FROM events WHERE ts >= TIMESTAMP '2024-01-15' AND event_type <> 'view' GROUP BY 1) SELECT coalesce(a.frame, b.frame) AS frame, coalesce(a.w, 0) AS old, coalesce(b.w, 0) AS new, coalesce(b.w, 0) - coalesce(a.w, 0) AS delta FROM a FULL JOIN b ON a.frame = b.frame")
def _(t: Tables) -> DataFrame:
    weights = lambda df: df.groupBy(F.col("event_type").alias("frame")).agg(F.count("*").alias("weight"))
    return L.profile_diff(weights(t.events.where("ts < timestamp_ntz '2024-01-15' and event_type <> 'click'")), weights(t.events.where("ts >= timestamp_ntz '2024-01-15' and event_type <> 'view'")))


@query("j19_provenance", f"WITH {A.HISTORY} SELECT ts, operation, input, success FROM history WHERE actor_id = '17'")
def _(t: Tables) -> DataFrame:
    return L.provenance(A.history(t).withColumnRenamed("actor_id", "transaction_id"), "17")


@query("ag14_board_status", "SELECT role AS status, count(*) AS n FROM conversations GROUP BY role")
def _(t: Tables) -> DataFrame:
    return L.status_counts(t.conversations.withColumnRenamed("role", "status"))


@query("ag18_frequent_failures", "SELECT props, count(*) AS n FROM events WHERE event_type = 'error' AND props IS NOT NULL GROUP BY props ORDER BY n DESC, props LIMIT 5")
def _(t: Tables) -> DataFrame:
    return L.frequent(t.events.where("event_type = 'error'"), "props")


@query("pl10_resources", "SELECT event_id, 'key:' || (props::JSON ->> '$.k') AS resources FROM events")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.array_join(L.resources(F.col("props"), {"k": "key", "path": "file"}), ",").alias("resources"))


@query("st5_edit_loop", f"WITH {A.HISTORY} SELECT seq, actor_id, recent FROM (SELECT seq, actor_id, count(*) OVER (PARTITION BY actor_id ORDER BY ts RANGE BETWEEN 36000 PRECEDING AND CURRENT ROW) AS recent FROM history) WHERE recent >= 3")
def _(t: Tables) -> DataFrame:
    return L.edit_loops(A.history(t), "actor_id", 36_000, 3).select("seq", "actor_id", "recent")


@query("st4_st6_stalls", f"WITH {A.HISTORY} SELECT seq, actor_id, gap FROM (SELECT seq, actor_id, ts - lag(ts) OVER (PARTITION BY actor_id ORDER BY ts, seq) AS gap FROM history) WHERE gap > 86400")
def _(t: Tables) -> DataFrame:
    return L.stalls(A.history(t), "actor_id", 86_400).select("seq", "actor_id", "gap")


@query("st6_fault_regressions", "WITH c AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'error') AS faults FROM events GROUP BY ALL) SELECT user_id, strftime(day, '%Y-%m-%d') AS day, faults, before FROM (SELECT *, lag(faults, 1, 0) OVER (PARTITION BY user_id ORDER BY day) AS before FROM c) WHERE faults > before")
def _(t: Tables) -> DataFrame:
    counts = t.events.groupBy("user_id", F.to_date("ts").alias("ts")).agg(F.count_if(F.col("event_type") == "error").alias("faults"))
    return S.fault_regressions(counts, "user_id").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "faults", "before")


@query("st7_stale_claims", "WITH b AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'claimed' ELSE 'done' END AS status, 'w' || (conv_id % 3) AS worker, turn * 100 AS heartbeat, 0 AS requeue_count FROM conversations) SELECT conv_id, turn, CASE WHEN stale THEN 'pending' ELSE status END AS status, CASE WHEN NOT stale THEN worker END AS worker, heartbeat, CAST(requeue_count + CASE WHEN stale THEN 1 ELSE 0 END AS INTEGER) AS requeue_count FROM (SELECT *, status = 'claimed' AND 500 - heartbeat > 300 AS stale FROM b)")
def _(t: Tables) -> DataFrame:
    board = t.conversations.select("conv_id", "turn", F.when(F.col("role") == "user", "claimed").otherwise("done").alias("status"), F.concat(F.lit("w"), (F.col("conv_id") % 3).cast("string")).alias("worker"), (F.col("turn") * 100).alias("heartbeat"), F.lit(0).alias("requeue_count"))
    return L.stale_claims(board, F.lit(500))


@query("st8_frontier", "WITH q AS (SELECT user_id % 9 AS queue, event_type AS item, min(event_id) AS seq FROM events GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY queue ORDER BY seq, item) AS INTEGER) AS place FROM q")
def _(t: Tables) -> DataFrame:
    return L.first_seen(t.events.select((F.col("user_id") % 9).alias("queue"), F.col("event_type").alias("item"), F.col("event_id").alias("seq")), "item")


@query("st10_budgets", f"WITH {A.HISTORY} SELECT seq, actor_id, CAST(sum(floor(length(coalesce(input, '')) / 4)) OVER w AS BIGINT) AS tokens, CAST(sum(CASE WHEN operation = 'error' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS hazardous, ts - min(ts) OVER w AS elapsed FROM history WINDOW w AS (PARTITION BY actor_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def _(t: Tables) -> DataFrame:
    return L.budgets(A.history(t).withColumn("hazard", F.col("operation") == "error"), "actor_id").select("seq", "actor_id", "tokens", "hazardous", "elapsed")


@query("st3_progress", "SELECT o_orderkey AS id, o_orderkey % 100 AS done, 100::BIGINT AS total FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, NULL, NULL FROM orders WHERE o_orderkey % 2 = 1")
def _(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    text = F.when(k % 2 == 0, F.concat(F.lit("step: Indexing: "), (k % 100).cast("string"), F.lit("/100 files"))).otherwise("idle")
    done, total = L.parse_progress(F.col("text"))
    return t.orders.select(k.alias("id"), text.alias("text")).select("id", done.alias("done"), total.alias("total"))


@query("pl8_retention", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS nth FROM orders) WHERE nth > 5")
def _(t: Tables) -> DataFrame:
    return L.retention(t.orders, ["o_custkey"], "o_orderkey", 5).select("o_orderkey")


@query("ag19_counts", "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents")
def _(t: Tables) -> DataFrame:
    counted = lambda name: getattr(t, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return counted("orders").union(counted("events")).union(counted("documents"))


@query("ag17_workspace_bytes", "SELECT CAST(sum(strlen(text)) AS BIGINT) AS bytes, count(*) AS files FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("files"))
