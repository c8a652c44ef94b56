"""Graphs, spans, logs and snapshots derived from the test tables, each with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .queries.base import Tables


def _edge(src_letter: str, src: str, dst_letter: str, dst: str, kind: str, tier: str) -> list:
    key = F.col(src).cast("long")
    return [
        F.concat(F.lit(src_letter), F.col(src).cast("string")).alias("src"),
        F.concat(F.lit(dst_letter), F.col(dst).cast("string")).alias("dst"),
        F.lit(kind).alias("kind"),
        F.lit(tier).alias("tier"),
        F.round(F.lit(0.5) + (key % 50) / F.lit(100.0), 2).alias("confidence"),
        F.when(key % 3 != 0, F.lit("fk_scan")).alias("source"),
    ]


_FK = (
    ("orders", "o", "o_orderkey", "c", "o_custkey", "placed_by", "semantic"),
    ("customer", "c", "c_custkey", "n", "c_nationkey", "lives_in", "structural"),
    ("supplier", "s", "s_suppkey", "n", "s_nationkey", "based_in", "structural"),
    ("nation", "n", "n_nationkey", "r", "n_regionkey", "ffi_part_of", "bridge"),
)


def fk_edges(t: Tables) -> DataFrame:
    """Property graph of foreign keys: order to customer to nation to region, supplier to nation."""
    out = None
    for table, a, src, b, dst, kind, tier in _FK:
        part = getattr(t, table).select(*_edge(a, src, b, dst, kind, tier))
        out = part if out is None else out.unionByName(part)
    return out


FK_EDGES = "fk_edges AS (" + " UNION ALL ".join(
    f"SELECT '{a}' || {src} AS src, '{b}' || {dst} AS dst, '{kind}' AS kind, '{tier}' AS tier, round(0.5 + (CAST({src} AS BIGINT) % 50) / 100.0, 2) AS confidence, CASE WHEN {src} % 3 <> 0 THEN 'fk_scan' END AS source FROM {table}"
    for table, a, src, b, dst, kind, tier in _FK
) + ")"

_NODES = (("customer", "c", "c_custkey", "c_name", "function"), ("supplier", "s", "s_suppkey", "s_name", "struct"), ("nation", "n", "n_nationkey", "n_name", "module"))


def fk_nodes(t: Tables) -> DataFrame:
    """Symbol-like rows of customers, suppliers and nations; regions and orders have none."""
    out = None
    for table, letter, key, name, kind in _NODES:
        part = getattr(t, table).select(F.concat(F.lit(letter), F.col(key).cast("string")).alias("id"), F.col(name).alias("name"), F.lit(kind).alias("kind"), F.lit(table).alias("filepath"))
        out = part if out is None else out.unionByName(part)
    return out


FK_NODES = "fk_nodes AS (" + " UNION ALL ".join(f"SELECT '{letter}' || {key} AS id, {name} AS name, '{kind}' AS kind, '{table}' AS filepath FROM {table}" for table, letter, key, name, kind in _NODES) + ")"


def transitions(t: Tables) -> DataFrame:
    """Cyclic graph of event types that follow each other for a user; confidence is the share of what leaves the type."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = t.events.select(F.col("event_type").alias("src"), F.lead("event_type").over(w).alias("dst")).where("dst is not null and src <> dst")
    counts = pairs.groupBy("src", "dst").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("src"))
    return counts.select("src", "dst", F.lit("then").alias("kind"), F.lit("semantic").alias("tier"), F.round(F.col("n") / total, 4).alias("confidence"), F.lit("events").alias("source"))


TRANSITIONS = """pairs AS (SELECT src, dst FROM (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL AND src <> dst),
pair_counts AS (SELECT src, dst, count(*) AS n FROM pairs GROUP BY src, dst),
transitions AS (SELECT src, dst, 'then' AS kind, 'semantic' AS tier, round(n / sum(n) OVER (PARTITION BY src), 4) AS confidence, 'events' AS source FROM pair_counts)"""


def documents_as_symbols(t: Tables) -> DataFrame:
    """Documents as searchable symbols: the text is the name, the source the path, the language the kind."""
    return t.documents.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("name"), F.col("source").alias("filepath"), F.col("lang").alias("kind"))


def line_spans(t: Tables) -> DataFrame:
    """Each document's lines as spans [start, end) of characters, with the document itself as the outer span."""
    lines = t.documents.select(F.col("doc_id").cast("string").alias("file"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    before = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.select("file", "line_no", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("long").alias("start"), F.length("line").cast("long").alias("len"))
    inner = lines.where("len > 0").select("file", F.concat_ws(":", "file", F.col("line_no").cast("string")).alias("id"), F.lit("function").alias("kind"), "start", (F.col("start") + F.col("len")).alias("end"))
    outer = t.documents.select(F.col("doc_id").cast("string").alias("file"), F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("id"), F.lit("module").alias("kind"), F.lit(-1).cast("long").alias("start"), F.length("text").cast("long").alias("end"))
    return inner.unionByName(outer)


LINE_SPANS = """doc_lines AS (SELECT CAST(doc_id AS VARCHAR) AS file, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents),
starts AS (SELECT file, line_no, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, length(line) AS len FROM doc_lines),
spans AS (SELECT file, file || ':' || line_no AS id, 'function' AS kind, start, start + len AS "end" FROM starts WHERE len > 0
 UNION ALL SELECT CAST(doc_id AS VARCHAR), 'doc:' || doc_id, 'module', -1, length(text) FROM documents)"""


def history(t: Tables) -> DataFrame:
    """Events as log rows in order of seq."""
    return t.events.select(
        F.col("event_id").alias("seq"), F.unix_timestamp("ts").alias("ts"), F.col("user_id").cast("string").alias("actor_id"), F.col("event_type").alias("operation"), F.col("props").alias("input"), (F.col("event_type") != "error").alias("success"), "value"
    )


HISTORY = "history AS (SELECT event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) AS ts, CAST(user_id AS VARCHAR) AS actor_id, event_type AS operation, props AS input, event_type <> 'error' AS success, value FROM events)"


def snapshots(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(path, hash) of orders before and after: a tenth is removed, a tenth added, some are changed."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    path = F.concat(F.lit("orders/"), key.cast("string")).alias("path")
    before = t.orders.where(key % 10 != 0).select(path, F.sha2(price, 256).alias("hash"))
    after = t.orders.where(key % 10 != 1).select(path, F.sha2(F.when(key % 7 == 0, F.concat(price, F.lit("!"))).otherwise(price), 256).alias("hash"))
    return before, after


SNAPSHOTS = """before AS (SELECT 'orders/' || o_orderkey AS path, sha256(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)) AS hash FROM orders WHERE o_orderkey % 10 <> 0),
after AS (SELECT 'orders/' || o_orderkey AS path, sha256(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || CASE WHEN o_orderkey % 7 = 0 THEN '!' ELSE '' END) AS hash FROM orders WHERE o_orderkey % 10 <> 1)"""


def edge_versions(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The foreign-key graph before and after: some edges removed, added, and changed in confidence, tier or source."""
    e, number = fk_edges(t), F.regexp_extract("src", "[0-9]+", 0).cast("long")
    before = e.where(number % 11 != 0)
    after = e.where(number % 11 != 1).withColumns({
        "confidence": F.when(number % 5 == 0, F.round(F.col("confidence") - 0.05, 2)).otherwise(F.col("confidence")),
        "tier": F.when(number % 13 == 0, F.lit("heuristic")).otherwise(F.col("tier")),
        "source": F.when(number % 17 == 0, F.lit("rescan")).otherwise(F.col("source")),
    })
    return before, after


EDGE_VERSIONS = f"""{FK_EDGES},
numbered AS (SELECT *, CAST(regexp_extract(src, '[0-9]+') AS BIGINT) AS k FROM fk_edges),
edges_before AS (SELECT src, dst, kind, tier, confidence, source FROM numbered WHERE k % 11 <> 0),
edges_after AS (SELECT src, dst, kind, CASE WHEN k % 13 = 0 THEN 'heuristic' ELSE tier END AS tier, CASE WHEN k % 5 = 0 THEN round(confidence - 0.05, 2) ELSE confidence END AS confidence, CASE WHEN k % 17 = 0 THEN 'rescan' ELSE source END AS source FROM numbered WHERE k % 11 <> 1)"""
