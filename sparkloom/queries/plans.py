"""Plan operators on conversations as boards and orders as plan nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import adapters as A
from ..operators import graph as G
from ..plans import conflicts as C, dag as D
from .base import Registry, Tables

query = Registry()


@query("j20_target_conflicts", f"WITH {A.FK_EDGES}, t AS (SELECT 'c' || o_custkey AS id FROM orders UNION ALL SELECT 'o' || o_orderkey FROM orders), d AS (SELECT id, count(*) AS n FROM t GROUP BY id) SELECT id AS \"left\", id AS \"right\", 'same' AS reason FROM d WHERE n > 1 UNION ALL SELECT DISTINCT least(src, dst), greatest(src, dst), 'connected' FROM fk_edges WHERE src IN (SELECT id FROM d) AND dst IN (SELECT id FROM d)")
def _(t: Tables) -> DataFrame:
    some = t.orders
    targets = some.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("id")).union(some.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))))
    return C.target_conflicts(targets, A.fk_edges(t))


@query("pl1_batch_levels", "SELECT conv_id || ':' || turn AS id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS level FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) > 1)")
def _(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    some = t.conversations
    ident = lambda c: F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col(c).cast("string"))
    nexts = some.withColumn("after", F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))).where("after is not null")
    return G.topological_levels(nexts.select(ident("turn").alias("src"), ident("after").alias("dst")))


@query("pl3_plan_validation", "WITH n AS (SELECT 'n' || (o_orderkey % 9000) AS id, o_custkey % 40 AS deps, o_orderkey % 5 AS retry_limit, o_orderkey % 11 AS output_limit FROM orders) SELECT id, 'dependencies' AS problem FROM n WHERE deps > 32 UNION ALL SELECT id, 'retries' FROM n WHERE retry_limit > 3 UNION ALL SELECT id, 'output_limit' FROM n WHERE output_limit < 1 UNION ALL SELECT id, 'duplicate' FROM n GROUP BY id HAVING count(*) > 1")
def _(t: Tables) -> DataFrame:
    deps = F.array_repeat(F.lit("d"), (F.col("o_custkey") % 40).cast("int"))
    nodes = t.orders.select(F.concat(F.lit("n"), (F.col("o_orderkey") % 9000).cast("string")).alias("id"), deps.alias("depends_on"), (F.col("o_orderkey") % 5).alias("retry_limit"), (F.col("o_orderkey") % 11).alias("output_limit"))
    return D.validate_table(nodes)


@query("pl7_commit_gate", "WITH r AS (SELECT o_orderkey AS proposal, o_orderkey % 3 AS high, (o_custkey % 10) / 10.0 AS cohesion_ratio, CASE WHEN o_orderkey % 4 = 0 THEN 'bad' ELSE 'ok' END AS simulate, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'ok' END AS crawl, CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 's' END AS gated, CASE WHEN o_orderkey % 7 = 0 THEN 't' ELSE 's' END AS current_ FROM orders), w AS (SELECT proposal, CASE WHEN simulate IS DISTINCT FROM 'ok' THEN 'simulate' WHEN crawl IS DISTINCT FROM 'ok' THEN 'crawl' WHEN gated IS NULL THEN 'gate' WHEN gated <> current_ THEN 'drift' WHEN high > 1 THEN 'findings' WHEN cohesion_ratio < 0.5 THEN 'cohesion' END AS reason FROM r) SELECT proposal, reason, reason IS NULL AS approved FROM w")
def _(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    report = t.orders.select(k.alias("proposal"), (k % 3).alias("high"), (F.col("o_custkey") % 10 / 10.0).alias("cohesion_ratio"), F.when(k % 4 == 0, "bad").otherwise("ok").alias("simulate"), F.when(k % 5 != 0, "ok").alias("crawl"), F.when(k % 6 != 0, "s").alias("gated"), F.when(k % 7 == 0, "t").otherwise("s").alias("current"))
    return D.commit_gate(report, 1, 0.5).select("proposal", "reason", "approved")
