"""Build errors on build output made from orders, and lint checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import adapters as A
from ..operators import faults as X
from .base import Registry, Tables

query = Registry()

_OUTPUT = """output AS (SELECT o_orderkey AS k, o_custkey % 20 AS f, o_orderkey % 120 + 1 AS n FROM orders),
lines AS (SELECT k, 'm' || f || CASE k % 4 WHEN 0 THEN '.rs' WHEN 1 THEN '.js' WHEN 2 THEN '.py' ELSE '.c' END AS file, n FROM output WHERE k % 5 <> 0)"""


def _output(t: Tables) -> DataFrame:
    k, f, n = F.col("o_orderkey"), F.col("o_custkey") % 20, F.col("o_orderkey") % 120 + 1
    line = (
        F.when(k % 5 == 0, "warning: nothing here")
        .when(k % 4 == 0, F.format_string("  --> m%d.rs:%d:5", f, n))
        .when(k % 4 == 1, F.format_string("    at run (m%d.js:%d:15)", f, n))
        .when(k % 4 == 2, F.format_string('  File "m%d.py", line %d, in f', f, n))
        .otherwise(F.format_string("m%d.c:%d:7: error: no", f, n))
    )
    return t.orders.select(line.alias("line"))


_SYMBOLS = "symbols AS (SELECT 's' || s_suppkey AS id, 'm' || (s_suppkey % 20) || CASE s_suppkey % 3 WHEN 0 THEN '.rs' WHEN 1 THEN '.py' ELSE '.c' END AS filepath, s_suppkey % 50 + 1 AS start_line, s_suppkey % 50 + 1 + s_suppkey % 37 AS end_line FROM supplier)"


def _symbols(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    ext = F.when(k % 3 == 0, ".rs").when(k % 3 == 1, ".py").otherwise(".c")
    return t.supplier.select(F.concat(F.lit("s"), k.cast("string")).alias("id"), F.concat(F.lit("m"), (k % 20).cast("string"), ext).alias("filepath"), (k % 50 + 1).alias("start_line"), (k % 50 + 1 + k % 37).alias("end_line"))


@query("j13_build_faults", f"""WITH {_OUTPUT}, {_SYMBOLS}, places AS (SELECT file, n, count(*) AS errors FROM lines GROUP BY ALL),
held AS (SELECT p.file, p.n, p.errors, s.id, row_number() OVER (PARTITION BY p.file, p.n ORDER BY s.end_line - s.start_line, s.start_line, s.id) AS nth FROM places p JOIN symbols s ON s.filepath = p.file AND p.n BETWEEN s.start_line AND s.end_line)
SELECT id, CAST(sum(errors) AS BIGINT) AS errors FROM held WHERE nth = 1 GROUP BY id""")
def _(t: Tables) -> DataFrame:
    return X.fault_symbols(_output(t), _symbols(t))


@query("lint_duplicate_definitions", "SELECT 'f' || (c_custkey % 30) AS filepath, c_mktsegment AS name, 'function' AS kind, count(*) AS n FROM customer GROUP BY 1, 2 HAVING count(*) > 1")
def _(t: Tables) -> DataFrame:
    symbols = t.customer.select(F.concat(F.lit("f"), (F.col("c_custkey") % 30).cast("string")).alias("filepath"), F.col("c_mktsegment").alias("name"), F.lit("function").alias("kind"), F.lit("definition").alias("role"))
    return X.duplicate_definitions(symbols)


@query("lint_unused_functions", f"WITH {A.FK_EDGES}, {A.FK_NODES} SELECT id, name FROM fk_nodes WHERE kind = 'function' AND id NOT IN (SELECT dst FROM fk_edges WHERE src <> dst AND ends_with(src, '77'))")
def _(t: Tables) -> DataFrame:
    return X.unused_functions(A.fk_nodes(t).withColumn("role", F.lit("definition")), A.fk_edges(t).where(F.col("src").endswith("77")).withColumn("kind", F.lit("calls")))


@query("st2_event_numbers", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS number FROM events")
def _(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    return t.events.select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("number"))
