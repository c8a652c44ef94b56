"""Graph operators on the foreign-key graph and the event transition graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import adapters as A
from ..operators import graph as G
from .base import Registry, Tables

query = Registry()


def _start(t: Tables, *ids: str) -> DataFrame:
    return t.spark.createDataFrame([(i,) for i in ids], "id string")


def _bfs_sql(starts: str, depth: int, own: str, other: str, name: str = "levels") -> str:
    return f"""walk AS (SELECT unnest([{starts}]) AS id, 0 AS level UNION SELECT e.{other}, w.level + 1 FROM walk w JOIN fk_edges e ON e.{own} = w.id WHERE w.level < {depth}),
{name} AS (SELECT id, min(level) AS level FROM walk GROUP BY id)"""


def _listed(blocks: DataFrame) -> DataFrame:
    """The whole list of each node in one row, as the SQL has it; a hub's blocks are put together."""
    whole = F.array_sort(F.flatten(F.collect_list("neighbors")))
    return blocks.groupBy("id").agg(F.array_join(whole, ",").alias("neighbors"))


@query("g1_neighbors", f"WITH {A.FK_EDGES} SELECT src AS id, array_to_string(list_sort(list_distinct(list(dst))), ',') AS neighbors FROM fk_edges GROUP BY src")
def _(t: Tables) -> DataFrame:
    return _listed(G.neighbors(A.fk_edges(t)))


@query("g1_callers", f"WITH {A.FK_EDGES} SELECT dst AS id, array_to_string(list_sort(list_distinct(list(src))), ',') AS neighbors FROM fk_edges GROUP BY dst")
def _(t: Tables) -> DataFrame:
    return _listed(G.neighbors(A.fk_edges(t), down=False))


@query("g2_bfs_up", f"WITH RECURSIVE {A.FK_EDGES}, {_bfs_sql(chr(39) + 'n3' + chr(39), 2, 'dst', 'src')} SELECT id, level FROM levels")
def _(t: Tables) -> DataFrame:
    return G.bfs_levels(A.fk_edges(t), _start(t, "n3"), 2, down=False)


@query("g2_bfs_down", f"WITH RECURSIVE {A.FK_EDGES}, {_bfs_sql(chr(39) + 'o1' + chr(39) + ', ' + chr(39) + 's1' + chr(39), 5, 'src', 'dst')} SELECT id, level FROM levels")
def _(t: Tables) -> DataFrame:
    return G.bfs_levels(A.fk_edges(t), _start(t, "o1", "s1"), 5)


_N3 = _bfs_sql("'n3'", 2, "dst", "src")


@query("g3_closure_edges", f"WITH RECURSIVE {A.FK_EDGES}, {_N3} SELECT DISTINCT src, dst FROM fk_edges WHERE src IN (SELECT id FROM levels) AND dst IN (SELECT id FROM levels)")
def _(t: Tables) -> DataFrame:
    e = A.fk_edges(t)
    return G.closure_edges(e, G.bfs_levels(e, _start(t, "n3"), 2, down=False))


@query("g4_typed_edges", f"WITH RECURSIVE {A.FK_EDGES}, {_N3} SELECT * FROM fk_edges WHERE src IN (SELECT id FROM levels) AND dst IN (SELECT id FROM levels)")
def _(t: Tables) -> DataFrame:
    e = A.fk_edges(t)
    return G.typed_closure_edges(e, G.bfs_levels(e, _start(t, "n3"), 2, down=False))


_BOTH = f"""WITH RECURSIVE {A.FK_EDGES}, {A.FK_NODES}, up AS (SELECT 'n3' AS id, 0 AS level UNION SELECT e.src, w.level + 1 FROM up w JOIN fk_edges e ON e.dst = w.id WHERE w.level < 1),
down AS (SELECT 'n3' AS id, 0 AS level UNION SELECT e.dst, w.level + 1 FROM down w JOIN fk_edges e ON e.src = w.id WHERE w.level < 1),
ids AS (SELECT id FROM up UNION SELECT id FROM down),
found AS (SELECT * FROM fk_edges WHERE src IN (SELECT id FROM ids) AND dst IN (SELECT id FROM ids) AND confidence >= 0.6 AND tier IN ('semantic', 'structural', 'bridge'))"""


def _graph_query(t: Tables) -> dict[str, DataFrame]:
    return G.graph_query(A.fk_edges(t), A.fk_nodes(t), _start(t, "n3"), 1, 1, 0.6, ("semantic", "structural", "bridge"))


@query("g5_graph_query_edges", f"{_BOTH} SELECT * FROM found")
def _(t: Tables) -> DataFrame:
    return _graph_query(t)["edges"]


@query("g5_graph_query_nodes", f"{_BOTH} SELECT ids.id, name, kind, filepath FROM ids LEFT JOIN fk_nodes USING (id)")
def _(t: Tables) -> DataFrame:
    return _graph_query(t)["nodes"]


@query("g5_graph_query_summary", f"{_BOTH} SELECT 'kind' AS dimension, kind AS value, count(*) AS n FROM found GROUP BY kind UNION ALL SELECT 'tier', tier, count(*) FROM found GROUP BY tier UNION ALL SELECT 'source', coalesce(source, 'unknown'), count(*) FROM found GROUP BY 2")
def _(t: Tables) -> DataFrame:
    return _graph_query(t)["summary"]


@query("g6_resolve_uri", """WITH ids AS (SELECT source || '::' || doc_id AS id FROM documents), uris AS (SELECT unnest(['7', 'src0::7', '11', 'nothing']) AS uri)
SELECT uri, coalesce(min(CASE WHEN id = uri THEN id END), min(id)) AS id FROM uris JOIN ids ON id = uri OR ends_with(id, '::' || uri) GROUP BY uri""")
def _(t: Tables) -> DataFrame:
    return G.resolve_uri(t.documents.select(F.concat_ws("::", "source", F.col("doc_id").cast("string")).alias("id")), ["7", "src0::7", "11", "nothing"])


@query("pf3_edge_filter", f"WITH {A.FK_EDGES} SELECT * FROM fk_edges WHERE confidence >= 0.75 AND tier IN ('semantic', 'structural') AND coalesce(source, 'unknown') IN ('unknown')")
def _(t: Tables) -> DataFrame:
    return G.filter_edges(A.fk_edges(t), 0.75, ("semantic", "structural"), ("unknown",))


@query("pf4_cross_subset", f"WITH {A.FK_EDGES} SELECT src, dst, kind FROM fk_edges WHERE starts_with(kind, 'ffi_') OR kind IN ('bridge', 'universal_link')")
def _(t: Tables) -> DataFrame:
    return G.cross_language(A.fk_edges(t)).select("src", "dst", "kind")


@query("ag1_edge_summary", f"WITH {A.FK_EDGES} SELECT 'kind' AS dimension, kind AS value, count(*) AS n FROM fk_edges GROUP BY kind UNION ALL SELECT 'tier', tier, count(*) FROM fk_edges GROUP BY tier UNION ALL SELECT 'source', coalesce(source, 'unknown'), count(*) FROM fk_edges GROUP BY 2")
def _(t: Tables) -> DataFrame:
    return G.edge_summary(A.fk_edges(t))


@query("j14_nodes_left_join", f"WITH {A.FK_EDGES}, {A.FK_NODES} SELECT ids.id, name, kind, filepath FROM (SELECT DISTINCT dst AS id FROM fk_edges) ids LEFT JOIN fk_nodes USING (id)")
def _(t: Tables) -> DataFrame:
    return G.nodes_with_metadata(A.fk_edges(t).select(F.col("dst").alias("id")), A.fk_nodes(t))


@query("g12_insert_edges", f"WITH {A.FK_EDGES}, twice AS (SELECT *, 1 AS seq FROM fk_edges UNION ALL SELECT src, dst, kind, tier, round(confidence / 2, 4), source, 2 FROM fk_edges WHERE confidence > 0.8 UNION ALL SELECT src, src, kind, tier, confidence, source, 3 FROM fk_edges) SELECT src, dst, kind, tier, confidence, source, seq FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, kind ORDER BY seq DESC) AS nth FROM twice WHERE src <> dst) WHERE nth = 1")
def _(t: Tables) -> DataFrame:
    e = A.fk_edges(t)
    again = e.where("confidence > 0.8").withColumn("confidence", F.round(F.col("confidence") / 2, 4)).withColumn("seq", F.lit(2))
    loops = e.withColumn("dst", F.col("src")).withColumn("seq", F.lit(3))
    return G.insert_edges(e.withColumn("seq", F.lit(1)).unionByName(again).unionByName(loops))


@query("g13_g14_faults", f"WITH {A.FK_NODES} SELECT id, name, kind, filepath, CASE WHEN s_acctbal < 0 THEN 'fault-' || id END AS fault_id, coalesce(s_acctbal < 0, false) AS is_poisoned FROM fk_nodes LEFT JOIN supplier ON id = 's' || s_suppkey")
def _(t: Tables) -> DataFrame:
    faults = t.supplier.where("s_acctbal < 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id")).withColumn("fault_id", F.concat(F.lit("fault-"), "id"))
    return G.mark_faults(A.fk_nodes(t), faults)


_REACH = f"""WITH RECURSIVE {A.FK_EDGES}, roots AS (SELECT 'n' || n_nationkey AS id FROM nation UNION ALL SELECT 'c' || c_custkey FROM customer),
up AS (SELECT id AS root, id, 0 AS level FROM roots UNION SELECT u.root, e.src, u.level + 1 FROM up u JOIN fk_edges e ON e.dst = u.id WHERE u.level < 2),
down AS (SELECT id AS root, id, 0 AS level FROM roots UNION SELECT u.root, e.dst, u.level + 1 FROM down u JOIN fk_edges e ON e.src = u.id WHERE u.level < 2),
counts AS (SELECT id, (SELECT count(DISTINCT dst) FROM fk_edges WHERE src = id) AS callee_count, (SELECT count(DISTINCT src) FROM fk_edges WHERE dst = id) AS caller_count,
 (SELECT count(DISTINCT d.id) FROM down d WHERE d.root = roots.id AND d.id <> d.root) AS down_reach, (SELECT count(DISTINCT u.id) FROM up u WHERE u.root = roots.id AND u.id <> u.root) AS up_reach FROM roots)"""


def _reach(t: Tables) -> DataFrame:
    roots = t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id")).union(t.customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string"))))
    return G.reach(A.fk_edges(t), roots, 2)


@query("ag3_degrees_reach", f"{_REACH} SELECT * FROM counts")
def _(t: Tables) -> DataFrame:
    return _reach(t)


for _mode, _score in {"heal": "3 * caller_count + 2 * callee_count + up_reach + down_reach", "audit": "caller_count + callee_count + up_reach + down_reach + CASE WHEN id LIKE 'c1%' THEN 25 ELSE 0 END", "prune": "greatest(10000 - (caller_count + callee_count + up_reach + down_reach), 0)", "mutate": "2 * caller_count + 3 * callee_count + 2 * up_reach + down_reach"}.items():

    @query(f"g15_crawl_{_mode}", f"{_REACH} SELECT *, CAST({_score} AS BIGINT) AS score FROM counts ORDER BY score DESC, id LIMIT 20")
    def _(t: Tables, mode: str = _mode) -> DataFrame:
        return G.crawl_rank(_reach(t), mode, 20, ("^c1",))


@query("t4_crawl_frontier", f"{_REACH}, scored AS (SELECT id, CAST(3 * caller_count + 2 * callee_count + up_reach + down_reach AS BIGINT) AS score FROM counts ORDER BY score DESC, id LIMIT 50) SELECT id, score FROM scored WHERE id NOT IN ('n1', 'n2', 'n3') ORDER BY score DESC, id LIMIT 10")
def _(t: Tables) -> DataFrame:
    return G.crawl_frontier(G.crawl_rank(_reach(t), "heal", 50).select("id", "score"), _start(t, "n1", "n2", "n3"), 10)


_SCC = f"""WITH RECURSIVE {A.TRANSITIONS}, strong AS (SELECT src, dst FROM transitions WHERE confidence >= 0.25),
reach AS (SELECT src, dst FROM strong UNION SELECT r.src, s.dst FROM reach r JOIN strong s ON r.dst = s.src),
mutual AS (SELECT a.src AS id, a.dst AS other FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src),
members AS (SELECT id, min(other) AS component, count(DISTINCT other) AS n FROM mutual GROUP BY id HAVING count(DISTINCT other) > 1)"""


@query("g7_scc", f"{_SCC} SELECT id, component FROM members")
def _(t: Tables) -> DataFrame:
    return G.strongly_connected(A.transitions(t).where("confidence >= 0.25"))


@query("g8_cycle_report", f"{_SCC} SELECT component, array_to_string(list_sort(list(id)), ',') AS members FROM members GROUP BY component ORDER BY component LIMIT 10")
def _(t: Tables) -> DataFrame:
    return G.cycle_report(A.transitions(t).where("confidence >= 0.25")).select("component", F.array_join("members", ",").alias("members"))


#: Rings, and smaller ones that hang on each other: orders by number, the next one after each, closed in groups; and groups that lead to all later ones.
_RINGS = """ring AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS n, count(*) OVER () AS total FROM orders),
sized AS (SELECT n, CASE WHEN n < total // 2 THEN 0 ELSE 1 + (n - total // 2) // 7 END AS g FROM ring), bounds AS (SELECT g, min(n) AS low, max(n) AS high FROM sized GROUP BY g),
members AS (SELECT s.g, 'v' || lpad(CAST(n AS VARCHAR), 9, '0') AS id, 'v' || lpad(CAST(low AS VARCHAR), 9, '0') AS component, high > low AS many FROM sized s JOIN bounds b ON s.g = b.g)"""


def _rings(t: Tables) -> DataFrame:
    """Half of the orders in one ring, the others in rings of seven, each of which leads on to the next three."""
    n = t.orders.count()
    name = lambda c: F.concat(F.lit("v"), F.lpad(c.cast("string"), 9, "0"))
    group = F.when(F.col("id") < n // 2, 0).otherwise(1 + F.floor((F.col("id") - n // 2) / 7))
    low = F.when(F.col("g") == 0, 0).otherwise(n // 2 + 7 * (F.col("g") - 1))
    high = F.when(F.col("g") == 0, n // 2 - 1).otherwise(F.least(F.col("low") + 6, F.lit(n - 1)))
    own = t.spark.range(n).withColumn("g", group).withColumn("low", low).withColumn("high", high)
    ring = own.select(name(F.col("id")).alias("src"), name(F.when(F.col("id") == F.col("high"), F.col("low")).otherwise(F.col("id") + 1)).alias("dst"))
    onward = own.where("id = low").select("high", F.explode(F.array(F.lit(1), F.lit(8), F.lit(15))).alias("k"), "id").where(F.col("high") + F.col("k") < n).select(name(F.col("id")).alias("src"), name(F.col("high") + F.col("k")).alias("dst"))
    return ring.union(onward)


@query("g7_rings", f"WITH {_RINGS} SELECT id, component FROM members WHERE many")
def _(t: Tables) -> DataFrame:
    return G.strongly_connected(_rings(t))


@query("g20_paths", f"""WITH RECURSIVE {A.TRANSITIONS}, steps AS (SELECT src, dst FROM transitions),
walk AS (SELECT ['click'] AS path, 'click' AS tip UNION ALL SELECT list_append(path, dst), dst FROM walk JOIN steps ON src = tip WHERE NOT list_contains(path, dst) AND len(path) < 65)
SELECT array_to_string(path, ';') AS path, CAST(len(path) AS INTEGER) AS n FROM walk w WHERE NOT EXISTS (SELECT 1 FROM steps s WHERE s.src = w.tip AND NOT list_contains(w.path, s.dst))""")
def _(t: Tables) -> DataFrame:
    return G.paths(A.transitions(t), _start(t, "click")).select(F.array_join("path", ";").alias("path"), F.size("path").alias("n"))


#: All orders in layers of four, each of which leads to all of the next layer.
def _layers(t: Tables, width: int = 4) -> DataFrame:
    n = t.orders.count()
    onward = F.explode(F.sequence((F.floor(F.col("id") / width) + 1) * width, (F.floor(F.col("id") / width) + 2) * width - 1)).alias("to")
    name = lambda c: F.concat(F.lit("v"), F.lpad(F.col(c).cast("string"), 9, "0"))
    return t.spark.range(n).select("id", onward).where(F.col("to") < n).select(name("id").alias("src"), name("to").alias("dst"))


_FIRST_LAYER = ("v000000000", "v000000001", "v000000002", "v000000003")


@query("g20_first_paths", """WITH places AS (SELECT unnest(range(20000)) AS i), steps AS (SELECT unnest(range(17)) AS layer)
SELECT string_agg('v' || lpad(CAST(layer * 4 + (i // CAST(power(4, 16 - layer) AS BIGINT)) % 4 AS VARCHAR), 9, '0'), ';' ORDER BY layer) AS path FROM places, steps GROUP BY i""")
def _(t: Tables) -> DataFrame:
    """The first 20,000 of over ten thousand million paths of 16 steps."""
    return G.paths(_layers(t), _start(t, *_FIRST_LAYER), 16, 20_000).select(F.array_join("path", ";").alias("path"))


@query("g20_path_counts", "SELECT 'v00000000' || k AS id, CAST(power(4, 16) AS BIGINT) AS paths FROM (SELECT unnest(range(4)) AS k)")
def _(t: Tables) -> DataFrame:
    return G.count_paths(_layers(t), _start(t, *_FIRST_LAYER), 16).select("id", F.col("paths").cast("long").alias("paths"))


_ALL_REACH = f"""WITH RECURSIVE {A.FK_EDGES}, steps AS (SELECT DISTINCT src, dst FROM fk_edges), ids AS (SELECT src AS id FROM steps UNION SELECT dst FROM steps),
walk AS (SELECT id AS root, id, 0 AS level FROM ids UNION SELECT w.root, s.dst, w.level + 1 FROM walk w JOIN steps s ON s.src = w.id WHERE w.level < 3),
pairs AS (SELECT DISTINCT root, id FROM walk WHERE root <> id), down AS (SELECT root AS id, count(*) AS n FROM pairs GROUP BY root), up AS (SELECT id, count(*) AS n FROM pairs GROUP BY id),
callees AS (SELECT src AS id, count(*) AS n FROM steps GROUP BY src), callers AS (SELECT dst AS id, count(*) AS n FROM steps GROUP BY dst),
counts AS (SELECT ids.id, coalesce(a.n, 0) AS callee_count, coalesce(b.n, 0) AS caller_count, coalesce(down.n, 0) AS down_reach, coalesce(up.n, 0) AS up_reach FROM ids LEFT JOIN callees a USING (id) LEFT JOIN callers b USING (id) LEFT JOIN down USING (id) LEFT JOIN up USING (id))"""


@query("ag3_reach_all", f"{_ALL_REACH} SELECT * FROM counts")
def _(t: Tables) -> DataFrame:
    return G.reach_all(A.fk_edges(t), 3)


@query("g15_crawl_all", f"{_ALL_REACH} SELECT *, CAST(caller_count + callee_count + up_reach + down_reach + CASE WHEN id LIKE 'c1%' THEN 25 ELSE 0 END AS BIGINT) AS score FROM counts ORDER BY score DESC, id LIMIT 50")
def _(t: Tables) -> DataFrame:
    return G.crawl_rank(G.reach_all(A.fk_edges(t), 3), "audit", 50, ("^c1",))


@query("g21_focus_prune", f"WITH RECURSIVE {A.FK_EDGES}, {A.FK_NODES}, up AS (SELECT 'n3' AS id, 0 AS level UNION SELECT e.src, w.level + 1 FROM up w JOIN fk_edges e ON e.dst = w.id WHERE w.level < 2), down AS (SELECT 'n3' AS id, 0 AS level UNION SELECT e.dst, w.level + 1 FROM down w JOIN fk_edges e ON e.src = w.id WHERE w.level < 2) SELECT id, name FROM fk_nodes WHERE id IN (SELECT id FROM up) OR id IN (SELECT id FROM down)")
def _(t: Tables) -> DataFrame:
    return G.prune_to_focus(A.fk_nodes(t), A.fk_edges(t), _start(t, "n3"), 2).select("id", "name")


@query("g22_dangling_edges", "WITH e AS (SELECT '@a::' || o_orderkey AS src, CASE WHEN o_custkey % 4 = 0 THEN '@b::' ELSE '@a::' END || o_custkey AS dst FROM orders) SELECT src, dst FROM e WHERE starts_with(dst, '@b::') AND NOT starts_with(src, '@b::')")
def _(t: Tables) -> DataFrame:
    key = F.col("o_custkey")
    e = t.orders.select(F.concat(F.lit("@a::"), F.col("o_orderkey").cast("string")).alias("src"), F.concat(F.when(key % 4 == 0, F.lit("@b::")).otherwise("@a::"), key.cast("string")).alias("dst"))
    return G.dangling_edges(e, "b")


@query("g23_long_chains", """WITH n AS (SELECT count(*) AS total FROM orders), ids AS (SELECT row_number() OVER () - 1 AS k, total FROM orders, n)
SELECT 'v' || k AS id, CAST(CASE WHEN k < total // 2 THEN k ELSE 2 * ((k - total // 2) // 3) + CASE WHEN (k - total // 2) % 3 = 0 THEN 0 ELSE 1 END END AS INTEGER) AS level FROM ids""")
def _(t: Tables) -> DataFrame:
    """Half of the orders one after another, the others as diamonds one after another."""
    n = t.orders.count()
    half, k = n // 2, F.col("id") - n // 2
    name = lambda c: F.concat(F.lit("v"), c.cast("string"))
    chain = t.spark.range(1, half).select(name(F.col("id") - 1).alias("src"), name(F.col("id")).alias("dst"))
    inner = t.spark.range(half, n).where(k % 3 != 0).select(name(F.col("id") - k % 3).alias("src"), name(F.col("id")).alias("dst"))
    onward = t.spark.range(half + 3, n).where(k % 3 == 0).select(F.explode(F.array(F.col("id") - 1, F.col("id") - 2)).alias("from_id"), "id").select(name(F.col("from_id")).alias("src"), name(F.col("id")).alias("dst"))
    return G.topological_levels(chain.union(inner).union(onward), t.spark.range(n).select(name(F.col("id")).alias("id")))


@query("g23_topo_levels", f"""WITH RECURSIVE {A.FK_EDGES}, all_ids AS (SELECT src AS id FROM fk_edges UNION SELECT dst FROM fk_edges),
deep AS (SELECT id, 0 AS level FROM all_ids UNION SELECT e.dst, d.level + 1 FROM deep d JOIN fk_edges e ON e.src = d.id)
SELECT id, max(level) AS level FROM deep GROUP BY id""")
def _(t: Tables) -> DataFrame:
    return G.topological_levels(A.fk_edges(t))


@query("g23_ladder", "SELECT 'v' || lpad(CAST(total - k AS VARCHAR), 9, '0') AS id, CAST(k // 2 AS INTEGER) AS level FROM (SELECT row_number() OVER () - 1 AS k, count(*) OVER () AS total FROM orders)")
def _(t: Tables) -> DataFrame:
    """All orders in layers of two that lead to all of the next layer; in rounds over the whole graph, whatever its size."""
    n = t.orders.count()
    layer = F.floor(F.col("id") / 2) * 2
    onward = F.explode(F.array(layer + 2, layer + 3)).alias("to")
    name = lambda c: F.concat(F.lit("v"), F.lpad((n - F.col(c)).cast("string"), 9, "0"))
    steps = t.spark.range(n).select("id", onward).where(F.col("to") < n)
    return G.topological_levels(steps.select(name("id").alias("src"), name("to").alias("dst")), local_edges=100)
