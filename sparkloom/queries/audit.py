"""Integrity, audits and snapshot comparison on graphs and tables derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import adapters as A
from ..operators import integrity as I, snapshots as N
from .base import Registry, Tables

query = Registry()


def _symbols(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t.supplier.select(F.concat(F.lit("s"), k.cast("string")).alias("id"), F.concat(F.lit("dir"), (k % 9).cast("string"), F.lit("/f"), (k % 4).cast("string")).alias("filepath"), F.col("s_name").alias("name"), F.when(k % 3 == 0, "stub").otherwise("definition").alias("role"), k.alias("start_line"), (k + k % 40).alias("end_line"))


def _links(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t.supplier.where(k % 6 != 0).select(F.concat(F.lit("s"), k.cast("string")).alias("src"), F.concat(F.lit("s"), (k + 1).cast("string")).alias("dst"), F.when(k % 2 == 0, "universal_name").otherwise("universal_link").alias("kind"), F.round(0.6 + (k % 40) / 100.0, 2).alias("confidence"))


_SYM = "symbols AS (SELECT 's' || s_suppkey AS id, 'dir' || (s_suppkey % 9) || '/f' || (s_suppkey % 4) AS filepath, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'stub' ELSE 'definition' END AS role, s_suppkey AS start_line, s_suppkey + s_suppkey % 40 AS end_line FROM supplier), links AS (SELECT 's' || s_suppkey AS src, 's' || (s_suppkey + 1) AS dst, CASE WHEN s_suppkey % 2 = 0 THEN 'universal_name' ELSE 'universal_link' END AS kind, round(0.6 + (s_suppkey % 40) / 100.0, 2) AS confidence FROM supplier WHERE s_suppkey % 6 <> 0)"
_INTEGRITY = f"""WITH {_SYM}, r AS (SELECT count(*) AS resolved FROM symbols WHERE role = 'stub' AND id IN (SELECT src FROM links)), c AS (SELECT count(*) AS n, count(*) FILTER (role = 'stub') AS stubs, sum(end_line - start_line + 1) AS lines FROM symbols),
b AS (SELECT count(*) FILTER (confidence >= 0.9) AS h, count(*) FILTER (confidence >= 0.7 AND confidence < 0.9) AS m, count(*) FILTER (confidence < 0.7) AS l FROM links)
SELECT n AS symbols, stubs AS total_stubs, resolved AS resolved_stubs, round(resolved / stubs, 4) AS cohesion_ratio, round(n * 1000.0::DOUBLE / lines, 4) AS density, h AS high_confidence, m AS medium_confidence, l AS low_confidence FROM r, c, b"""


@query("ag2_integrity", _INTEGRITY)
def _(t: Tables) -> DataFrame:
    return I.integrity(_symbols(t), _links(t))


@query("g17_impact_gate", f"WITH i AS ({_INTEGRITY}) SELECT cohesion_ratio, NULL::DOUBLE AS baseline, cohesion_ratio >= 0.9 AS accepted FROM i")
def _(t: Tables) -> DataFrame:
    return I.impact_gate(None, I.integrity(_symbols(t), _links(t)), strict=True)


@query("g17_impact_gate_baseline", f"WITH i AS ({_INTEGRITY}) SELECT cohesion_ratio, 0.0::DOUBLE AS baseline, true AS accepted FROM i")
def _(t: Tables) -> DataFrame:
    return I.impact_gate(I.integrity(_symbols(t), _links(t).where("false")), I.integrity(_symbols(t), _links(t)), strict=True)


@query("g18_dead_zones", f"WITH {_SYM} SELECT DISTINCT 'dir' || (c_custkey % 11) || '/f' || (c_custkey % 4) AS filepath FROM customer EXCEPT SELECT filepath FROM symbols")
def _(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    files = t.customer.select(F.concat(F.lit("dir"), (k % 11).cast("string"), F.lit("/f"), (k % 4).cast("string")).alias("filepath"))
    return I.dead_zones(files, _symbols(t))


@query("g18_unresolved_stubs", f"WITH {_SYM} SELECT id FROM symbols WHERE role = 'stub' AND id NOT IN (SELECT src FROM links) ORDER BY id LIMIT 10")
def _(t: Tables) -> DataFrame:
    return I.unresolved_stubs(_symbols(t), _links(t))


_CALLS = "before AS (SELECT DISTINCT 'c' || o_custkey AS src, 'm' || (o_orderkey % 29) AS dst FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'), after AS (SELECT DISTINCT 'c' || o_custkey AS src, 'm' || (o_orderkey % 29) AS dst FROM orders)"


def _calls(t: Tables) -> tuple[DataFrame, DataFrame]:
    edge = [F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.concat(F.lit("m"), (F.col("o_orderkey") % 29).cast("string")).alias("dst")]
    return t.orders.where("o_orderdate < timestamp '1996-01-01'").select(*edge).distinct(), t.orders.select(*edge).distinct()


@query("ag4_fanout_spike", f"WITH {_CALLS}, b AS (SELECT src AS id, count(DISTINCT dst) AS n FROM before GROUP BY src), a AS (SELECT src AS id, count(DISTINCT dst) AS n FROM after GROUP BY src), j AS (SELECT coalesce(a.id, b.id) AS id, coalesce(b.n, 0) AS n_before, coalesce(a.n, 0) AS n_after FROM a FULL JOIN b ON a.id = b.id) SELECT *, n_after - n_before AS delta FROM j WHERE n_after - n_before >= 3")
def _(t: Tables) -> DataFrame:
    return I.fan_out_spikes(*_calls(t))


@query("se4_new_edges", f"WITH {_CALLS} SELECT * FROM after EXCEPT SELECT * FROM before")
def _(t: Tables) -> DataFrame:
    return I.new_edges(*_calls(t))


@query("g16_cross_module", f"WITH {_CALLS}, files AS (SELECT 'c' || c_custkey AS id, 'src/p' || (c_custkey % 3) || '/a.rs' AS f FROM customer UNION ALL SELECT 'm' || i, 'src/p' || (i % 3) || '/a.rs' FROM range(0, 29) r(i)), fresh AS (SELECT * FROM after EXCEPT SELECT * FROM before) SELECT e.src, e.dst, regexp_extract(a.f, '^(.*)/', 1) AS src_module, regexp_extract(b.f, '^(.*)/', 1) AS dst_module FROM fresh e JOIN files a ON e.src = a.id JOIN files b ON e.dst = b.id WHERE a.f <> b.f")
def _(t: Tables) -> DataFrame:
    path = lambda k: F.concat(F.lit("src/p"), (F.col(k) % 3).cast("string"), F.lit("/a.rs")).alias("filepath")
    files = t.customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), path("c_custkey")).union(t.spark.range(29).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("id"), path("id")))
    return I.cross_module_alerts(*_calls(t), files)


@query("ag9_severity_status", "SELECT count(*) FILTER (s = 'high') AS high, count(*) FILTER (s = 'medium') AS medium, count(*) FILTER (s = 'low') AS low, count(*) AS total, CASE WHEN count(*) FILTER (s = 'high') > 0 THEN 'fail' WHEN count(*) > 0 THEN 'warn' ELSE 'pass' END AS status FROM (SELECT CASE WHEN event_type = 'error' THEN 'high' WHEN value > 50 THEN 'medium' ELSE 'low' END AS s FROM events)")
def _(t: Tables) -> DataFrame:
    return I.severity_status(t.events.select(F.when(F.col("event_type") == "error", "high").when(F.col("value") > 50, "medium").otherwise("low").alias("severity")))


@query("se5_overlap", "WITH a AS (SELECT DISTINCT text FROM documents WHERE doc_id % 2 = 0), b AS (SELECT DISTINCT text FROM documents WHERE doc_id % 2 = 1) SELECT (SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) AS common, (SELECT count(*) FROM b) AS reference, round((SELECT count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) / (SELECT count(*) FROM b), 4) AS overlap")
def _(t: Tables) -> DataFrame:
    return I.overlap(t.documents.where("doc_id % 2 = 0").select("text"), t.documents.where("doc_id % 2 = 1").select("text"))


@query("ag12_inventory", f"WITH {_SYM} SELECT count(*) AS symbols, count(DISTINCT filepath) AS files, round(count(*) * 1000.0::DOUBLE / count(DISTINCT filepath), 4) AS per_thousand_files FROM symbols")
def _(t: Tables) -> DataFrame:
    return I.inventory(_symbols(t))


_RUNS = "runs AS (SELECT o_orderkey AS ts_unix, 100 + o_custkey % 50 AS total_files, o_orderkey % 9 AS parse_fail, o_orderkey % 120 AS no_symbols, o_custkey % 2 AS native_fallbacks FROM orders)"


def index_runs(t: Tables) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return t.orders.select(k.alias("ts_unix"), (100 + c % 50).alias("total_files"), (k % 9).alias("parse_fail"), (k % 120).alias("no_symbols"), (c % 2).alias("native_fallbacks"))


@query("ag11_index_quality", f"WITH {_RUNS}, q AS (SELECT ts_unix, parse_fail / total_files AS p, no_symbols / total_files AS n, native_fallbacks AS f FROM runs) SELECT ts_unix, round(p, 4) AS parse_fail_ratio, round(n, 4) AS no_symbol_ratio, array_to_string(list_filter([CASE WHEN p > 0.05 THEN 'parse_failures' END, CASE WHEN n > 0.5 THEN 'few_symbols' END, CASE WHEN f > 0 THEN 'fallbacks' END], lambda x: x IS NOT NULL), ',') AS warnings FROM q")
def _(t: Tables) -> DataFrame:
    return I.index_quality(index_runs(t)).select("ts_unix", "parse_fail_ratio", "no_symbol_ratio", F.array_join("warnings", ",").alias("warnings"))


@query("pl9_doctor", "WITH m AS (SELECT event_type AS name, round(avg(value), 6) AS value FROM events GROUP BY event_type), l(name, bound, \"limit\", severity) AS (VALUES ('click', 'max', 10.0::DOUBLE, 'high'), ('error', 'min', 1000.0, 'medium'), ('purchase', 'max', 1e9, 'low')) SELECT m.name, m.value, l.bound, l.\"limit\", l.severity FROM m JOIN l ON m.name = l.name WHERE CASE WHEN bound = 'max' THEN value > \"limit\" ELSE value < \"limit\" END")
def _(t: Tables) -> DataFrame:
    measures = t.events.groupBy(F.col("event_type").alias("name")).agg(F.round(F.avg("value"), 6).alias("value"))
    return I.doctor(measures, [("click", "max", 10.0, "high"), ("error", "min", 1000.0, "medium"), ("purchase", "max", 1e9, "low")])


@query("j16_snapshot_diff", f"WITH {A.SNAPSHOTS} SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM before b FULL JOIN after a ON a.path = b.path WHERE b.hash IS DISTINCT FROM a.hash")
def _(t: Tables) -> DataFrame:
    return N.compare_maps(*A.snapshots(t))


@query("j22_symbol_diff", f"WITH {A.SNAPSHOTS} SELECT coalesce(b.path, a.path) AS symbol, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM (SELECT 'a.rs::' || path AS path, hash FROM before) b FULL JOIN (SELECT 'a.rs::' || path AS path, hash FROM after) a ON a.path = b.path WHERE b.hash IS DISTINCT FROM a.hash")
def _(t: Tables) -> DataFrame:
    named = lambda df: df.select(F.lit("a.rs").alias("filepath"), F.col("path").alias("name"), F.col("hash").alias("semantic_hash"))
    before, after = A.snapshots(t)
    return N.compare_symbols(named(before), named(after))


_SHIFT = f"""WITH {A.EDGE_VERSIONS}, shifts AS (SELECT b.src, b.dst, b.kind, b.tier AS old_tier, b.confidence AS old_confidence, b.source AS old_source, a.tier AS new_tier, a.confidence AS new_confidence, a.source AS new_source, round(a.confidence - b.confidence, 4) AS confidence_delta
 FROM edges_before b JOIN edges_after a ON a.src = b.src AND a.dst = b.dst AND a.kind = b.kind WHERE abs(a.confidence - b.confidence) >= 1e-4 OR a.tier IS DISTINCT FROM b.tier OR a.source IS DISTINCT FROM b.source)"""
_KEYS = "added AS (SELECT src, dst, kind FROM edges_after EXCEPT SELECT src, dst, kind FROM edges_before), removed AS (SELECT src, dst, kind FROM edges_before EXCEPT SELECT src, dst, kind FROM edges_after)"


@query("j18_metadata_shift", f"{_SHIFT} SELECT * FROM shifts")
def _(t: Tables) -> DataFrame:
    return N.metadata_shifts(*A.edge_versions(t))


@query("se2_except", f"{_SHIFT}, {_KEYS} SELECT *, 'added' AS change FROM added UNION ALL SELECT *, 'removed' FROM removed")
def _(t: Tables) -> DataFrame:
    return N.changed_keys(*A.edge_versions(t), ["src", "dst", "kind"], None)


@query("se3_t10_bounded_except", f"{_SHIFT}, {_KEYS}, both_ways AS (SELECT *, 'added' AS change FROM added UNION ALL SELECT *, 'removed' FROM removed) SELECT src, dst, kind, change FROM (SELECT *, row_number() OVER (PARTITION BY change ORDER BY src, dst, kind) AS nth FROM both_ways) WHERE nth <= 64")
def _(t: Tables) -> DataFrame:
    return N.changed_keys(*A.edge_versions(t), ["src", "dst", "kind"])


@query("g19_risk", f"{_SHIFT}, {_KEYS}, c AS (SELECT (SELECT count(*) FROM added) AS added, (SELECT count(*) FROM removed) AS removed, (SELECT count(*) FROM shifts) AS shifted, (SELECT count(*) FROM shifts WHERE confidence_delta <= -0.1 OR old_tier IS DISTINCT FROM new_tier) AS unstable) SELECT *, CASE WHEN removed > 0 OR unstable > 0 THEN 'high' WHEN shifted > 0 OR added >= 4 THEN 'medium' ELSE 'low' END AS risk FROM c")
def _(t: Tables) -> DataFrame:
    return N.delta_risk(*A.edge_versions(t))


@query("ag5_impacted_scopes", "SELECT regexp_replace(split_part('@' || source || '::' || doc_id, '::', 1), '^@+', '') AS scope, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, scope LIMIT 12")
def _(t: Tables) -> DataFrame:
    return N.impacted_scopes(t.documents.select(F.concat(F.lit("@"), "source", F.lit("::"), F.col("doc_id").cast("string")).alias("id")))


@query("ag6_scope_children", "SELECT 'c' || o_custkey AS scope, count(DISTINCT o_orderkey) AS children FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return N.scope_children(t.orders.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), F.col("o_orderkey").alias("dst"), F.lit("contains").alias("kind")))


@query("ag7_shared_scopes", "SELECT source AS scope, count(DISTINCT lang) AS variants FROM documents GROUP BY source HAVING count(DISTINCT lang) > 1")
def _(t: Tables) -> DataFrame:
    return N.shared_scopes(t.documents.select(F.col("lang").alias("variant"), F.col("source").alias("scope")))


@query("ag8_snapshot_counts", f"WITH {A.FK_EDGES} SELECT coalesce(source, 'unknown') AS value, count(*) AS n FROM fk_edges GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return N.snapshot_counts(A.fk_edges(t), "source")


@query("t7_rank_variants", "SELECT variant, risk, files_changed, severity, CAST(row_number() OVER (ORDER BY severity DESC, files_changed DESC, variant) AS INTEGER) AS rank FROM (SELECT source AS variant, CASE WHEN count(*) FILTER (lang = 'de') > 7 THEN 'high' WHEN count(*) FILTER (lang = 'de') > 5 THEN 'medium' ELSE 'low' END AS risk, count(DISTINCT text) AS files_changed, CASE WHEN count(*) FILTER (lang = 'de') > 7 THEN 3 WHEN count(*) FILTER (lang = 'de') > 5 THEN 2 ELSE 1 END AS severity FROM documents GROUP BY source)")
def _(t: Tables) -> DataFrame:
    german = F.count_if(F.col("lang") == "de")
    return N.rank_variants(t.documents.groupBy(F.col("source").alias("variant")).agg(F.when(german > 7, "high").when(german > 5, "medium").otherwise("low").alias("risk"), F.count_distinct("text").alias("files_changed")))


@query("se8_pairwise_deltas", f"WITH {A.EDGE_VERSIONS}, v AS (SELECT 'a' AS name, src, dst, kind FROM edges_before UNION ALL SELECT 'b', src, dst, kind FROM edges_after UNION ALL SELECT 'c', src, dst, kind FROM edges_after WHERE tier <> 'heuristic'), p AS (SELECT * FROM (VALUES ('a', 'b'), ('a', 'c'), ('b', 'c')) x(\"left\", \"right\")), d AS (SELECT p.\"left\", p.\"right\", 'added' AS change, r.src, r.dst, r.kind FROM p JOIN v r ON r.name = p.\"right\" WHERE NOT EXISTS (SELECT 1 FROM v l WHERE l.name = p.\"left\" AND l.src = r.src AND l.dst = r.dst AND l.kind = r.kind) UNION SELECT p.\"left\", p.\"right\", 'removed', r.src, r.dst, r.kind FROM p JOIN v r ON r.name = p.\"left\" WHERE NOT EXISTS (SELECT 1 FROM v l WHERE l.name = p.\"right\" AND l.src = r.src AND l.dst = r.dst AND l.kind = r.kind)) SELECT \"left\", \"right\", change, count(*) AS n FROM d GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    before, after = A.edge_versions(t)
    return N.pairwise_deltas({"a": before, "b": after, "c": after.where("tier <> 'heuristic'")})


_TREE = """lines AS (SELECT digest, digest || ':' || count(*) AS line FROM d GROUP BY digest),
b6 AS (SELECT substring(digest, 1, 6) AS own, sha256(string_agg(line, chr(10) ORDER BY line)) AS said FROM lines GROUP BY 1),
b4 AS (SELECT substring(own, 1, 4) AS up, sha256(string_agg(own || ':' || said, chr(10) ORDER BY own)) AS said FROM b6 GROUP BY 1),
b2 AS (SELECT substring(up, 1, 2) AS up, sha256(string_agg(up || ':' || said, chr(10) ORDER BY up)) AS said FROM b4 GROUP BY 1)
SELECT sha256(string_agg(up || ':' || said, chr(10) ORDER BY up)) AS state_hash FROM b2"""


@query("ag15_state_hash", f"WITH d AS (SELECT sha256(CAST(o_orderkey AS VARCHAR) || chr(31) || o_orderstatus) AS digest FROM orders), {_TREE}")
def _(t: Tables) -> DataFrame:
    return N.state_hash(t.orders, "o_orderkey", "o_orderstatus")


@query("ag16_snapshot_id", f"WITH d AS (SELECT sha256(source || chr(31) || doc_id || chr(31) || text) AS digest FROM documents), {_TREE}")
def _(t: Tables) -> DataFrame:
    return N.state_hash(t.documents, "source", "doc_id", "text")


@query("df4_conflicts", f"WITH {A.SNAPSHOTS}, proposed AS (SELECT path, sha256(path) AS hash FROM before UNION SELECT path, hash FROM after WHERE path NOT IN (SELECT path FROM before)) SELECT p.path, CASE WHEN a.hash IS NOT DISTINCT FROM b.hash THEN 'clean' WHEN a.hash IS NOT DISTINCT FROM p.hash THEN 'already_applied' WHEN b.hash IS NULL THEN 'stale_base' ELSE 'conflict' END AS state FROM proposed p LEFT JOIN before b ON b.path = p.path LEFT JOIN after a ON a.path = p.path")
def _(t: Tables) -> DataFrame:
    before, after = A.snapshots(t)
    proposed = before.select("path", F.sha2("path", 256).alias("hash")).union(after.join(before, "path", "left_anti").select("path", "hash"))
    return N.commit_conflicts(before, after, proposed)


_FILES = "stored AS (SELECT 'o' || o_orderkey AS path, o_orderkey % 100 AS size, o_custkey AS mtime, o_orderstatus AS hash FROM orders WHERE o_orderkey % 10 <> 0), now_ AS (SELECT 'o' || o_orderkey AS path, o_orderkey % 100 AS size, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 ELSE o_custkey END AS mtime, CASE WHEN o_orderkey % 14 = 0 THEN 'new' ELSE o_orderstatus END AS hash FROM orders WHERE o_orderkey % 10 <> 1)"


@query("df5_implicit_changes", f"WITH {_FILES} SELECT coalesce(s.path, n.path) AS path, CASE WHEN s.path IS NULL THEN 'created' WHEN n.path IS NULL THEN 'deleted' WHEN s.hash = n.hash THEN 'touched' ELSE 'modified' END AS change FROM stored s FULL JOIN now_ n ON s.path = n.path WHERE s.size IS DISTINCT FROM n.size OR s.mtime IS DISTINCT FROM n.mtime")
def _(t: Tables) -> DataFrame:
    k, path = F.col("o_orderkey"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("path")
    stored = t.orders.where(k % 10 != 0).select(path, (k % 100).alias("size"), F.col("o_custkey").alias("mtime"), F.col("o_orderstatus").alias("hash"))
    now = t.orders.where(k % 10 != 1).select(path, (k % 100).alias("size"), F.when(k % 7 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("mtime"), F.when(k % 14 == 0, "new").otherwise(F.col("o_orderstatus")).alias("hash"))
    return N.implicit_changes(stored, now)
