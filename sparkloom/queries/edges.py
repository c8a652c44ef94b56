"""Edge building on symbols derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import adapters as A
from ..operators import edges as E, ranges as R
from ..schemas import decode_symbols
from ..sources.extract import symbol_ids
from .base import Registry, Tables

query = Registry()


def _path(key: str) -> F.Column:
    k = F.col(key)
    return F.concat(F.lit("pkg"), (k % 7).cast("string"), F.lit("/m"), (k % 3).cast("string"), F.when(k % 2 == 0, F.lit(".py")).otherwise(".rs"))


def _path_sql(k: str) -> str:
    return f"'pkg' || ({k} % 7) || '/m' || ({k} % 3) || CASE WHEN {k} % 2 = 0 THEN '.py' ELSE '.rs' END"


def _symbols(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.concat(F.lit("s"), (k % 20).cast("string"))
    return t.supplier.select(F.concat(_path("s_suppkey"), F.lit("::"), name, F.lit("#"), k.cast("string")).alias("id"), _path("s_suppkey").alias("filepath"), name.alias("name"), F.when(k % 4 == 0, F.lit("interface")).when(k % 4 == 1, F.lit("struct")).otherwise("function").alias("kind"), F.when(k % 5 == 0, F.lit("stub")).otherwise("definition").alias("role"), F.when(k % 3 == 0, F.concat(F.lit("l"), (k % 9).cast("string"))).alias("link_name"))


_SYM = f"symbols AS (SELECT {_path_sql('s_suppkey')} || '::s' || (s_suppkey % 20) || '#' || s_suppkey AS id, {_path_sql('s_suppkey')} AS filepath, 's' || (s_suppkey % 20) AS name, CASE s_suppkey % 4 WHEN 0 THEN 'interface' WHEN 1 THEN 'struct' ELSE 'function' END AS kind, CASE WHEN s_suppkey % 5 = 0 THEN 'stub' ELSE 'definition' END AS role, CASE WHEN s_suppkey % 3 = 0 THEN 'l' || (s_suppkey % 9) END AS link_name FROM supplier)"

_LINKS = f"""WITH {_SYM}, by_link AS (SELECT s.id AS src, d.id AS dst FROM symbols s JOIN symbols d ON s.link_name = d.link_name WHERE s.role = 'stub' AND d.role = 'definition' AND s.id <> d.id),
by_name AS (SELECT s.id AS src, d.id AS dst FROM symbols s JOIN symbols d ON s.name = d.name WHERE s.role = 'stub' AND d.role = 'definition' AND s.id <> d.id AND s.id NOT IN (SELECT src FROM by_link))"""


@query("j2_link_join", f"{_LINKS} SELECT src, dst, 0.98::DOUBLE AS confidence FROM by_link")
def _(t: Tables) -> DataFrame:
    return E.link_edges(_symbols(t)).where("kind = 'universal_link'").select("src", "dst", "confidence")


@query("j3_name_fallback", f"{_LINKS.replace(chr(39) + 's' + chr(39) + ' || (s_suppkey % 20) AS name', chr(39) + 's' + chr(39) + ' || (s_suppkey % 12) AS name')} SELECT src, dst, 0.85::DOUBLE AS confidence FROM by_name")
def _(t: Tables) -> DataFrame:
    shared = t.supplier.select(F.concat(_path("s_suppkey"), F.lit("::s"), (F.col("s_suppkey") % 20).cast("string"), F.lit("#"), F.col("s_suppkey").cast("string")).alias("id"), F.concat(F.lit("s"), (F.col("s_suppkey") % 12).cast("string")).alias("name"))
    return E.link_edges(_symbols(t).drop("name").join(shared, "id")).where("kind = 'universal_name'").select("src", "dst", "confidence")


_CONTAIN = f"""WITH {A.LINE_SPANS}, marks AS (SELECT file, id || '/w' AS id, start + 1 AS start, start + (("end" - start) // 2) AS "end" FROM spans WHERE kind = 'function' AND "end" - start >= 4),
inner_spans AS (SELECT file, id, 'method' AS kind, start, "end" FROM marks UNION ALL SELECT file, id, kind, start, "end" FROM spans WHERE kind = 'function'),
outer_spans AS (SELECT file, id, CASE kind WHEN 'function' THEN 'class' ELSE kind END AS kind, start, "end" FROM spans),
pairs AS (SELECT c.file, c.id AS child, c.kind AS child_kind, p.id AS parent, p.kind AS parent_kind, row_number() OVER (PARTITION BY c.file, c.id, c.kind ORDER BY p."end" - p.start, p.start, p.id) AS nth
 FROM inner_spans c JOIN outer_spans p ON c.file = p.file AND c.id <> p.id AND c.start > p.start AND c."end" <= p."end"), best AS (SELECT * FROM pairs WHERE nth = 1)"""


def _containers(t: Tables) -> DataFrame:
    spans = A.line_spans(t)
    lines = spans.where("kind = 'function'")
    half = F.floor((F.col("end") - F.col("start")) / 2)
    marks = lines.where(F.col("end") - F.col("start") >= 4).select("file", F.concat("id", F.lit("/w")).alias("id"), F.lit("method").alias("kind"), (F.col("start") + 1).alias("start"), (F.col("start") + half).alias("end"))
    outer = spans.withColumn("kind", F.when(F.col("kind") == "function", "class").otherwise(F.col("kind")))
    return R.smallest_container(marks.unionByName(lines), outer)


@query("j4_smallest_container", f"{_CONTAIN} SELECT file, parent, parent_kind, child, child_kind FROM best")
def _(t: Tables) -> DataFrame:
    return _containers(t)


@query("j5_module_declares", f"{_CONTAIN} SELECT parent, child FROM best WHERE parent_kind = 'module'")
def _(t: Tables) -> DataFrame:
    return _containers(t).where("parent_kind = 'module'").select("parent", "child")


@query("j6_owns_member", f"{_CONTAIN} SELECT parent, child FROM best WHERE parent_kind = 'class' AND child_kind IN ('method', 'function')")
def _(t: Tables) -> DataFrame:
    return _containers(t).where("parent_kind in ('class', 'struct', 'interface') and child_kind in ('method', 'function')").select("parent", "child")


def _called(key: str) -> F.Column:
    k = F.col(key)
    name = F.concat(F.lit("s"), (k % 20).cast("string"))
    return F.when(k % 3 == 0, name).when(k % 3 == 1, F.concat(F.lit("pkg"), (k % 7).cast("string"), F.lit("."), name)).otherwise(F.concat(F.lit("m::"), name))


_CALLED = "CASE c_custkey % 3 WHEN 0 THEN 's' || (c_custkey % 20) WHEN 1 THEN 'pkg' || (c_custkey % 7) || '.s' || (c_custkey % 20) ELSE 'm::s' || (c_custkey % 20) END"
_SITES = f"sites AS (SELECT 'c' || c_custkey AS caller, {_path_sql('c_custkey')} AS filepath, {_CALLED} AS called FROM customer)"
_PARTS = """regexp_extract(called, '([^.:/]*)$', 1) AS leaf, regexp_extract(target_path, '^(.*)/[^/]*$', 1) = regexp_extract(filepath, '^(.*)/[^/]*$', 1) AS same_dir, target_path = filepath AS same_file,
 regexp_extract(target_path, '[.]([^./]*)$', 1) = regexp_extract(filepath, '[.]([^./]*)$', 1) AS same_ext, contains(called, '::') OR contains(called, '.') OR contains(called, '/') AS qualified,
 (contains(called, '::') OR contains(called, '.') OR contains(called, '/')) AND (contains(target, called) OR contains(target_path, called)) AS hit"""
_CALLS = f"""WITH {_SYM}, {_SITES}, pairs AS (SELECT s.caller, s.called, s.filepath, y.id AS target, y.filepath AS target_path FROM sites s JOIN symbols y ON regexp_extract(s.called, '([^.:]*)$', 1) = y.name),
judged AS (SELECT *, {_PARTS} FROM pairs), scored AS (SELECT *, CAST(100 * CAST(same_file AS INT) + 20 * CAST(same_dir AS INT) + 10 * CAST(same_ext AS INT) + 15 * CAST(hit AS INT) AS INTEGER) AS score FROM judged),
best AS (SELECT *, count(*) OVER (PARTITION BY caller, called) AS tied FROM (SELECT *, rank() OVER (PARTITION BY caller, called ORDER BY score DESC) AS r FROM scored) WHERE r = 1)"""


def _sites(t: Tables) -> DataFrame:
    return t.customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("caller"), _path("c_custkey").alias("filepath"), _called("c_custkey").alias("called"))


@query("j7_best_candidate_ties", f"{_CALLS} SELECT caller, called, target, score FROM best")
def _(t: Tables) -> DataFrame:
    return E.call_candidates(_sites(t), _symbols(t)).select("caller", "called", "target", "score")


@query("cs1_cs2_call_confidence", f"{_CALLS} SELECT caller, target, round(least(greatest(0.58 + 0.18 * CAST(same_file AS INT) + 0.07 * CAST(same_dir AS INT) + 0.04 * CAST(same_ext AS INT) + 0.08 * CAST(qualified AS INT) + 0.05 * CAST(hit AS INT) + CASE WHEN tied = 1 THEN 0.08 ELSE -0.10 END, 0.35), 0.92)::DOUBLE, 4) AS confidence FROM best")
def _(t: Tables) -> DataFrame:
    return E.call_candidates(_sites(t), _symbols(t)).select("caller", "target", "confidence")


@query("cs6_evidence", f"{_CALLS} SELECT caller, target, 'indexed,call_scan' || CASE WHEN same_file THEN ',same_file' ELSE '' END || CASE WHEN same_dir THEN ',same_parent' ELSE '' END || CASE WHEN same_ext THEN ',same_extension' ELSE '' END || CASE WHEN qualified THEN ',qualified_call' ELSE '' END || CASE WHEN hit THEN ',qualified_match' ELSE '' END || CASE WHEN tied = 1 THEN ',unique_best' ELSE ',ambiguous_best' END AS evidence FROM best")
def _(t: Tables) -> DataFrame:
    return E.call_candidates(_sites(t), _symbols(t)).select("caller", "target", F.array_join("evidence", ",").alias("evidence"))


@query("j8_import_candidates", f"""WITH {_SYM}, imports AS (SELECT DISTINCT {_path_sql('c_custkey')} AS filepath, {_CALLED} AS called FROM customer),
pairs AS (SELECT i.filepath, i.called, y.id AS target, y.filepath AS target_path, count(*) OVER (PARTITION BY i.filepath, i.called) AS n FROM imports i JOIN symbols y ON regexp_extract(i.called, '([^.:/]*)$', 1) = y.name),
judged AS (SELECT *, {_PARTS} FROM pairs),
scored AS (SELECT filepath, target, round(least(greatest(0.60 + 0.10 * CAST(same_dir AS INT) + 0.06 * CAST(same_ext AS INT) + 0.10 * CAST(qualified AS INT) + 0.08 * CAST(hit AS INT) + CASE WHEN n = 1 THEN 0.08 ELSE -0.08 END, 0.35), 0.94)::DOUBLE, 4) AS confidence FROM judged)
SELECT filepath, target, min(confidence) AS confidence FROM scored GROUP BY filepath, target""")
def _(t: Tables) -> DataFrame:
    imports = t.customer.select(_path("c_custkey").alias("filepath"), _called("c_custkey").alias("imported")).distinct()
    return E.import_candidates(imports, _symbols(t)).select("filepath", "target", "confidence")


@query("j9_bridges", f"WITH {_SYM} SELECT w.id AS src, c.id AS dst, 0.92::DOUBLE AS confidence FROM symbols w JOIN symbols c ON w.name = c.name AND w.id <> c.id WHERE (contains(w.filepath, 'pkg1/') OR contains(w.filepath, 'pkg3/')) AND contains(c.id, 'pkg2/')")
def _(t: Tables) -> DataFrame:
    return E.bridge_edges(_symbols(t), ("pkg1/", "pkg3/"), ("pkg2/",)).select("src", "dst", "confidence")


@query("j10_realizations", f"""WITH {_SYM}, impls AS (SELECT 'impl' || c_custkey AS id, 's' || (c_custkey % 20) AS x, 's' || (c_custkey % 13) AS y FROM customer)
SELECT i.id AS src, s.id AS dst FROM impls i JOIN symbols s ON s.name = i.x AND s.kind = 'interface' UNION ALL SELECT s.id, i.id FROM impls i JOIN symbols s ON s.name = i.y AND s.kind = 'struct'""")
def _(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    impls = t.customer.select(F.concat(F.lit("impl"), k.cast("string")).alias("id"), F.lit("x.rs").alias("filepath"), F.concat(F.lit("s"), (k % 20).cast("string"), F.lit(" for s"), (k % 13).cast("string")).alias("name"), F.lit("unknown").alias("kind"), F.lit("definition").alias("role"), F.lit(None).cast("string").alias("link_name"))
    return E.realization_edges(_symbols(t).unionByName(impls)).select("src", "dst")


_STAB = f"""WITH {A.LINE_SPANS}, points AS (SELECT CAST(doc_id AS VARCHAR) AS file, k AS point_id, (n_chars * k) // 10 AS at FROM documents, range(0, 11) r(k)),
held AS (SELECT p.file, p.point_id, s.id, row_number() OVER (PARTITION BY p.file, p.point_id ORDER BY s."end" - s.start, s.start, s.id) AS nth FROM points p JOIN spans s ON p.file = s.file AND p.at BETWEEN s.start AND s."end" WHERE s.kind = 'function')"""


@query("j11_stab_enclosing", f"{_STAB} SELECT p.file, p.point_id, p.at, h.id FROM points p LEFT JOIN held h ON p.file = h.file AND p.point_id = h.point_id AND h.nth = 1")
def _(t: Tables) -> DataFrame:
    points = t.documents.select(F.col("doc_id").cast("string").alias("file"), "n_chars", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(10).cast("long"))).alias("point_id")).select("file", "point_id", F.floor(F.col("n_chars") * F.col("point_id") / 10).alias("at"))
    return R.stab(points, A.line_spans(t).where("kind = 'function'"))


@query("j12_point_lookup", f"{_STAB} SELECT h.file, h.point_id, h.id FROM held h WHERE h.nth = 1 AND h.point_id = 5")
def _(t: Tables) -> DataFrame:
    points = t.documents.select(F.col("doc_id").cast("string").alias("file"), F.lit(5).cast("long").alias("point_id"), F.floor(F.col("n_chars") * 5 / 10).alias("at"))
    return R.stab(points, A.line_spans(t).where("kind = 'function'")).where("id is not null").select("file", "point_id", "id")


@query("w1_occurrence_ids", f"WITH {_SYM} SELECT filepath || '::' || name || CASE WHEN n = 0 THEN '' ELSE '::#' || n END AS id FROM (SELECT filepath, name, row_number() OVER (PARTITION BY filepath, name ORDER BY id) - 1 AS n FROM symbols)")
def _(t: Tables) -> DataFrame:
    return symbol_ids(_symbols(t).withColumnRenamed("id", "order"), "order").select("id")


@query("w8_body_spans", f'WITH {A.LINE_SPANS} SELECT file, id, start, coalesce(lead(start) OVER (PARTITION BY file ORDER BY start), n) AS body_end FROM spans JOIN (SELECT CAST(doc_id AS VARCHAR) AS file, n_chars AS n FROM documents) USING (file) WHERE kind = \'function\'')
def _(t: Tables) -> DataFrame:
    totals = t.documents.select(F.col("doc_id").cast("string").alias("file"), "n_chars")
    defs = A.line_spans(t).where("kind = 'function'").withColumnRenamed("start", "offset").join(totals, "file")
    return R.next_offsets(defs, "n_chars").select("file", "id", F.col("offset").alias("start"), "body_end")


@query("pf1_decode_symbols", f"WITH {_SYM} SELECT id, CASE WHEN kind IN ('interface', 'function') THEN kind ELSE 'unknown' END AS kind, CASE WHEN link_name IS NULL THEN 'definition' ELSE role END AS role FROM (SELECT id, kind, role, link_name FROM symbols)")
def _(t: Tables) -> DataFrame:
    odd = _symbols(t).withColumns({"kind": F.when(F.col("kind") == "struct", "union").otherwise(F.col("kind")), "role": F.when(F.col("link_name").isNull(), "other").otherwise(F.col("role"))})
    return decode_symbols(odd).select("id", "kind", "role")


@query("g10_impacted", f"""WITH {_SYM}, own AS (SELECT * FROM symbols WHERE filepath = 'pkg1/m1.rs')
SELECT DISTINCT id FROM symbols WHERE filepath = 'pkg1/m1.rs' OR name IN (SELECT name FROM own) OR link_name IN (SELECT link_name FROM own WHERE link_name IS NOT NULL)""")
def _(t: Tables) -> DataFrame:
    return E.impacted_ids(_symbols(t), t.spark.createDataFrame([("pkg1/m1.rs",)], "filepath string"))
