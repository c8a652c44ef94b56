"""Scans, deltas and sinks on the test tables as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources import scan as C, sinks as K
from .audit import index_runs
from .base import Registry, Tables

query = Registry()


def _files(t: Tables) -> DataFrame:
    ext = F.when(F.col("doc_id") % 3 == 0, ".rs").when(F.col("doc_id") % 3 == 1, ".py").otherwise(".txt")
    return t.documents.select(F.concat("source", F.lit("/d"), F.col("doc_id").cast("string"), ext).alias("filepath"), F.col("doc_id").alias("mtime"), F.octet_length("text").cast("long").alias("file_size"), F.col("text").alias("content"))


_FILES = "files AS (SELECT source || '/d' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.rs' WHEN 1 THEN '.py' ELSE '.txt' END AS filepath, doc_id AS mtime, CAST(strlen(text) AS BIGINT) AS file_size, text AS content FROM documents)"


@query("sc1_extensions", f"WITH {_FILES} SELECT filepath FROM files WHERE regexp_extract(filepath, '[.]([^.]*)$', 1) IN ('rs', 'py')")
def _(t: Tables) -> DataFrame:
    from ..functions.paths import extension

    return _files(t).where(extension(F.col("filepath")).isin(*C.EXTENSIONS)).select("filepath")


@query("sc1_ignore_patterns", f"WITH {_FILES} SELECT filepath FROM files WHERE NOT (regexp_matches(filepath, '/d[0-9]*7[.]py$') OR starts_with(filepath, 'src3/')) OR filepath = 'src3/d3.rs'")
def _(t: Tables) -> DataFrame:
    return _files(t).where(~C.ignore(F.col("filepath"), ["*7.py", "/src3/", "!/src3/d3.rs"])).select("filepath")


@query("sc2_listing", f"WITH {_FILES} SELECT filepath FROM files WHERE starts_with(filepath, 'src1/') ORDER BY filepath")
def _(t: Tables) -> DataFrame:
    return C.listing(_files(t), "src1/")


@query("sc5_symbol_scan", "SELECT s_suppkey, s_name FROM supplier")
def _(t: Tables) -> DataFrame:
    return t.supplier.select("s_suppkey", "s_name")


@query("sc6_by_ids", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(t: Tables) -> DataFrame:
    return C.by_ids(t.documents.select("doc_id", "n_chars"), t.labels.where("toxic = 1"), "doc_id")


@query("sc7_delta_scan", f"WITH {_FILES}, stored AS (SELECT filepath, CASE WHEN mtime % 5 = 0 THEN mtime - 1 ELSE mtime END AS mtime, CASE WHEN mtime % 7 = 0 THEN file_size + 1 ELSE file_size END AS file_size FROM files WHERE mtime % 11 <> 0) SELECT f.filepath FROM files f LEFT JOIN stored s USING (filepath) WHERE f.mtime IS DISTINCT FROM s.mtime OR f.file_size IS DISTINCT FROM s.file_size")
def _(t: Tables) -> DataFrame:
    now, m = _files(t), F.col("mtime")
    stored = now.where(m % 11 != 0).select("filepath", F.when(m % 5 == 0, m - 1).otherwise(m).alias("mtime"), F.when(m % 7 == 0, F.col("file_size") + 1).otherwise(F.col("file_size")).alias("file_size"))
    return C.delta(now, stored).select("filepath")


@query("sc8_scoped", f"WITH {_FILES} SELECT filepath FROM files WHERE starts_with(filepath, 'src1/') OR starts_with(filepath, 'src4/')")
def _(t: Tables) -> DataFrame:
    return C.scoped(_files(t), ["src1/", "src4/"]).select("filepath")


@query("sc9_content_filter", f"WITH {_FILES} SELECT filepath FROM files WHERE contains(lower(content), 'license')")
def _(t: Tables) -> DataFrame:
    return C.containing(_files(t), "LICENSE").select("filepath")


@query("sc10_size_guard", f"WITH {_FILES} SELECT filepath FROM files WHERE file_size <= 4000")
def _(t: Tables) -> DataFrame:
    return C.size_guard(_files(t), 4000).select("filepath")


@query("sc15_recent_runs", "SELECT o_orderkey AS ts_unix, 100 + o_custkey % 50 AS total_files FROM orders ORDER BY o_orderkey DESC LIMIT 5")
def _(t: Tables) -> DataFrame:
    return index_runs(t).orderBy(F.desc("ts_unix")).limit(5).select("ts_unix", "total_files")


@query("sk1_upsert", f"WITH {_FILES}, fresh AS (SELECT filepath, -mtime AS mtime FROM files WHERE mtime % 4 = 0 UNION ALL SELECT 'new/f', 0) SELECT filepath, mtime FROM files WHERE filepath NOT IN (SELECT filepath FROM fresh) UNION ALL SELECT * FROM fresh")
def _(t: Tables) -> DataFrame:
    stored = _files(t).select("filepath", "mtime")
    fresh = stored.where("mtime % 4 = 0").withColumn("mtime", -F.col("mtime")).union(t.spark.createDataFrame([("new/f", 0)], "filepath string, mtime long"))
    return K.upsert(stored, fresh)


@query("sk3_remove", f"WITH {_FILES} SELECT filepath FROM files WHERE mtime % 4 <> 0")
def _(t: Tables) -> DataFrame:
    stored = _files(t)
    return K.without(stored, stored.where("mtime % 4 = 0")).select("filepath")


@query("se6_distinct", "SELECT DISTINCT source, lang FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("source", "lang").distinct()


@query("se7_first_occurrence", "SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def _(t: Tables) -> DataFrame:
    return t.documents.groupBy("text").agg(F.min("doc_id").alias("doc_id"))
