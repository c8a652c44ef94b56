"""Line dedup by site-relative frequency.

For each host, a line's frequency is the number of the host's pages that contain it divided by the host's pages. Lines whose
frequency exceeds ``ratio``, found on ``min_pages`` pages at least, are boilerplate and go from the host's pages; what stays
keeps its order. Lines are compared without white space at their ends; empty lines are no boilerplate.

A page is a row, and a line counts once for each page however often it stands there. No text is shuffled to count: a line
goes as its 128-bit MD5 with partial sums for each host and line. A host's boilerplate lines are at most its mean lines a
page divided by the ratio, so they go in one array to the host's pages: broadcast, if all hosts' lines are counted to be few
enough, so that no page is shuffled; otherwise by a join on host and a salt, over which a hot host's pages are spread.

Defined results: null hosts are a host of their own. A null text stays null and counts as a page without lines. A text that
loses all its lines becomes empty; no row is dropped. Repeated rows are pages of their own. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import cut, load

RATIO = 0.10
MIN_PAGES = 5
#: Boilerplate lines of all hosts, at 16 bytes each, that may be broadcast; and the salts of a host beyond that.
BROADCAST_LINES, SALTS = 100_000, 64
#: White space that a line's ends lose, in both engines.
BLANK = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(BLANK))


def _key(line: Column) -> Column:
    return F.unhex(F.md5(_trimmed(line).cast("binary")))


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line): the keys of the hosts' boilerplate lines."""
    rows = pages.select(F.col(host).alias("host"), F.col(text).alias("text"))
    totals = rows.groupBy("host").agg(F.count("*").alias("pages"))
    own = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: _trimmed(x) != ""), _key))
    counts = rows.select("host", F.explode(own).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    found = counts.alias("c").join(totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host"))).where(F.col("n") > F.lit(ratio) * F.col("pages"))
    return found.select(F.col("c.host").alias("host"), "line")


def drop_lines(pages: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """Struct ``row`` of the page's columns, its ``clean`` text, and n_lines and n_dropped."""
    found = boilerplate(pages, host, text, ratio, min_pages)
    few = found.limit(broadcast_lines + 1).collect()
    left = pages.select(F.struct("*").alias("row"), F.col(host).alias("own_host"), _lines(F.col(text)).alias("own_lines"))
    same = F.col("own_host").eqNullSafe(F.col("host"))
    if len(few) <= broadcast_lines:
        by_host: dict = {}
        for row in few:
            by_host.setdefault(row["host"], []).append(row["line"])
        known = pages.sparkSession.createDataFrame(list(by_host.items()), T.StructType([T.StructField("host", found.schema["host"].dataType), T.StructField("lines", T.ArrayType(T.BinaryType()))]))
        joined = left.join(F.broadcast(known), same, "left")
    else:
        found = cut(found.groupBy("host").agg(F.collect_list("line").alias("lines")))
        left = left.withColumn("own_salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
        salts = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
        joined = left.join(found.withColumn("salt", F.explode(salts)), same & (F.col("own_salt") == F.col("salt")), "left")
    stays = F.when(F.col("lines").isNull(), F.col("own_lines")).otherwise(F.filter("own_lines", lambda x: (_trimmed(x) == "") | ~F.array_contains("lines", _key(x))))
    return joined.select("row", "own_lines", stays.alias("stays")).select(
        "row", F.array_join("stays", "\n").alias("clean"), F.coalesce(F.size("own_lines"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("own_lines") - F.size("stays"), F.lit(0)).cast("long").alias("n_dropped")
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_lines(load(spark, sf_dir, "documents")).select(F.col("row.doc_id").alias("doc_id"), F.col("clean").alias("text"), "n_lines", "n_dropped")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their hosts' boilerplate lines; n_chars follows the text."""
    found = drop_lines(docs)
    put = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return found.select(*(put.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


QUERIES = {"op6_line_dedup": op6_line_dedup}
ORACLE_SQL = {
    "op6_line_dedup": f"""
WITH rows AS (SELECT row_number() OVER () AS rid, doc_id, text, source FROM documents),
lines AS (SELECT rid, doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM rows),
trimmed AS (SELECT *, trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS cut FROM lines),
totals AS (SELECT source, count(*) AS pages FROM rows GROUP BY source),
counts AS (SELECT source, cut, count(DISTINCT rid) AS n FROM trimmed WHERE cut <> '' GROUP BY source, cut),
boiler AS (SELECT c.source, c.cut FROM counts c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source WHERE n >= {MIN_PAGES} AND n > {RATIO} * pages),
marked AS (SELECT t.*, b.cut IS NOT NULL AS gone FROM trimmed t LEFT JOIN boiler b ON t.source IS NOT DISTINCT FROM b.source AND t.cut = b.cut),
clean AS (SELECT rid, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS text, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped FROM marked GROUP BY rid)
SELECT r.doc_id, CASE WHEN r.text IS NULL THEN NULL ELSE coalesce(c.text, '') END AS text, CAST(coalesce(c.n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(c.n_dropped, 0) AS BIGINT) AS n_dropped
FROM rows r LEFT JOIN clean c USING (rid)"""
}
