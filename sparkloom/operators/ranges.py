"""Containment and stabbing joins: spans within spans, points within spans.

A range predicate alone would be a cross join within a file. Spans are therefore filed under power-of-two cells: a span of length
n lies in one or two cells of the least width of at least n, and what it contains starts in one of them. Both sides join by file, width
and cell, with the exact predicate on top; a probe gives one row for each width that occurs, 64 at most, however long the spans are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _width(length: Column) -> Column:
    """The exponent of the least power of two that is no less than the length."""
    return F.when(length <= 1, F.lit(0)).otherwise(F.length(F.bin((length - 1).cast("long")))).cast("int")


def _cells(outer: DataFrame) -> DataFrame:
    """Outer spans (file, start, end) with their width and the cells they lie in."""
    width = outer.withColumn("width", _width(F.col("end") - F.col("start")))
    size = F.expr("shiftleft(1L, width)")
    first, last = F.floor(F.col("start") / size), F.floor(F.greatest(F.col("start"), F.col("end")) / size)
    return width.withColumn("cell", F.explode(F.sequence(first.cast("long"), last.cast("long"))))


def _probes(points: DataFrame, at: str, widths: DataFrame) -> DataFrame:
    """Points with the cell of each width that the file's outer spans have."""
    return points.join(widths, "file").withColumn("cell", F.floor(F.col(at) / F.expr("shiftleft(1L, width)")).cast("long"))


def enclosing(points: DataFrame, outer: DataFrame, at: str, condition: Column) -> DataFrame:
    """Pairs of points (with columns file and ``at``) and outer spans (file, start, end, other columns) under the condition, which must imply start <= at <= end."""
    cells = _cells(outer)
    widths = cells.select("file", "width").distinct()
    return _probes(points, at, widths).join(cells, ["file", "width", "cell"]).where(condition).drop("width", "cell")


def smallest_container(children: DataFrame, containers: DataFrame) -> DataFrame:
    """(parent, child and their columns): for each child the shortest container in its file that starts before it and ends no earlier.

    Both have columns file, id, start, end and kind. Of equally long containers the one that starts first counts, then the least id."""
    inner = children.select("file", F.col("id").alias("child"), F.col("kind").alias("child_kind"), F.col("start").alias("child_start"), F.col("end").alias("child_end"))
    outer = containers.select("file", F.col("id").alias("parent"), F.col("kind").alias("parent_kind"), "start", "end")
    holds = (F.col("parent") != F.col("child")) & (F.col("child_start") > F.col("start")) & (F.col("child_end") <= F.col("end")) & (F.col("child_start") <= F.col("end"))
    pairs = enclosing(inner, outer, "child_start", holds)
    best = F.min(F.struct((F.col("end") - F.col("start")).alias("span"), "start", "parent", "parent_kind")).alias("best")
    return pairs.groupBy("file", "child", "child_kind").agg(best).select("file", F.col("best.parent").alias("parent"), F.col("best.parent_kind").alias("parent_kind"), "child", "child_kind")


def stab(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Each point (file, point_id, at) with the shortest span (file, id, start, end) that holds it, both ends included; null where none does."""
    holds = (F.col("at") >= F.col("start")) & (F.col("at") <= F.col("end"))
    pairs = enclosing(points.select("file", "point_id", "at"), spans.select("file", "id", "start", "end"), "at", holds)
    best = pairs.groupBy("file", "point_id", "at").agg(F.min(F.struct((F.col("end") - F.col("start")).alias("span"), "start", "id")).alias("best"))
    return points.join(best.select("file", "point_id", F.col("best.id").alias("id")), ["file", "point_id"], "left")


def next_offsets(defs: DataFrame, total: str) -> DataFrame:
    """Each definition's body reaches to the next one of its file, the last to ``total``."""
    return defs.withColumn("body_end", F.coalesce(F.lead("offset").over(Window.partitionBy("file").orderBy("offset")), F.col(total)))
