"""Faults: build errors mapped to symbols, and checks that symbols and edges alone allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .graph import mark_faults
from .ranges import stab


def error_place(line: Column) -> Column:
    """Struct (file, line) of an error line: ``--> a.rs:1:2``, ``at f (a.js:1:2)``, ``File "a.py", line 1,`` or ``a.c:1:2: error:``; null for others."""
    text = F.trim(line)
    rust = r"^--> ([^:]+):(\d+)"
    node = r"^at (?:[^(]*\(([^:)]+):(\d+)[^)]*\)|([^:(]+):(\d+))"
    python = r'^File "([^"]+)", line (\d+),'
    native = r"^(.+?):(\d+)(?::\d+)?: error:"

    def place(pattern: str, file: int = 1, number: int = 2) -> Column:
        at = F.regexp_extract(text, pattern, number)
        return F.when(at != "", F.struct(F.trim(F.regexp_extract(text, pattern, file)).alias("file"), at.cast("long").alias("line")))

    return F.coalesce(place(rust), place(node), place(node, 3, 4), place(python), place(native))


def fault_symbols(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, errors): symbols (id, filepath, start_line, end_line) with the build output's error lines (column line) that the narrowest of them holds."""
    places = lines.select(error_place(F.col("line")).alias("p")).where("p is not null").groupBy(F.col("p.file").alias("file"), F.col("p.line").alias("at")).agg(F.count("*").alias("errors"))
    points = places.withColumn("point_id", F.col("at"))
    spans = symbols.select(F.col("filepath").alias("file"), "id", F.col("start_line").alias("start"), F.col("end_line").alias("end"))
    return stab(points, spans).where("id is not null").groupBy("id").agg(F.sum("errors").alias("errors"))


def annotate(symbols: DataFrame, lines: DataFrame) -> DataFrame:
    """Symbols with a fault_id of their own where the build output has an error in them."""
    faults = fault_symbols(lines, symbols).select("id", F.sha2(F.concat(F.lit("fault:"), "id"), 256).alias("fault_id"))
    return mark_faults(symbols, faults)


def duplicate_definitions(symbols: DataFrame) -> DataFrame:
    """(filepath, name, kind, n): names that a file defines more than once."""
    return symbols.where("role = 'definition'").groupBy("filepath", "name", "kind").agg(F.count("*").alias("n")).where("n > 1")


def unused_functions(symbols: DataFrame, edges: DataFrame, entry_points: tuple[str, ...] = ("main",)) -> DataFrame:
    """Defined functions and methods that nothing calls or imports, but for entry points."""
    used = edges.where(F.col("kind").isin("calls", "imports") & (F.col("src") != F.col("dst"))).select(F.col("dst").alias("id")).distinct()
    own = symbols.where("role = 'definition' and kind in ('function', 'method')").where(~F.col("name").isin(*entry_points))
    return own.select("id", "name").join(used, "id", "left_anti")


def trace_frames(texts: DataFrame) -> DataFrame:
    """(id, place, frame, file, line) of the frames of traces (id, text), numbered from 1 in order."""
    lines = texts.select("id", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).select("id", "pos", "raw", error_place(F.col("raw")).alias("p")).where("p is not null")
    nth = F.row_number().over(Window.partitionBy("id").orderBy("pos"))
    return lines.select("id", nth.alias("place"), F.trim("raw").alias("frame"), "p.file", "p.line")
