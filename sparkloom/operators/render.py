"""Reading symbols' text, and texts of diagrams and flame graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.paths import diagram_label, safe_diagram_id
from ..sources.bodies import in_spans

#: Characters of a flame graph's longest bar.
BAR = 40
#: Edges of a diagram at most: it is one text for people to read.
MOST_EDGES = 10_000


def read_symbols(symbols: DataFrame, sources: DataFrame) -> DataFrame:
    """RD1: symbols (id, filepath, start_byte, end_byte, verbosity) with body: nothing, the first line or all of it for verbosity 0, 1 and 2; error tells what is missing."""
    found = in_spans(symbols.drop("body", "error"), sources, ("start_byte", "end_byte", "verbosity"), _read, "left")
    return found.select("row.*", F.col("found")[0].alias("body"), F.col("found")[1].alias("error"))


def _read(data: bytes | None, spans: list[tuple]) -> list[list[str | None]]:
    """[body, error] of each (start, end, verbosity)."""

    def one(start: int | None, end: int | None, verbosity: int | None) -> list[str | None]:
        if data is None:
            return [None, "file not found"]
        if end is not None and end > len(data):
            return [None, "span beyond the file"]
        if None in (start, end, verbosity) or verbosity < 1:
            return [None, None]
        body = data[start : max(start, end)].decode("utf-8", "replace")
        return [body.split("\n", 1)[0] if verbosity == 1 else body, None]

    return [one(*span) for span in spans]


def resolve_overloads(symbols: DataFrame, requests: DataFrame) -> DataFrame:
    """RD1: of several symbols of a (filepath, name) the one whose lines hold the requested line, else the first."""
    joined = requests.join(symbols, ["filepath", "name"])
    inside = (F.col("line") >= F.col("start_line")) & (F.col("line") <= F.col("end_line"))
    best = F.min_by("id", F.struct(F.when(inside, 0).otherwise(1), F.col("end_line") - F.col("start_line"), "start_line", "id"))
    return joined.groupBy("filepath", "name", "line").agg(best.alias("id"))


def _first_lines(lines: DataFrame, mark: str) -> DataFrame:
    """The first MOST_EDGES distinct lines in order, and where there are more, one that says how many are left out."""
    own = lines.distinct()
    left_out = own.agg((F.count("*") - MOST_EDGES).alias("n")).where("n > 0").select(F.concat(F.lit(mark), F.col("n").cast("string"), F.lit(" more")).alias("line"))
    return own.orderBy("line").limit(MOST_EDGES).union(left_out)


def mermaid(edges: DataFrame, faults: DataFrame | None = None) -> DataFrame:
    """RD2: column diagram: one text of the edges in order; nodes with a fault (id) are styled."""
    line = F.concat(F.lit("  "), safe_diagram_id(F.col("src")), F.lit(" --> "), safe_diagram_id(F.col("dst")))
    lines = _first_lines(edges.select(line.alias("line")), "  %% ")
    if faults is not None:
        lines = lines.union(_first_lines(faults.select(F.concat(F.lit("  style "), safe_diagram_id(F.col("id")), F.lit(" fill:#f66")).alias("line")), "  %% styles: "))
    body = F.array_join(F.sort_array(F.collect_list("line")), "\n")
    return lines.agg(F.concat(F.lit("graph TD\n"), body).alias("diagram"))


def ascii_edges(edges: DataFrame) -> DataFrame:
    lines = _first_lines(edges.select(F.concat(diagram_label(F.col("src")), F.lit(" -> "), diagram_label(F.col("dst"))).alias("line")), "~ ")
    return lines.agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("diagram"))


def flamegraph(weights: DataFrame) -> DataFrame:
    """RD3: frames with a bar whose length is their share of the greatest weight."""
    most = weights.agg(F.max("weight").alias("most"))
    bar = F.repeat(F.lit("#"), F.ceil(F.lit(float(BAR)) * F.col("weight") / F.col("most")).cast("int"))
    return weights.crossJoin(F.broadcast(most)).select("frame", "weight", bar.alias("bar"))  # the maximum is one row


def speedscope(stacks: DataFrame, name: str = "profile") -> DataFrame:
    """RD3: column document: stacks (path, weight) as one JSON text of a sampled profile, with frames numbered in order."""
    frames = stacks.select(F.explode("path").alias("frame")).distinct()
    numbered = frames.withColumn("n", F.row_number().over(Window.orderBy("frame")) - 1)  # as many rows as distinct frames
    rows = stacks.select(F.monotonically_increasing_id().alias("stack"), "path", "weight")
    placed = rows.select("stack", "weight", F.posexplode("path").alias("pos", "frame")).join(numbered, "frame").groupBy("stack", "weight").agg(F.array_sort(F.collect_list(F.struct("pos", "n"))).alias("x"))
    samples = placed.select(F.col("x.n").alias("sample"), "weight")
    both = samples.agg(F.array_sort(F.collect_list(F.struct("sample", "weight"))).alias("s")).crossJoin(F.broadcast(numbered.agg(F.array_sort(F.collect_list(F.struct("n", "frame"))).alias("f"))))
    document = F.to_json(F.struct(
        F.struct(F.transform("f", lambda x: F.struct(x["frame"].alias("name"))).alias("frames")).alias("shared"),
        F.array(F.struct(F.lit("sampled").alias("type"), F.lit(name).alias("name"), F.transform("s", lambda x: x["sample"]).alias("samples"), F.transform("s", lambda x: x["weight"]).alias("weights"))).alias("profiles"),
    ))
    return both.select(document.alias("document"))
