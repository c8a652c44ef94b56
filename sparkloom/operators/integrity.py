"""Integrity and audit of a symbol graph: ratios, cycles, fan-out, gates, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.paths import module_of, ratio
from .graph import cycle_report


def integrity(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """AG2: one row: stubs and resolved stubs, cohesion (1 without stubs), density (symbols for 1000 lines of their spans) and edges by confidence."""
    stubs = symbols.where("role = 'stub'").select("id")
    resolved = stubs.join(edges.where(F.col("kind").isin("universal_link", "universal_name")).select(F.col("src").alias("id")).distinct(), "id", "left_semi")
    counts = symbols.agg(F.count("*").alias("symbols"), F.count_if(F.col("role") == "stub").alias("total_stubs"), F.coalesce(F.sum(F.col("end_line") - F.col("start_line") + 1), F.lit(0)).alias("span_lines"))
    level = F.when(F.col("confidence") >= 0.9, "high").when(F.col("confidence") >= 0.7, "medium").otherwise("low")
    buckets = edges.agg(*(F.count_if(level == x).alias(f"{x}_confidence") for x in ("high", "medium", "low")))
    row = counts.crossJoin(F.broadcast(resolved.agg(F.count("*").alias("resolved_stubs")))).crossJoin(F.broadcast(buckets))  # one row each
    return row.select(
        "symbols", "total_stubs", "resolved_stubs", F.round(ratio(F.col("resolved_stubs"), F.col("total_stubs")), 4).alias("cohesion_ratio"), F.round(ratio(F.col("symbols") * 1000.0, F.col("span_lines"), 0.0), 4).alias("density"),
        "high_confidence", "medium_confidence", "low_confidence",
    )


def fan_out(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst").groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("n"))


def fan_out_spikes(before: DataFrame, after: DataFrame, threshold: int = 3) -> DataFrame:
    """AG4: nodes that call at least threshold more others than before."""
    joined = fan_out(before).withColumnRenamed("n", "n_before").join(fan_out(after).withColumnRenamed("n", "n_after"), "id", "full_outer").fillna(0, ["n_before", "n_after"])
    return joined.withColumn("delta", F.col("n_after") - F.col("n_before")).where(F.col("delta") >= threshold)


def new_edges(before: DataFrame, after: DataFrame) -> DataFrame:
    """SE4."""
    return after.select("src", "dst").distinct().join(before.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def cross_module_alerts(before: DataFrame, after: DataFrame, files: DataFrame) -> DataFrame:
    """New edges whose ends lie in other files or other modules; files has (id, filepath)."""
    a, b = files.select(F.col("id").alias("src"), F.col("filepath").alias("src_file")), files.select(F.col("id").alias("dst"), F.col("filepath").alias("dst_file"))
    found = new_edges(before, after).join(a, "src").join(b, "dst").where("src_file <> dst_file")
    return found.select("src", "dst", module_of(F.col("src_file")).alias("src_module"), module_of(F.col("dst_file")).alias("dst_module"))


def audit(before: DataFrame, after: DataFrame, files: DataFrame, threshold: int = 3) -> dict[str, DataFrame]:
    """Alerts, cycles of the graph after, and spikes."""
    return {"cross_module": cross_module_alerts(before, after, files), "cycles": cycle_report(after), "spikes": fan_out_spikes(before, after, threshold)}


def impact_gate(baseline: DataFrame | None, current: DataFrame, strict: bool = False, least: float = 0.9) -> DataFrame:
    """integrity() rows compared: a strict gate rejects lower cohesion than the baseline, or without one a cohesion below ``least``."""
    if baseline is None:
        ok = (F.col("cohesion_ratio") >= least) if strict else F.lit(True)
        return current.select("cohesion_ratio", F.lit(None).cast("double").alias("baseline"), ok.alias("accepted"))
    joined = current.crossJoin(F.broadcast(baseline.select(F.col("cohesion_ratio").alias("baseline"))))  # one row each
    ok = (F.col("cohesion_ratio") >= F.col("baseline")) if strict else F.lit(True)
    return joined.select("cohesion_ratio", "baseline", ok.alias("accepted"))


def dead_zones(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Scanned files (filepath) without any symbol."""
    return files.select("filepath").distinct().join(symbols.select("filepath").distinct(), "filepath", "left_anti")


def unresolved_stubs(symbols: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    linked = edges.where(F.col("kind").isin("universal_link", "universal_name")).select(F.col("src").alias("id")).distinct()
    return symbols.where("role = 'stub'").join(linked, "id", "left_anti").select("id").orderBy("id").limit(limit)


def semantic_audit(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """G18."""
    return {"integrity": integrity(symbols, edges), "dead_zones": dead_zones(files, symbols), "unresolved": unresolved_stubs(symbols, edges), "cycles": cycle_report(edges)}


def severity_status(findings: DataFrame) -> DataFrame:
    """AG9: counts by severity and the overall status: fail with any high finding, warn with any, else pass."""
    counts = findings.agg(*(F.count_if(F.col("severity") == x).alias(x) for x in ("high", "medium", "low")), F.count("*").alias("total"))
    return counts.withColumn("status", F.when(F.col("high") > 0, "fail").when(F.col("total") > 0, "warn").otherwise("pass"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """SE5, AG12: share of b's rows that a has; 1 if b is empty."""
    both = a.intersect(b).agg(F.count("*").alias("common"))
    return both.crossJoin(F.broadcast(b.distinct().agg(F.count("*").alias("reference")))).select("common", "reference", F.round(ratio(F.col("common"), F.col("reference")), 4).alias("overlap"))  # one row each


def inventory(symbols: DataFrame) -> DataFrame:
    """AG12: symbols, files and symbols for 1000 files."""
    return symbols.agg(F.count("*").alias("symbols"), F.count_distinct("filepath").alias("files")).withColumn("per_thousand_files", F.round(ratio(F.col("symbols") * 1000.0, F.col("files"), 0.0), 4))


def index_quality(runs: DataFrame) -> DataFrame:
    """AG11: failure and empty ratios of index runs with warnings."""
    parse, none = ratio(F.col("parse_fail"), F.col("total_files"), 0.0), ratio(F.col("no_symbols"), F.col("total_files"), 0.0)
    warnings = F.array_compact(F.array(F.when(parse > 0.05, F.lit("parse_failures")), F.when(none > 0.5, F.lit("few_symbols")), F.when(F.col("native_fallbacks") > 0, F.lit("fallbacks"))))
    return runs.select("*", F.round(parse, 4).alias("parse_fail_ratio"), F.round(none, 4).alias("no_symbol_ratio"), warnings.alias("warnings"))


def doctor(measures: DataFrame, thresholds: Sequence[tuple[str, str, float, str]]) -> DataFrame:
    """PL9: findings for measures (name, value) that break a threshold (name, "max" or "min", limit, severity)."""
    limits = F.broadcast(measures.sparkSession.createDataFrame(list(thresholds), "name string, bound string, limit double, severity string"))
    broken = F.when(F.col("bound") == "max", F.col("value") > F.col("limit")).otherwise(F.col("value") < F.col("limit"))
    return measures.join(limits, "name").where(broken).select("name", "value", "bound", "limit", "severity")
