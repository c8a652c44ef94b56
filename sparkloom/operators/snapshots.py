"""Comparison of snapshots: files, symbols, graphs and their metadata, with risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.paths import scope_of

#: Least change of a confidence that counts.
CONFIDENCE_STEP = 1e-4


def _status(before: str, after: str) -> Column:
    return F.when(F.col(before).isNull(), "added").when(F.col(after).isNull(), "removed").otherwise("modified")


def compare_maps(before: DataFrame, after: DataFrame, key: str = "path", value: str = "hash") -> DataFrame:
    """Keys added, removed or modified between two tables (key, value); a null value is a value."""
    a = before.select(key, F.struct(F.col(value)).alias("old"))
    b = after.select(key, F.struct(F.col(value)).alias("new"))
    return a.join(b, key, "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).select(key, _status("old", "new").alias("change"))


def compare_symbols(before: DataFrame, after: DataFrame) -> DataFrame:
    """Symbols (filepath, name, semantic_hash) by file::name."""
    keyed = lambda df: df.select(F.concat("filepath", F.lit("::"), "name").alias("symbol"), "semantic_hash")
    return compare_maps(keyed(before), keyed(after), "symbol", "semantic_hash")


def changed_keys(before: DataFrame, after: DataFrame, columns: list[str], limit: int | None = 64) -> DataFrame:
    """SE2, SE3, T10: (columns, change): rows only one side has, of each change the first up to a limit in order."""
    a, b = before.select(*columns), after.select(*columns)
    both = b.subtract(a).withColumn("change", F.lit("added")).union(a.subtract(b).withColumn("change", F.lit("removed")))
    if limit is None:
        return both
    return both.withColumn("nth", F.row_number().over(Window.partitionBy("change").orderBy(*columns))).where(F.col("nth") <= limit).drop("nth")


def metadata_shifts(before: DataFrame, after: DataFrame, limit: int | None = None) -> DataFrame:
    """Edges of both snapshots whose tier, source, evidence or confidence differs, with the change of confidence."""
    columns = [c for c in ("tier", "confidence", "source", "evidence") if c in before.columns and c in after.columns]
    key = ["src", "dst", "kind"]
    a = before.select(*key, *(F.col(c).alias(f"old_{c}") for c in columns))
    b = after.select(*key, *(F.col(c).alias(f"new_{c}") for c in columns))
    delta = F.col("new_confidence") - F.col("old_confidence")
    changed = F.abs(delta) >= CONFIDENCE_STEP
    for c in columns:
        if c != "confidence":
            changed |= ~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    found = a.join(b, key).where(changed).withColumn("confidence_delta", F.round(delta, 4))
    return found.orderBy(*key).limit(limit) if limit else found


#: Confidence that an edge may lose before its change counts as unstable, and additions from which the risk is medium.
UNSTABLE_LOSS, MANY_ADDED = 0.1, 4


def delta_risk(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: edges added, removed, shifted and unstable, and the risk: high with removals or unstable shifts, medium with any shift or many additions, else low."""
    key = ["src", "dst", "kind"]
    edges = changed_keys(before, after, key, None).agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "removed").alias("removed"))
    shifts = metadata_shifts(before, after)
    unstable = (F.col("confidence_delta") <= -UNSTABLE_LOSS) | ~F.col("old_tier").eqNullSafe(F.col("new_tier"))
    row = edges.crossJoin(F.broadcast(shifts.agg(F.count("*").alias("shifted"), F.count_if(unstable).alias("unstable"))))  # one row each
    risk = F.when((F.col("removed") > 0) | (F.col("unstable") > 0), "high").when((F.col("shifted") > 0) | (F.col("added") >= MANY_ADDED), "medium").otherwise("low")
    return row.withColumn("risk", risk)


def impacted_scopes(changes: DataFrame, limit: int = 12) -> DataFrame:
    """AG5: scopes of changed ids (column id), the most frequent first."""
    return changes.groupBy(scope_of(F.col("id")).alias("scope")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "scope").limit(limit)


def scope_children(edges: DataFrame) -> DataFrame:
    """AG6: direct children by containing scope."""
    return edges.where("kind = 'contains'").groupBy(F.col("src").alias("scope")).agg(F.count_distinct("dst").alias("children"))


def shared_scopes(variants: DataFrame) -> DataFrame:
    """AG7: scopes that more than one variant (variant, scope) touches."""
    return variants.groupBy("scope").agg(F.count_distinct("variant").alias("variants")).where("variants > 1")


def snapshot_counts(edges: DataFrame, dimension: str) -> DataFrame:
    """AG8: edges by kind, tier or source; a null source counts as unknown."""
    return edges.groupBy(F.coalesce(dimension, F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))


def rank_variants(variants: DataFrame) -> DataFrame:
    """Variants (variant, risk, files_changed) with severity, the gravest first, then the most files, then by name."""
    severity = F.when(F.col("risk") == "high", 3).when(F.col("risk") == "medium", 2).otherwise(1)
    scored = variants.withColumn("severity", severity)
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("severity"), F.desc("files_changed"), "variant")))  # as many rows as variants


def pairwise(variants: list[str]) -> list[tuple[str, str]]:
    """SE8: pairs of variant names in order."""
    return [(a, b) for i, a in enumerate(variants) for b in variants[i + 1 :]]


def pairwise_deltas(snapshots: dict[str, DataFrame]) -> DataFrame:
    """SE8: (left, right, change, n) of edges for each pair of named snapshots."""
    out = None
    for a, b in pairwise(sorted(snapshots)):
        found = changed_keys(snapshots[a], snapshots[b], ["src", "dst", "kind"], None).groupBy("change").agg(F.count("*").alias("n")).select(F.lit(a).alias("left"), F.lit(b).alias("right"), "change", "n")
        out = found if out is None else out.union(found)
    if out is None:
        raise ValueError("two snapshots at least")
    return out


#: Hex digits of a digest that name the bucket it is hashed in, from the leaves of the tree to its root.
BUCKET_DIGITS = (6, 4, 2, 0)


def state_hash(rows: DataFrame, *columns: str) -> DataFrame:
    """AG15, AG16: one SHA-256 over rows, whatever their order, as a tree: the rows' digests are sorted and hashed in buckets by their
    first six digits, the buckets' digests in buckets by four, then two, then all. No task gathers more than a 16-millionth of the
    rows, or 256 digests, and equal tables hash alike however they are partitioned."""
    digest = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)), 256)
    # equal rows count: their number goes with the digest
    level = rows.select(digest.alias("own")).groupBy("own").agg(F.count("*").cast("string").alias("said"))
    for n, digits in enumerate(BUCKET_DIGITS):
        name = F.substring("own", 1, digits).alias("own") if digits else F.lit("").alias("own")
        lines = level.select(name, (F.concat("own", F.lit(":"), "said")).alias("line"))
        level = lines.groupBy("own").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n"), 256).alias("said"))
    return level.agg(F.coalesce(F.first("said"), F.sha2(F.lit(""), 256)).alias("state_hash"))


def commit_conflicts(base: DataFrame, current: DataFrame, proposed: DataFrame) -> DataFrame:
    """DF4: (path, state) of a three-way comparison of (path, hash): clean, already_applied, conflict or stale_base."""
    a = base.select("path", F.col("hash").alias("base"))
    b = current.select("path", F.col("hash").alias("current"))
    c = proposed.select("path", F.col("hash").alias("proposed"))
    joined = c.join(a, "path", "left").join(b, "path", "left")
    state = F.when(F.col("current").eqNullSafe(F.col("base")), "clean").when(F.col("current").eqNullSafe(F.col("proposed")), "already_applied").when(F.col("base").isNull(), "stale_base").otherwise("conflict")
    return joined.select("path", state.alias("state"))


def implicit_changes(stored: DataFrame, current: DataFrame) -> DataFrame:
    """DF5: files (path, size, mtime, hash) whose size or time changed, and of these those whose content did; new and lost files too."""
    a = stored.select("path", *(F.col(c).alias(f"old_{c}") for c in ("size", "mtime", "hash")))
    joined = a.join(current, "path", "full_outer")
    touched = ~(F.col("old_size").eqNullSafe(F.col("size")) & F.col("old_mtime").eqNullSafe(F.col("mtime")))
    change = F.when(F.col("old_size").isNull(), "created").when(F.col("size").isNull(), "deleted").when(F.col("old_hash").eqNullSafe(F.col("hash")), "touched").otherwise("modified")
    return joined.where(touched).select("path", change.alias("change"))
