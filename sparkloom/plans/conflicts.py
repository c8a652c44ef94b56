"""Conflicts between scripts that would run side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def target_conflicts(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """(left, right, reason) of targets (column id): named twice, or joined by an edge (src, dst) in either direction.

    Both come from equi-joins on ids; pairs without relation are never built."""
    ids = targets.groupBy("id").agg(F.count("*").alias("n"))
    same = ids.where("n > 1").select(F.col("id").alias("left"), F.col("id").alias("right"), F.lit("same").alias("reason"))
    own = ids.select("id")
    inside = edges.where("src <> dst").join(own.withColumnRenamed("id", "src"), "src", "left_semi").join(own.withColumnRenamed("id", "dst"), "dst", "left_semi")
    joined = inside.select(F.least("src", "dst").alias("left"), F.greatest("src", "dst").alias("right"), F.lit("connected").alias("reason")).distinct()
    return same.union(joined)
