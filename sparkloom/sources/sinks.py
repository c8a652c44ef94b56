"""Writing symbol tables, logs and large results."""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F


def upsert(stored: DataFrame, fresh: DataFrame, key: str = "filepath") -> DataFrame:
    """SK1: stored rows whose key fresh has are replaced by fresh ones."""
    return stored.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def without(stored: DataFrame, gone: DataFrame, key: str = "filepath") -> DataFrame:
    """SK3: rows of keys that are gone go, and with them what belongs to them."""
    return stored.join(gone.select(key).distinct(), key, "left_anti")


def write_version(rows: DataFrame, folder: str) -> str:
    """Writes a table as a new version in a folder and returns its path: a reader of the version before is not disturbed, a failed write leaves nothing that counts."""
    path = f"{folder.rstrip('/')}/v-{uuid4().hex}"
    rows.write.mode("errorifexists").parquet(path)
    return path


def append(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """SK2: adds to a table or a JSON-lines log."""
    rows.write.mode("append").format(kind).save(path)


def truncate(spark: SparkSession, path: str, schema: str) -> None:
    """SK3: an empty table of the schema."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def overwrite_partitions(rows: DataFrame, path: str, *partitions: str) -> None:
    """Replaces the partitions that rows has, and only those."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def compact_if_large(rows: DataFrame, limit: int, folder: str) -> dict:
    """SK4: the rows themselves if their JSON is at most limit bytes, else a stub that tells where they are written. No more than limit bytes and one row come to the driver."""
    sized = rows.select(F.to_json(F.struct("*")).alias("json")).withColumn("n", F.octet_length("json"))
    facts = sized.agg(F.count("*").alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("bytes")).first()
    if facts["bytes"] <= limit:
        return {"rows": [json.loads(r["json"]) for r in sized.select("json").collect()]}
    return {"stub": True, "rows": facts["rows"], "bytes": facts["bytes"], "path": write_version(rows, folder)}
