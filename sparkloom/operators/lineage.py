"""Cutting lineage in the folder that driver and executors share, and folders in it."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a temporary one, but only where driver and executors are one process; elsewhere an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows, computed once and kept by a reliable checkpoint: later steps survive a lost executor without recomputing what came before."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast. Sizes are estimated from the files that rows are computed from; where texts are made or scanned they are far too low."""
    return df.hint("merge")


#: Rows of a join's result that one part of a key gives.
PART_ROWS = 5_000_000
MOST_TASKS = 10_000


def spread_join(left: DataFrame, right: DataFrame, on: Sequence[str], by: str, part_rows: int = PART_ROWS) -> DataFrame:
    """Inner join of keys that may have many rows on both sides. A key that gives over part_rows is dealt into parts: the left side's rows by
    a hash of column ``by``, the right side's go to each part. So no task has all of a key's result, and there are as many tasks as parts."""
    sizes = left.groupBy(*on).agg(F.count("*").alias("n")).join(right.groupBy(*on).agg(F.count("*").alias("m")), list(on))
    large = cut(sizes.select(*on, F.ceil(F.col("n") * F.col("m") / part_rows).cast("int").alias("parts")).where("parts > 1"))
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")) + int(large.agg(F.sum("parts")).first()[0] or 0)
    parts = F.coalesce("parts", F.lit(1))
    dealt = left.join(large, list(on), "left").withColumn("part", F.pmod(F.hash(by), parts)).drop("parts")
    copied = right.join(large, list(on), "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    keys = [*on, "part"]
    return dealt.repartition(min(tasks, MOST_TASKS), *keys).join(shuffled(copied), keys).drop("part")


def remove(spark: SparkSession, folder: str) -> None:
    """Removes a folder on whatever file system it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Rounds:
    """Tables of a loop's rounds, in the shared folder. A table takes the place of the one of its name from the round before; unlike
    checkpoints, whose size estimates multiply from join to join, written tables have their true sizes."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths, self.n = spark, f"{shared_dir(spark)}/rounds-{uuid4().hex}", {}, 0

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path, before, self.n = f"{self.folder}/{self.n}", self.paths.get(name), self.n + 1
        df.write.parquet(path)
        if before:
            remove(self.spark, before)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def last(self, df: DataFrame) -> DataFrame:
        """The result, kept apart from the tables, which are removed."""
        found = cut(df)
        remove(self.spark, self.folder)
        return found
