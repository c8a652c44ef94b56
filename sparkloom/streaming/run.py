"""Running a stream over what is there, and reading its result as a table."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from ..operators.lineage import cut, remove, shared_dir


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share."""
    return f"{shared_dir(spark)}/stream-{uuid4().hex}"


def available_now(stream: DataFrame, mode: str = "append", folder: str | None = None) -> DataFrame:
    """The stream's rows over all its input so far. In append mode they go to files, exactly once; else the last batch's result table is kept.

    State and rows are kept in ``folder`` if it is given, and are the caller's; else the rows are copied to a checkpoint and the rest is removed."""
    spark, own = stream.sparkSession, folder or shared_folder(stream.sparkSession)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{own}/state").trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{own}/out")
    else:
        writer = writer.foreachBatch(lambda batch, number: batch.write.mode("overwrite").parquet(f"{own}/out"))
    running = writer.start()
    running.awaitTermination()
    found = spark.read.schema(stream.schema).parquet(f"{own}/out")
    if folder:
        return found
    kept = cut(found)
    remove(spark, own)
    return kept
