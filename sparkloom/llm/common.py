"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.lineage import cut, remove, shared_dir
from ..shipping import ship

__all__ = ["columns", "cut", "id_text", "load", "map_arrow", "map_rows", "release", "remove", "row_and", "rows_to_batches", "scratch", "shared_dir", "slices", "sweep", "utf8"]

#: Rows that one Arrow batch handed back to Spark holds at most, and rows of a batch that are Python objects at once.
OUT_ROWS, IN_ROWS = 20_000, 500
#: Rows that Spark hands to Python at once in the queries: texts are long, and both sides hold a batch.
ARROW_SETTING, SPARK_ROWS, ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", 1000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A query's table. Queries, not operators, set the session's Arrow batches, where it has Spark's own default."""
    ship(spark)
    if spark.conf.get(ARROW_SETTING) == SPARK_ROWS:
        spark.conf.set(ARROW_SETTING, str(ARROW_ROWS))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


_scratch: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one for what a stage writes and its result still reads."""
    _scratch.append(f"{shared_dir(spark)}/{name}-{uuid4().hex}")
    return _scratch[-1]


def sweep(spark: SparkSession) -> None:
    """Removes the scratch folders: for whoever has written the results that read them."""
    while _scratch:
        remove(spark, _scratch.pop())


def rows_to_batches(rows: Iterable[tuple], schema: pa.Schema, at_most: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size from tuples in the schema's order."""
    kept: list[tuple] = []
    for row in rows:
        kept.append(row)
        if len(kept) >= at_most:
            yield _batch(kept, schema)
            kept = []
    if kept:
        yield _batch(kept, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, type=field.type) for column, field in zip(zip(*rows), schema)], schema=schema)


def slices(batch: pa.RecordBatch, rows: int = IN_ROWS) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(batch), rows):
        yield batch.slice(k, rows)


def release() -> None:
    """Gives freed memory back to the system: Python workers live on and serve other operators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow that gives memory back to the system after each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        release()

    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, function: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str, arrow: pa.Schema) -> DataFrame:
    """mapInArrow for a function from an iterator over row tuples to tuples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for part in slices(batch):
                    yield from zip(*(c.to_pylist() for c in part.columns))

        yield from rows_to_batches(function(rows()), arrow)

    return map_arrow(df, run, schema)


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def columns(names: Iterable[str]) -> list[F.Column]:
    """Top-level columns, whatever their names: a dot in one is no field's."""
    return [F.col("`" + name.replace("`", "``") + "`") for name in names]


def row_and(df: DataFrame, more: str) -> T.StructType:
    """Schema of the table's struct ``row``, whatever its fields' names, and of more columns."""
    return T.StructType([df.schema["row"], *T.StructType.fromDDL(more)])


def id_text(column: str) -> F.Column:
    return F.col(column).cast("string")
