"""What stands in the spans of files, with one pass over each file's text."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..operators.lineage import shuffled

#: From a file's bytes (None if there is no such file) and its spans' values to a list of texts for each span.
Take = Callable[[bytes | None, list[tuple]], list[list[str | None]]]


def in_spans(spans: DataFrame, sources: DataFrame, using: Sequence[str], take: Take, how: str = "inner") -> DataFrame:
    """Struct ``row`` of the spans' columns, and ``found``: what take gives of the columns named. Spans (filepath, ...) are gathered by file,
    so a file's text (filepath, content) is joined and encoded once, however many spans it has, and goes no further."""
    rows = spans.groupBy("filepath").agg(F.collect_list(F.struct("*")).alias("rows"))
    joined = rows.join(shuffled(sources.select("filepath", "content")), "filepath", how).select("rows", "content")
    texts = pa.list_(pa.list_(pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for own, content in zip(batch.column(0), batch.column(1)):
                text = content.as_py()
                found.append(take(None if text is None else text.encode("utf-8", "surrogatepass"), list(zip(*(own.values.field(c).to_pylist() for c in using)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, texts)], names=["rows", "found"])

    schema = T.StructType([joined.schema["rows"], T.StructField("found", T.ArrayType(T.ArrayType(T.StringType())))])
    return joined.mapInArrow(run, schema).select(F.explode(F.arrays_zip("rows", "found")).alias("x")).select(F.col("x.rows").alias("row"), F.col("x.found").alias("found"))
