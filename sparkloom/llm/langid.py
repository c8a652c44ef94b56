"""Language ID by compression: the language whose text, as a raw-content dictionary, lets zstandard make the document smallest.

Each language's dictionary is a sample of labelled texts. A document is lower-cased, what is no letter becomes a space, and
its whole text is compressed in blocks with every dictionary; the sizes of the blocks add up. A narrow margin is looked at
again at stronger levels, whose sizes are added. Where the margin is still below ``min_margin``, ``accepted`` is false.

Defined results: a null text, and one that has no letter, gets ``und`` with score 0 and isn't accepted; so does every text if
there is nothing to learn from. Equal sizes go to the language that sorts first. Rows with equal texts get equal predictions.
Null and repeated doc_ids are predicted row by row. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import columns, id_text, load, map_arrow, row_and, slices

#: Bytes of a language's dictionary, and rows and characters of the labelled sample that one language gives at most.
DICTIONARY_BYTES = 1 << 16
SAMPLE_ROWS = 192
SAMPLE_CHARS = 1 << 15
#: Languages learned at most: dictionaries go to every task, so their number must be bounded. More than that raises an error.
MOST_LANGUAGES = 512
BLOCK = 4096
LEVEL, CLOSER_LEVELS = 5, (9, 12)
CLOSER_MARGIN, MIN_MARGIN = 0.03, 0.002
UNKNOWN = "und"

_NO_LETTER = re.compile(r"[\W\d_]+")


def normalise(text: str) -> bytes:
    return _NO_LETTER.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def learn(labelled: DataFrame) -> dict[str, bytes]:
    """Dictionaries from columns doc_id, text and lang, out of a bounded sample of each language's rows, by hash of the id."""
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    if not counts:
        return {}
    # the share of rows that gives several times the wanted number; it is 1 for a small language
    share = F.coalesce(*(F.when(F.col("lang") == name, F.lit(min(1.0, 4 * SAMPLE_ROWS / n))) for name, n in sorted(counts.items())))
    at = F.xxhash64(F.col("doc_id"), F.lit(9))
    few = rows.where(F.pmod(at, F.lit(1 << 20)) < share * (1 << 20)).select("lang", at.alias("at"), F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    order = Window.partitionBy("lang").orderBy("at", "text")
    found: dict[str, dict[bytes, None]] = {}
    for row in few.withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE_ROWS).orderBy("lang", "n").toLocalIterator():
        if clean := normalise(row["text"]):
            found.setdefault(row["lang"], {})[clean] = None
    return {name: b"\n".join(texts)[:DICTIONARY_BYTES] for name, texts in sorted(found.items())}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        self.dictionaries = dict(sorted(dictionaries.items()))
        self._at: dict[int, list] = {}

    def _compressors(self, level: int) -> list:
        import zstandard

        if level not in self._at:
            made = []
            for raw in self.dictionaries.values():
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=level)
                made.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False))
            self._at[level] = made
        return self._at[level]

    def sizes(self, data: bytes, level: int) -> list[int]:
        blocks = [data[k : k + BLOCK] for k in range(0, len(data), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self._compressors(level)]

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and margin: how much smaller the smallest size is than the next one, as a share of that."""
        if not text or not any(map(str.isalpha, text)) or not self.dictionaries:
            return UNKNOWN, 0.0
        data = normalise(text)
        names, sizes = list(self.dictionaries), self.sizes(data, LEVEL)
        if len(names) == 1:
            return names[0], 1.0
        if _margin(sizes) < CLOSER_MARGIN:
            for level in CLOSER_LEVELS:
                sizes = [a + b for a, b in zip(sizes, self.sizes(data, level))]
        return names[sizes.index(min(sizes))], _margin(sizes)


def _margin(sizes: list[int]) -> float:
    best, second = sorted(sizes)[:2]
    return (second - best) / second


def predict(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = MIN_MARGIN, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Struct ``row`` of the kept columns, lang_pred, score and accepted, for column text."""
    classifier = Classifier(dictionaries)
    left = docs.select(F.struct(*columns(keep)).alias("row"), "text")
    schema = row_and(left, "lang_pred string, score double, accepted boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            found = [classifier.predict(text) for text in batch.column(1).to_pylist()]
            names, scores = [x for x, _ in found], [y for _, y in found]
            sure = [x != UNKNOWN and y >= min_margin for x, y in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sure, pa.bool_())], names=["row", "lang_pred", "score", "accepted"])

    return map_arrow(left, run, schema)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(id_text("doc_id")) % 4 == 2, F.lit(False))


def learned_rows(docs: DataFrame) -> DataFrame:
    """What may be learned from: rows with a language that aren't held out. A null doc_id can't be told apart, so is not learned from."""
    return docs.where(F.col("doc_id").isNotNull() & ~held_out())


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    found = predict(docs, learn(learned_rows(docs))).select("row.doc_id", "lang_pred", "score", "accepted")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a sufficient margin."""
    return predict(docs, learn(learned_rows(docs)), keep=tuple(docs.columns)).where("accepted").select("row.*")


QUERIES = {"op9_language_id": op9_language_id}
ORACLE_SQL: dict[str, str] = {}
