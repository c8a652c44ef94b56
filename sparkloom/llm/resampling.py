"""Importance resampling towards a target distribution, by hashed n-grams of words.

Features of a text are its runs of one to ``LONGEST`` consecutive words; a feature's bucket is the CRC-32 of its words, joined by
one space, modulo ``BUCKETS``. How much likelier a bucket is among the target's features than among the documents' gives its
gain; a document's weight is the sum over its features, repeats included. Gumbel noise from a hash of the id makes the draw of
the highest scores a draw without replacement in proportion to the weights.

A task takes some hundred thousand words at a time as ids and sorts their suffixes by the first ``LONGEST`` words, in one
integer each. The longest common prefix of neighbours in this suffix array cuts it into runs, for each length of n-gram, of all
its occurrences. A run is hashed once, onwards from the hash of the shorter n-gram that it extends; its length counts its bucket,
or the bucket's gain is scattered back to where the suffixes stand. Long texts go in overlapping pieces, so memory is bounded.

Counting and scoring each read the texts once and shuffle none: partial counts of at most BUCKETS rows a task are summed. Ranks
come from a sort of narrow rows by ranges, of which only the numbers of rows reach the driver.

Words are runs of other than ASCII characters that are no digits or letters, with A-Z lower-cased.

Defined results: a null, empty or wordless text has no feature and weight 0. A null doc_id hashes like an empty one and comes last
among ties; repeated ids and rows are drawn row by row. Null target texts have no features. Empty tables give no rows, an empty
target a gain of 0 or less for every bucket that the documents use above average. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import cut, load, map_arrow, slices, utf8

LONGEST, BUCKETS, SEED = 3, 10_000, 42
#: A document has at least so many words to be drawn, and so many of a hundred are drawn.
LEAST_WORDS, PERCENT = 20, 5
#: Words whose suffixes are sorted at once, bytes of a text that are split at once, and words that keep their ids from one sort to the next.
SORTED_WORDS, SPLIT_BYTES, KEPT_WORDS = 1 << 18, 1 << 20, 1 << 20
#: Bits of a word's id in a suffix: three fit a signed long. Id 0 ends a text.
ID_BITS = 21
_MASK = (1 << ID_BITS) - 1
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> Iterator[list[bytes]]:
    """The words, some at a time."""
    data, at = utf8(text).translate(_WORD_BYTES), 0
    while at < len(data):
        stop = data.find(b" ", at + SPLIT_BYTES)
        stop = len(data) if stop < 0 else stop
        yield data[at:stop].split()
        at = stop


class Words(dict):
    """Ids of words from 1, with each word's hash and its bytes after a space."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes, self.spaced = [0], [b""]

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self.hashes)
        self.hashes.append(crc32(word))
        self.spaced.append(b" " + word)
        return found

    def forget(self) -> None:
        self.clear()
        del self.hashes[1:], self.spaced[1:]


class Runs:
    """The suffix array of some texts' words and its runs of equal n-grams."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, known: Words):
        """ids end with two zeros; suffixes start at starts."""
        suffixes = (ids[starts] << 2 * ID_BITS) | (ids[starts + 1] << ID_BITS) | ids[starts + 2]
        self.order = np.argsort(suffixes)
        self.suffixes, self.known = suffixes[self.order], known
        lcp = np.zeros(len(starts), np.int8)  # with the suffix before
        for n in range(1, LONGEST + 1):
            prefix = self.suffixes >> (LONGEST - n) * ID_BITS
            lcp[1:] += prefix[1:] == prefix[:-1]
        self.lcp = lcp

    def __iter__(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each n: the runs' lengths in order of the array, which of them are n-grams (others reach beyond their text), and the buckets of these."""
        hashes, run_of = None, None
        for n in range(1, LONGEST + 1):
            new = self.lcp < n
            if len(new):
                new[0] = True
            heads = np.flatnonzero(new)
            last = (self.suffixes[heads] >> (LONGEST - n) * ID_BITS) & _MASK
            full = last > 0
            if n == 1:
                own = list(map(self.known.hashes.__getitem__, last.tolist()))
            else:
                shorter = hashes[run_of[heads[full]]]
                own = list(map(crc32, map(self.known.spaced.__getitem__, last[full].tolist()), shorter.tolist()))
            hashes = np.zeros(len(heads), np.int64)
            hashes[full] = own
            run_of = np.cumsum(new) - 1
            yield np.diff(np.append(heads, len(new))), full, hashes[full] % BUCKETS


class Reader:
    """Gives each text's words to the suffix arrays."""

    def __init__(self) -> None:
        self.known = Words()

    def read(self, texts: Iterable[str | None]) -> Iterator[tuple[Runs, np.ndarray]]:
        """Runs, and the number of the text in which each suffix starts; sizes holds each text's number of words afterwards."""
        self.sizes: list[int] = []
        ids, starts, owners, held = [], [], [], 0

        def flush() -> tuple[Runs, np.ndarray]:
            nonlocal held
            found = Runs(np.concatenate(ids), np.concatenate(starts), self.known), np.concatenate(owners)
            ids.clear(), starts.clear(), owners.clear()
            held = 0
            return found

        for n, text in enumerate(texts):
            carried, size, parts = [], 0, words(text)
            part = next(parts, [])
            while part is not None:
                after, size, part = next(parts, None), size + len(part), carried + part
                # the last words of a piece start suffixes in the next one, where what follows is known
                begins = len(part) if after is None else max(0, len(part) - LONGEST + 1)
                if part:
                    ids.append(np.fromiter(map(self.known.__getitem__, part), np.int64, len(part)))
                    ids.append(np.zeros(LONGEST - 1, np.int64))
                    starts.append(np.arange(held, held + begins))
                    owners.append(np.full(begins, n))
                    held += len(part) + LONGEST - 1
                if held >= SORTED_WORDS:
                    yield flush()
                    if len(self.known) > KEPT_WORDS:
                        self.known.forget()
                carried, part = part[max(0, len(part) - LONGEST + 1) :], after
            self.sizes.append(size)
        if held:
            yield flush()


def features_of(words: int) -> int:
    return sum(max(0, words - n) for n in range(LONGEST))


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features of each bucket in a table's first column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, reader = np.zeros(BUCKETS, np.int64), Reader()
        for part in (part for batch in batches for part in slices(batch)):
            for runs, _ in reader.read(part.column(0).to_pylist()):
                for lengths, full, buckets in runs:
                    total += np.bincount(buckets, lengths[full], BUCKETS).astype(np.int64)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    found = np.zeros(BUCKETS, np.int64)
    for row in map_arrow(texts, run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        found[row["bucket"]] = row["n"]
    return found


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target, with one more feature in every bucket of both."""
    s, t = float(source.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([floor(1000 * log((float(b) + 1) * s / ((float(a) + 1) * t))) for a, b in zip(source, target)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Gumbel noise in thousandths, from a hash of the seed and the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return floor(-1000 * log(-log((h + 0.5) / 4294967296)))


def scores(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for part in (part for batch in batches for part in slices(batch)):
            weights = np.zeros(len(part), np.int64)
            for runs, owners in reader.read(part.column(1).to_pylist()):
                each = np.zeros(len(owners), np.int64)
                for lengths, full, buckets in runs:
                    own = np.zeros(len(lengths), np.int64)
                    own[full] = gain[buckets]
                    each += np.repeat(own, lengths)
                back = np.empty_like(each)
                back[runs.order] = each
                first = np.flatnonzero(np.diff(owners, prepend=-1))
                if len(first):
                    weights[owners[first]] += np.add.reduceat(back, first)
            ids = part.column(0).to_pylist()
            noisy = [int(w) + noise(i, seed) for i, w in zip(ids, weights)]
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (reader.sizes, list(map(features_of, reader.sizes)), weights, noisy))], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, n_words long, n_features long, weight long, score long")


def numbered(rows: DataFrame, *order: Column) -> tuple[DataFrame, int]:
    """Column rank from 1 in an order over the whole table, and the number of rows. Each task sorts a range of rows."""
    place = F.monotonically_increasing_id()
    placed = cut(rows.orderBy(*order)).withColumn("place", place)
    sizes = sorted(tuple(r) for r in placed.groupBy(F.shiftright("place", 33).alias("part")).count().collect())  # a row for each task of the sort
    before = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    offsets = rows.sparkSession.createDataFrame([(part, at) for (part, _), at in zip(sizes, before)], "part long, before long")
    ranked = placed.withColumn("part", F.shiftright("place", 33)).join(F.broadcast(offsets), "part")
    return ranked.withColumn("rank", F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("part", "before", "place"), before[-1]


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of each row; rank is null for those that aren't drawn."""
    gain = gains(bucket_counts(docs.select("text")), bucket_counts(target.select("text")))
    found = cut(scores(docs, gain, seed)).withColumn("place_before", F.monotonically_increasing_id())
    able = found.where(F.col("n_words") >= least_words)
    ranked, rows = numbered(able, F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("place_before"))  # the place parts repeated rows
    drawn = F.when(F.col("rank") <= percent * rows // 100, F.col("rank"))
    others = found.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.withColumn("rank", drawn).unionByName(others).drop("place_before")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op13_importance_resampling": op13_importance_resampling}
#: DuckDB has no CRC-32.
ORACLE_SQL: dict[str, str] = {}
