"""Alignment of two tokenizers over the same texts, by an event sweep.

A text is encoded by a byte-level BPE (side A, on a space and the text) and by a piece model (side B, which adds the space), both
without special tokens: their strings are plain text. A token's bytes follow from its id, so an end event, the place in the text's
bytes where a token ends, follows from where its run of tokens began. The events of both sides are united as runs of RUN ids, from
one pass over the texts (a pass for each side couldn't tell whether both spell the text), dealt by document and sorted within
partitions by offset. A state machine streams through them: it holds the tokens of both sides since the last common end, and the
open document's counts and hash. Where tokens of both sides end together it emits a group, the tokens of both sides since the last
such place, and a link, the pair of tokens that end there (a token has a byte at least, so no two of a side end together). Many
documents are swept at once: the sides' bytes are as many in each, so common ends are those of two running sums.

Links are counted by pair of ids over all texts. Counts of all pairs are broadcast if they are counted to be at most MOST_PAIRS;
otherwise links and counts are joined, under salts. The texts are shuffled as compressed ids.

Defined results: a text that is null, empty or not spelled by the tokens of both sides has no tokens, zeros and an empty digest.
Rows stay rows, whatever their ids: documents are told by their place in the scan. An empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import packing
from .common import cut, load, map_arrow, map_rows, scratch, slices, utf8

#: Tokens of a run of events, and tokens that are swept or links that are counted at once.
RUN, SWEPT, COUNTED = 2048, 1 << 19, 1 << 21
#: Pairs of ids whose counts may be broadcast, some 17 bytes each; and the salts of a pair beyond that.
MOST_PAIRS, SALTS = 2_000_000, 16
#: Pre-tokens and segments of texts that keep their ids in a Python worker, for each side.
CACHED = 100_000

# ---------------------------------------------------------------- tokenizers


class Differs(Exception):
    """Tokens that don't spell their text."""


class ByteLevel(packing.Encoder):
    """Side A: ids of a byte-level BPE, whose added tokens' strings are plain text."""

    def __init__(self, path: str):
        super().__init__(path, CACHED)
        self.tokenizer.encode_special_tokens = True
        self.special = []
        back = {ord(letter): byte for byte, letter in packing._byte_letters().items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.spelled = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.spelled[i] = bytes(back[ord(c)] for c in token) if all(ord(c) in back for c in token) else utf8(token)

        # where every byte has a token and nothing is normalised, tokens always spell their text
        self.complete = self.tokenizer.normalizer is None and all(letter in vocabulary for letter in packing._byte_letters().values())

    def __call__(self, text: str) -> bytes:
        found = super().__call__(text)
        if not self.complete and b"".join(map(self.spelled.__getitem__, memoryview(found).cast("I"))) != utf8(text):
            raise Differs
        return found


class Pieces:
    """Side B: ids of a piece model that adds a space before a text.

    No piece goes on after a space that follows another letter, and none holds a line end, so each run of spaces with the word after it is
    encoded by itself, and its ids are kept. A model with other pieces gets texts whole."""

    def __init__(self, path: str, most: int = CACHED):
        import sentencepiece

        self.model = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.spelled = [bytes((int(p[3:-1], 16),)) if sp.is_byte(i) else utf8(p.replace("▁", " ")) for i, p in enumerate(pieces)]
        self.space = sp.piece_to_id("▁")
        self.apart = not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)
        self.segment = re.compile("\n|[ ▁]*[^ ▁\n]+|[ ▁]+")
        own = self

        class Kept(dict):
            def __missing__(self, piece: str) -> bytes:
                found = own.encoded(piece)
                if len(piece) <= 64:
                    if len(self) >= most:
                        self.clear()
                    self[piece] = found
                return found

        self.kept = Kept()

    def encoded(self, segment: str) -> bytes:
        """Ids of a segment of the text with its added space."""
        if segment[0] in " ▁":
            ids = self.model.encode(segment[1:]) if len(segment) > 1 else [self.space]
        else:
            ids = self.model.encode("\n" + segment)[2:]
        if b"".join(map(self.spelled.__getitem__, ids)) != utf8(segment):
            raise Differs
        return array("I", ids).tobytes()

    def __call__(self, text: str) -> bytes:
        """text begins with the space that the model adds."""
        if self.apart:
            return b"".join(map(self.kept.__getitem__, self.segment.findall(text)))
        ids = self.model.encode(text[1:])
        if b"".join(map(self.spelled.__getitem__, ids)) != utf8(text):
            raise Differs
        return array("I", ids).tobytes()


_loaded: dict[tuple[str, str], tuple[ByteLevel, Pieces]] = {}


def sides(a: str, b: str) -> tuple[ByteLevel, Pieces]:
    if (a, b) not in _loaded:
        _loaded[a, b] = ByteLevel(a), Pieces(b)
    return _loaded[a, b]


# ---------------------------------------------------------------- events

EVENTS = pa.schema([("place", pa.int64()), ("at", pa.int64()), ("side", pa.int32()), ("doc_id", pa.int64()), ("ids", pa.binary())])


def events(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Runs of end events: the document's place, the byte where a run begins, its side and its compressed ids. A document's first row has no ids; its ``at`` is -1 less the document's bytes."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        import zstandard

        squeeze, both = zstandard.ZstdCompressor(level=1).compress, sides(a, b)
        lengths = [np.fromiter(map(len, s.spelled), np.int64) for s in both]
        for place, doc_id, text in rows:
            found = []
            if text:
                try:
                    found = [np.frombuffer(s(" " + text), np.uint32) for s in both]
                except Differs:
                    pass
            yield place, -1 - (len(utf8(text)) + 1 if found else 0), 0, doc_id, None
            for side, ids in enumerate(found):
                ends = np.cumsum(lengths[side][ids]) if len(ids) > RUN else None  # a text's first run begins at 0
                for k in range(0, len(ids), RUN):
                    yield place, int(ends[k - 1]) if k else 0, side, None, squeeze(ids[k : k + RUN].astype("<u4").tobytes())
        for s in both:
            s.kept.clear()  # workers are used again by other operators

    placed = docs.select(F.monotonically_increasing_id().alias("place"), F.col("doc_id").cast("long"), "text")
    return map_rows(placed, run, "place long, at long, side int, doc_id long, ids binary", EVENTS)


# ---------------------------------------------------------------- sweep

ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, a_ids array<int>, b_ids array<int>, ends array<long>"


class Open:
    """A document whose events are still coming."""

    def __init__(self, doc_id: int | None, size: int):
        self.doc_id, self.left, self.size, self.counts, self.digest, self.links = doc_id, size, size, np.zeros(3, np.int64), hashlib.sha256(), []

    def add(self, counts: np.ndarray, text: str, links: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        if self.links:
            self.digest.update(b";")
        self.digest.update(text.encode())
        self.counts += counts
        self.links.append((links[0], links[1], links[2] + self.size - self.left))
        self.left -= int(links[2][-1])

    def row(self) -> tuple:
        links = [np.concatenate(x) for x in zip(*self.links)] if self.links else [np.zeros(0, np.int64)] * 3
        return self.doc_id, *self.counts.tolist(), self.digest.hexdigest() if self.links else "", *links


class Sweep:
    """The state machine: pending tokens of both sides since the last common end, and the documents that aren't complete."""

    def __init__(self, spelled: tuple[list[bytes], list[bytes]]):
        self.lengths = [np.fromiter(map(len, x), np.int64, len(x)) for x in spelled]
        self.base = 2 * len(spelled[0])
        # how a token is written: what follows it tells whether it is the last of its group
        self.written = [f"{i}{mark}" for last, x in zip("|;", spelled) for i in range(len(x)) for mark in (",", last)]
        self.pending: list[list[np.ndarray]] = [[], []]
        self.held, self.open = 0, []

    def begin(self, doc_id: int | None, size: int) -> None:
        self.open.append(Open(doc_id, size))

    def add(self, side: int, ids: np.ndarray) -> None:
        self.pending[side].append(ids)
        self.held += len(ids)

    def flush(self) -> Iterator[tuple]:
        """Rows of the documents that are complete by now."""
        (a, b), self.held = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in self.pending], 0
        ends_a, ends_b = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        common = np.zeros(0, np.int64)
        if len(a) and len(b):
            marks = np.zeros(int(min(ends_a[-1], ends_b[-1])) + 1, np.uint8)
            marks[ends_a[: np.searchsorted(ends_a, len(marks))]] = 1
            marks[ends_b[: np.searchsorted(ends_b, len(marks))]] += 1
            common = np.flatnonzero(marks == 2)
        last_a, last_b = np.searchsorted(ends_a, common), np.searchsorted(ends_b, common)
        upto_a, upto_b = (int(last_a[-1]) + 1, int(last_b[-1]) + 1) if len(common) else (0, 0)
        self.pending = [[a[upto_a:]], [b[upto_b:]]]
        self.held = len(a) - upto_a + len(b) - upto_b
        words = self._written(a[:upto_a], b[:upto_b], last_a, last_b) if len(common) else []
        at, group = 0, 0
        while self.open:
            doc = self.open[0]
            upto = int(np.searchsorted(common, at + doc.left, "right"))
            if upto > group:
                first_a, first_b = (int(last_a[group - 1]) + 1, int(last_b[group - 1]) + 1) if group else (0, 0)
                end_a, end_b = int(last_a[upto - 1]) + 1, int(last_b[upto - 1]) + 1
                text = "".join(words[first_a + first_b : end_a + end_b])[:-1]
                own = slice(group, upto)
                doc.add(np.array([end_a - first_a, end_b - first_b, upto - group]), text, (a[last_a[own]], b[last_b[own]], common[own] - at))
                at, group = int(common[upto - 1]), upto
            if doc.left:
                break
            yield self.open.pop(0).row()

    def _written(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> list[str]:
        """The tokens as written, group by group, those of side A first."""
        groups = np.arange(len(last_a))
        of_a, of_b = np.repeat(groups, np.diff(last_a, prepend=-1)), np.repeat(groups, np.diff(last_b, prepend=-1))
        out = np.empty(len(a) + len(b), np.int64)
        before_b = np.concatenate([[0], last_b + 1])
        at_a, at_b = np.arange(len(a)) + before_b[of_a], np.arange(len(b)) + last_a[of_b] + 1
        out[at_a], out[at_b] = 2 * a, self.base + 2 * b
        out[at_a[last_a]] += 1
        out[at_b[last_b]] += 1
        return list(map(self.written.__getitem__, out.tolist()))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of Sweep as Arrow, their links without a Python object each."""
    plain, lists = list(zip(*rows))[:5], list(zip(*rows))[5:]
    offsets = pa.array(np.cumsum([0, *map(len, lists[0])]), pa.int32())
    kinds = [*[pa.int64()] * 4, pa.string()]
    linked = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x), kind)) for x, kind in zip(lists, (pa.int32(), pa.int32(), pa.int64()))]
    names = [c.split()[0] for c in ALIGNED.split(", ")]
    return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(plain, kinds)), *linked], names=names)


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """A row for each document: tokens of each side, groups, their digest, and the links: ids of both sides and the byte of space and text where they end."""
    dealt = events(docs, a, b).repartition("place").sortWithinPartitions("place", "at", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, sweep = zstandard.ZstdDecompressor().decompress, Sweep(tuple(s.spelled for s in sides(a, b)))
        for batch in batches:
            for part in slices(batch):
                for at, side, doc_id, ids in zip(*(part.column(c).to_pylist() for c in ("at", "side", "doc_id", "ids"))):
                    if ids is None:
                        if sweep.held >= SWEPT and (rows := list(sweep.flush())):
                            yield _batch(rows)
                        sweep.begin(doc_id, -1 - at)
                    else:
                        sweep.add(side, np.frombuffer(unpack(ids), "<u4"))
                        if sweep.held >= 2 * SWEPT and (rows := list(sweep.flush())):
                            yield _batch(rows)
        if rows := list(sweep.flush()):
            yield _batch(rows)

    return map_arrow(dealt, run, ALIGNED)


# ---------------------------------------------------------------- counts of pairs


def pair_counts(aligned: DataFrame) -> DataFrame:
    """a, b and n: how many links hold each pair of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array((pairs >> 32).astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], names=["a", "b", "n"])

        for batch in batches:
            held.append(_keys(batch.column(0), batch.column(1)))
            size += len(held[-1])
            if size >= COUNTED:
                yield flush()
                size = 0
        if held:
            yield flush()

    return map_arrow(aligned.select("a_ids", "b_ids"), run, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _keys(a: pa.Array, b: pa.Array) -> np.ndarray:
    return (a.flatten().to_numpy().astype(np.int64) << 32) | b.flatten().to_numpy()


def with_support(aligned: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """aligned without its links, with n_links, n_best (links whose pair is counted most for its b, ties included) and count_sum (of the links' pairs)."""
    counts = cut(pair_counts(aligned))
    best = counts.groupBy("b").agg(F.max("n").alias("most"))  # a row for each id of side B
    known = counts.join(F.broadcast(best), "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))
    plain = aligned.drop("a_ids", "b_ids", "ends")
    if counts.count() > most_pairs:
        placed = aligned.withColumn("place", F.monotonically_increasing_id())
        links = placed.select("place", F.explode(F.arrays_zip("a_ids", "b_ids")).alias("link")).groupBy("place", "link").agg(F.count("*").alias("times"))
        salted = links.select("place", "link.a_ids", "link.b_ids", "times", F.pmod(F.xxhash64("place"), F.lit(SALTS)).cast("int").alias("salt"))
        spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(spread, (F.col("a_ids") == F.col("a")) & (F.col("b_ids") == F.col("b")) & (salted.salt == spread.salt))
        sums = joined.groupBy("place").agg(F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        zero = (F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum"))
        return placed.drop("a_ids", "b_ids", "ends").join(sums, "place", "left").select(*plain.columns, *zero)
    table = known.sort("a", "b").toArrow()  # at most most_pairs rows
    shared = aligned.sparkSession.sparkContext.broadcast(((table.column("a").to_numpy().astype(np.int64) << 32) | table.column("b").to_numpy(), table.column("n").to_numpy(), table.column("best").to_numpy()))
    names = plain.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n, best = shared.value
        for part in (part for batch in batches for part in slices(batch)):
            at = np.searchsorted(pairs, _keys(part.column("a_ids"), part.column("b_ids")))
            sizes = part.column("a_ids").value_lengths().to_numpy()
            upto = np.concatenate([[0], np.cumsum(sizes)])
            found = [np.diff(np.concatenate([[0], np.cumsum(x[at].astype(np.int64))])[upto]) for x in (best, n)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *(pa.array(x, pa.int64()) for x in (sizes, *found))], names=[*names, "n_links", "n_best", "count_sum"])

    kinds = ", ".join(f"{c} {k}" for c, k in plain.dtypes)
    return map_arrow(aligned.select(*names, "a_ids", "b_ids"), run, f"{kinds}, n_links long, n_best long, count_sum long")


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = align(load(spark, sf_dir, "documents"), packing.tokenizer_path(), public_tokenizers.path("piece_bpe_32k.model"))
    folder = scratch(spark, "aligned")
    found.drop("ends").write.option("compression", "zstd").parquet(folder)
    return with_support(spark.read.parquet(folder)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {"op12_tokenizer_alignment": op12_tokenizer_alignment}
ORACLE_SQL: dict[str, str] = {}
