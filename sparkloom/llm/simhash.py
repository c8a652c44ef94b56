"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprint: words are runs of other than ASCII white space in the text with A-Z lower-cased; each shingle of three words,
joined by spaces, is hashed by XXH64 with seed 42; a bit is set if it is set in over half of a document's hashes.

Candidates: the 64 bits are cut into three segments of 22, 21 and 21. Two fingerprints at distance 2 or less have a segment
without error whose successor, cyclically, has one error at most (pigeonhole, see tests). So each fingerprint gives, for each
segment, keys of the exact segment and a codeword of the binary Golay code [23,12,7] for the next: one index key from the
nearest codeword, and probe keys from all codewords within distance 4, of which there are one or six. As the code is perfect
with radius 3, a word's nearest codeword lies within 4 of each word one error away. Index and probe keys are joined and each
pair verified on the whole 64 bits. Only distinct fingerprints take part, so copies, however many, make no pairs.

Components: local union-find in each partition of the links, then alternating large-star and small-star rounds (``near``).

The pipeline's stage links by the sets of five-word shingles instead, at Jaccard similarity 0.8 or more: such texts differ in up
to some 17 of 64 bits, which no Golay keys reach. Texts with equal sets are one node, named by a digest of the set. So each distinct
set has a SimHash of several words of 64 bits, each bit the majority of that bit in the shingles' hashes. In a table nodes are put
into buckets by some of the bits, so many that a bucket has BUCKET_ROWS nodes at most on average, and there are as many tables as let
a pair that differs in a share APART of its bits miss them all with a chance of MISSED; no bit serves two tables while they last. Within
a bucket all nodes are compared by the CHECKED bits, which serve no table: pairs that differ in MOST_APART of them at most are
candidates, whose whole sets are then compared; blocks and components are told in ``near``. At 0.8 a share of 0.152 of the bits differs
on average, in sets of 12 and 15 shingles 0.161, and 0.188, the most, where one of four shingles is part of one of five: at two million
nodes a pair of these misses the tables with a chance of 0.002. Texts without words are equal.

Defined results: a null or wordless text has fingerprint zero, which links like any other. component_id is the least non-null
doc_id of the rows reachable, null if there is none. Repeated rows keep a row each. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import near
from .common import columns, cut, load, map_arrow, row_and, slices, utf8
from .near import components, set_digest

WORDS = 3
SEED = 42
MAX_BITS = 2
#: Words of a shingle and least Jaccard similarity of the pipeline's stage.
STAGE_WORDS, STAGE_SIMILARITY = 5, 0.8
#: Words of 64 bits of the stage's fingerprints at most, and how many of them, from the first on, are compared within buckets.
MOST_WORDS, CHECKED = 32, 3
#: Nodes of a bucket on average, at most; share of bits that are taken to differ in pairs at the similarity; their chance to share no bucket.
BUCKET_ROWS, APART, MISSED = 1024, 0.161, 1e-4
#: Bits of the first two words, and of all checked words, in which candidates differ at most: 4.5 and 3.3 standard deviations more than any pair at 0.8 has on average.
MOST_APART = (44, 54)
#: Rows of a bucket that are compared with the others at once, and near.BLOCK_ROWS of a block.
COMPARED, BUCKET_BLOCKS = 32, 8
#: Shingle hashes that a Python worker counts at once.
AT_ONCE = 1 << 17
#: Documents of a batch handed back to Spark.
ROWS = 500

# ---------------------------------------------------------------- fingerprints


def shingle_hashes(text: str | None, width: int = WORDS) -> list[int]:
    import xxhash

    words = utf8(text).lower().split()  # bytes: only A-Z and ASCII white space
    if not words:
        return []
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)))) if len(words) >= width else [b" ".join(words)]
    return list(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)))


def majority(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A fingerprint for each run of ``lengths`` hashes: the bits set in over half of it."""
    out = np.zeros(len(lengths), np.uint64)
    full = np.flatnonzero(lengths)
    if len(full):
        ends = np.cumsum(lengths[full])
        starts = ends - lengths[full]
        sums = np.zeros((len(full), 64), np.int64)
        for at in range(0, len(hashes), AT_ONCE):  # long documents span several rounds
            stop = min(len(hashes), at + AT_ONCE)
            first, last = np.searchsorted(ends, at, "right"), np.searchsorted(starts, stop, "left")
            bits = np.unpackbits(hashes[at:stop].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums[first:last] += np.add.reduceat(bits, np.maximum(starts[first:last] - at, 0), axis=0, dtype=np.int32)
        over = (2 * sums > lengths[full][:, None]).astype(np.uint8)
        out[full] = np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(texts: list[str | None]) -> np.ndarray:
    out, hashes, lengths = [], [], []

    def count() -> None:
        out.append(majority(np.array(hashes, np.uint64), np.array(lengths, np.int64)))
        hashes.clear(), lengths.clear()

    for text in texts:
        own = shingle_hashes(text)
        hashes.extend(own)
        lengths.append(len(own))
        if len(hashes) >= AT_ONCE:
            count()
    count()
    return np.concatenate(out)


def with_fingerprint(docs: DataFrame, keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """Struct ``row`` of the kept columns, and fp: the fingerprint as a signed long."""
    left = docs.select(F.struct(*columns(keep)).alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), ROWS):
                own = batch.slice(k, ROWS)
                yield pa.RecordBatch.from_arrays([own.column(0), pa.array(fingerprints(own.column(1).to_pylist()).view(np.int64))], names=["row", "fp"])

    return map_arrow(left, run, row_and(left, "fp long"))


# ---------------------------------------------------------------- Golay code

#: Generator polynomial of the binary Golay code of length 23: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
LENGTH, PARITY = 23, 11
#: Lowest bit and width of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainders of the words, as polynomials, by the generator."""
    left = words.astype(np.int64)
    for bit in range(LENGTH - 1, PARITY - 1, -1):
        left = np.where(left >> bit & 1, left ^ (GENERATOR << (bit - PARITY)), left)
    return left


def _patterns() -> np.ndarray:
    """For each syndrome the errors of up to four bits that have it, the lightest first; rows are filled up with that one."""
    errors = np.array([sum(1 << b for b in bits) for weight in range(5) for bits in combinations(range(LENGTH), weight)], np.int64)
    found: list[list[int]] = [[] for _ in range(1 << PARITY)]
    for error, at in zip(errors.tolist(), syndrome(errors).tolist()):
        found[at].append(error)
    most = max(map(len, found))
    return np.array([x + x[:1] * (most - len(x)) for x in found], np.int64)


PATTERNS = _patterns()


def codeword_keys(words: np.ndarray) -> np.ndarray:
    """Indices of the codewords within distance 4 of each 23-bit word: the nearest in column 0, it again where there is no other."""
    return (words[:, None] ^ PATTERNS[syndrome(words)]) >> PARITY


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index keys, their rows, probe keys, their rows) of distinct fingerprints; a key holds slot, exact segment and codeword."""
    parts = [(fps >> np.uint64(low) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    rows = np.arange(len(fps))
    index, at, probe, probe_at = [], [], [], []
    for slot in range(3):
        base = (slot << 40) | (parts[slot] << 12)
        near = codeword_keys(parts[(slot + 1) % 3])
        index.append(base | near[:, 0])
        at.append(rows)
        for k in range(near.shape[1]):
            own = rows if k == 0 else np.flatnonzero(near[:, k] != near[:, 0])
            probe.append(base[own] | near[own, k])
            probe_at.append(own)
    return tuple(map(np.concatenate, (index, at, probe, probe_at)))


def links(distinct: DataFrame) -> DataFrame:
    """Pairs a < b of a table of distinct fingerprints (column fp) that differ in one or two bits."""

    def run(probing: bool) -> Callable:
        def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                signed = batch.column(0).to_numpy(zero_copy_only=False)
                found = keys(signed.view(np.uint64))[2 if probing else 0 :][:2]
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(signed[found[1]])], names=["key", "fp"])

        return batches_of

    index = distinct.select("fp").mapInArrow(run(False), "key long, fp long").alias("i")
    probe = distinct.select("fp").mapInArrow(run(True), "key long, fp long").alias("p")
    near = (F.col("i.fp") != F.col("p.fp")) & (F.bit_count(F.col("i.fp").bitwiseXOR(F.col("p.fp"))) <= MAX_BITS)
    pairs = probe.join(index, (F.col("i.key") == F.col("p.key")) & near & (F.col("p.fp") < F.col("i.fp")))
    return pairs.select(F.col("p.fp").alias("a"), F.col("i.fp").alias("b")).distinct()


# ---------------------------------------------------------------- similar sets of shingles

_STEPS = np.random.default_rng(SEED).integers(0, 1 << 63, MOST_WORDS, np.uint64)
#: A byte's bits as bytes, which are added up for 255 rows at once.
_LANES, LANE_ROWS = np.unpackbits(np.arange(256, dtype=np.uint8), bitorder="little").view(np.uint64), 255


def wide_fingerprint(own: np.ndarray, words: int = MOST_WORDS) -> np.ndarray:
    """Bits of a set's SimHash, as bytes: those that are set in over half of what its shingles' hashes are mixed to."""
    counts = np.zeros(64 * words, np.int64)
    for at in range(0, len(own), LANE_ROWS):
        mixed = near.mixed(own[at : at + LANE_ROWS, None] + _STEPS[:words])
        counts += _LANES[mixed.astype("<u8", copy=False).view(np.uint8)].sum(axis=0).view(np.uint8)
    return np.packbits(2 * counts > len(own), bitorder="little")


def table_bits(nodes: int) -> tuple[np.ndarray, int]:
    """The bits that are the key of each table, a row each, for so many nodes, and the words that fingerprints have then; no bits where one bucket does."""
    width = max(0, math.ceil(math.log2(max(1, nodes) / BUCKET_ROWS)))
    tables = math.ceil(math.log(MISSED) / math.log(1 - (1 - APART) ** width)) if width else 1
    words = min(MOST_WORDS, CHECKED + -(-tables * width // 64))
    source, out = np.random.default_rng(SEED), [np.zeros(0, np.int64)] * (not width)
    while len(out) < tables:
        order = source.permutation(np.arange(64 * CHECKED, 64 * words))
        out += [order[k : k + width] for k in range(0, len(order) - width + 1, width)]
    return np.array(out[:tables], np.int64).reshape(tables, width), words


def close_pairs(prints: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Places x < y of a bucket's nodes that connect what pairs connect that differ in few of the checked bits and whose sets' sizes allow the similarity."""
    out, label = [np.zeros((0, 2), np.int64)], np.arange(len(prints))
    first, second = np.ascontiguousarray(prints[:, 0]), np.ascontiguousarray(prints[:, 1])
    for at in range(0, len(prints), COMPARED):
        apart = np.bitwise_count(first[at : at + COMPARED, None] ^ first[at:])
        apart += np.bitwise_count(second[at : at + COMPARED, None] ^ second[at:])
        x, y = np.divmod(np.flatnonzero(apart <= MOST_APART[0]), len(prints) - at)
        x, y = x[y > x] + at, y[y > x] + at
        few = 100 * np.minimum(sizes[x], sizes[y]) >= percent * np.maximum(sizes[x], sizes[y])
        x, y = x[few], y[few]
        near_ = np.bitwise_count(prints[x] ^ prints[y]).sum(axis=1, dtype=np.int64) <= MOST_APART[1]
        x, y = x[near_], y[near_]
        if len(x) > 16 * COMPARED:  # of many pairs those that connect something new
            kept = []
            starts = np.flatnonzero(np.diff(x, prepend=-1))
            for low, high in zip(starts.tolist(), [*starts[1:].tolist(), len(x)]):
                met, which = np.unique(label[y[low:high]], return_index=True)
                new = met != label[x[low]]
                if new.any():
                    kept.append(low + which[new])
                    own = np.append(met, label[x[low]])
                    label[np.isin(label, own)] = own.min()
            kept = np.concatenate(kept) if kept else np.zeros(0, np.int64)
            x, y = x[kept], y[kept]
        out.append(np.stack([x, y], axis=1))
    return np.concatenate(out)


def likely(nodes: DataFrame, percent: int, bits: np.ndarray) -> DataFrame:
    """Pairs that connect what pairs of nodes (fp, n, sketch) connect that share a bucket of the tables' bits and differ in few bits."""
    tables, powers = np.arange(len(bits), dtype=np.int64) << 32, np.int64(1) << np.arange(bits.shape[1], dtype=np.int64)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch)):
            own = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(len(part), -1)
            groups = tables + np.unpackbits(own, axis=1, bitorder="little")[:, bits] @ powers
            rows = pa.array(np.repeat(np.arange(len(part)), len(bits)))
            checked = pa.array([x.tobytes() for x in own[:, : 8 * CHECKED]], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(groups.ravel()), part.column(0).take(rows), part.column(1).take(rows), checked.take(rows)], names=["group", "fp", "n", "bits"])

    def relate(table: pa.Table, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        prints = np.frombuffer(b"".join(table.column("bits").to_pylist()), "<u8").reshape(-1, CHECKED)
        sizes = table.column("n").to_numpy()
        pairs = [close_pairs(prints[a:b], sizes[a:b], percent) + a for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(prints)])]
        return np.arange(len(prints)), np.concatenate(pairs)

    members = map_arrow(nodes.select("fp", "n", "sketch"), keyed, "group long, fp long, n long, bits binary").withColumn("bytes", F.lit(64).cast("long"))
    return near.connect(members, lambda dealt: dealt, relate, BUCKET_BLOCKS * near.BLOCK_ROWS, ["n", "bits"])


def with_set(docs: DataFrame, width: int, words: int, keep: Iterable[str] = ("doc_id",)) -> DataFrame:
    """Struct ``row`` of the kept columns, fp: the digest of the text's set of shingles, n: its size, the text's bytes and the sketch, the set's wide SimHash, null for an empty set."""
    left = docs.select(F.struct(*columns(keep)).alias("row"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), ROWS):
                own = batch.slice(k, ROWS)
                texts = own.column(1).to_pylist()
                sets = [near.shingle_set(x, width) for x in texts]
                numbers = (list(map(set_digest, sets)), list(map(len, sets)), [len(utf8(x)) for x in texts])
                yield pa.RecordBatch.from_arrays([own.column(0), *(pa.array(x, pa.int64()) for x in numbers), pa.array([wide_fingerprint(x, words).tobytes() if len(x) else None for x in sets], pa.binary())], names=["row", "fp", "n", "bytes", "sketch"])

    return map_arrow(left, run, row_and(left, "fp long, n long, bytes long, sketch binary"))


# ---------------------------------------------------------------- components


def label(found: DataFrame, doc_id: Column, pairs: Callable[[DataFrame], DataFrame] = links, carry: Iterable[str] = ()) -> DataFrame:
    """fp, its component's least fingerprint root and least id component_id, for a table with column fp and what pairs reads; found is read twice, so keep it first."""
    distinct = cut(found.groupBy("fp").agg(F.min(doc_id).alias("least"), *(F.first(c).alias(c) for c in carry)))
    roots = components(pairs(distinct)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of each row."""
    found = cut(with_fingerprint(docs).select("row.doc_id", "fp"))
    joined = found.join(label(found, F.col("doc_id")).select("fp", "component_id"), "fp")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, similarity: float | None = None, width: int = STAGE_WORDS) -> DataFrame:
    """One document of each component: that with the least doc_id. Where ids are null or repeated, one of those that qualify.

    Linked are texts of at least the similarity by shingles of ``width`` words; without a similarity, by op7's rule."""
    if similarity is None:
        marked, pairs, more = with_fingerprint, links, []
    else:
        sets = partial(near.shingle_set, width=width)
        bits, words = table_bits(docs.count())
        marked, more = (lambda d, *keep: with_set(d, width, words, *keep)), ["n", "bytes", "sketch"]
        percent = round(100 * similarity)
        pairs = lambda distinct: near.similar(distinct.where("n > 0"), docs, sets, percent, partial(likely, percent=percent, bits=bits))
    found = cut(marked(docs).select("row.doc_id", "fp", *more))
    labels = label(found, F.col("doc_id"), pairs, more)
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    kept = cut(found.join(labels, "fp").where(first).groupBy("doc_id").agg(F.count("*").alias("times")))
    if kept.where("doc_id is null or times > 1").limit(1).count() == 0:
        return docs.join(kept.select("doc_id"), "doc_id", "left_semi").select(*columns(docs.columns))
    # an id doesn't tell a document: the rows themselves are told by their fingerprints
    rows = marked(docs, docs.columns).join(labels, "fp").where(F.col("row.doc_id").eqNullSafe(F.col("component_id")))
    return rows.dropDuplicates(["root"]).select("row.*")


QUERIES = {"op7_simhash_golay": op7_simhash_golay}
ORACLE_SQL: dict[str, str] = {}
