"""Near-duplicates by SetSketch registers.

A document's set are its distinct shingles of WORDS words, hashed to 64 bits: words are runs of other than ASCII white space in the
text with A-Z lower-cased; a text of fewer words is one shingle, a text without words has none. An element's hashes drive a Poisson
process of arrivals at the registers, RATE a unit of time at each: its next arrival's time and register come from its next hash. A
register keeps the earliest arrival t of all elements as floor(1 - log t) to base BASE, cut to 0 .. MOST: exponentially spaced
truncated minima. Arrivals later than what all registers have are not looked at, so an element of a large set costs about one hash.
Registers of a union are the larger of each two, the number of elements and what is common are estimated from them, and similar
sets have equal registers: with a chance just over their Jaccard similarity.

Candidates share a band of ROWS registers (of BANDS). Their similarity is estimated jointly from how many registers are larger,
equal and smaller, by its likelihood given the sets' sizes, and pairs far below the limit go. What is left is compared on whole
sets. How groups, blocks and components bound the work is told in ``near``.

A pair at similarity 0.8 shares no band with a chance of 0.00003 and is estimated below 0.6 with one of about 0.00000001; closer
pairs with less. A pair whose registers are no candidate is found all the same where others connect it.

Defined results: a null, empty or wordless text has an empty set, links with nothing and is its own component. component_id is the
least non-null doc_id reachable, null if there is none; kept is true where it equals doc_id, nulls being equal. Repeated rows keep
a row each. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import near
from .common import cut, load, map_arrow, slices, utf8

WORDS, PERCENT = 2, 80
BANDS, ROWS = 26, 5
REGISTERS = BANDS * ROWS
BASE, RATE, MOST = 1.01, 20.0, 4095
#: Values of the similarity that an estimate tries at once, twice.
GRID = 25
#: Elements whose arrivals are drawn at once, and arrivals of each.
AT_ONCE, ARRIVALS = 1 << 17, 64
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None) -> np.ndarray:
    return near.shingle_set(text, WORDS)


def sketch(sets: list[np.ndarray], registers: int = REGISTERS) -> np.ndarray:
    """A row of registers for each set."""
    sizes = [len(x) for x in sets]
    earliest = np.full(len(sets) * registers, np.inf)
    elements = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owners = np.repeat(np.arange(len(sets)), sizes)
    for low in range(0, len(elements), AT_ONCE):
        _arrive(earliest, elements[low : low + AT_ONCE], owners[low : low + AT_ONCE], registers)
    with np.errstate(divide="ignore"):
        found = np.floor(1 - np.log(earliest) / log(BASE))
    return np.clip(found, 0, MOST).astype(np.uint16).reshape(len(sets), registers)


def _arrive(earliest: np.ndarray, elements: np.ndarray, owners: np.ndarray, registers: int) -> None:
    times, drawn = np.zeros(len(elements)), 0
    while len(elements):
        many = max(1, min(ARRIVALS, AT_ONCE // len(elements))) if drawn else 1
        steps = np.arange(drawn + 1, drawn + 1 + many, dtype=np.uint64) * _STEP
        hashes = near.mixed(elements[:, None] + steps)
        waits = -np.log(((hashes >> np.uint64(32)).astype(np.float64) + 0.5) * 2.0**-32) / (RATE * registers)
        at = times[:, None] + np.cumsum(waits, axis=1)
        register = ((hashes & np.uint64(0xFFFFFFFF)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(earliest, (owners[:, None] * registers + register).ravel(), at.ravel())
        times, drawn = at[:, -1], drawn + many
        # an arrival after all of its set's registers' changes nothing, and one after BASE is cut to 0
        first, last = owners[0], owners[-1] + 1
        latest = np.minimum(earliest[first * registers : last * registers].reshape(-1, registers).max(axis=1), BASE)
        going = times < latest[owners - first]
        times, elements, owners = times[going], elements[going], owners[going]


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the sets' union."""
    return np.maximum(a, b)


def cardinality(registers: np.ndarray) -> np.ndarray:
    """Estimated number of elements of each row's set."""
    return registers.shape[-1] * (1 - 1 / BASE) / (RATE * log(BASE) * (BASE ** -registers.astype(np.float64)).sum(axis=-1))


def similarity(over: np.ndarray, under: np.ndarray, equal: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """The Jaccard similarity of greatest likelihood for so many registers of a that are larger than, smaller than and equal to those of b, given the sets' sizes."""
    u, v = size_a / (size_a + size_b), size_b / (size_a + size_b)

    def differs(x: np.ndarray) -> np.ndarray:
        """The chance that a register is larger, if this share of the union is in its set alone."""
        return -np.log1p(-np.maximum(x, 0) * (BASE - 1) / BASE) / log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        p, q, least = differs(u - v * j), differs(v - u * j), 1e-300
        return over * np.log(np.maximum(p, least)) + under * np.log(np.maximum(q, least)) + equal * np.log(np.maximum(1 - p - q, least))

    # the likelihood has one maximum: a row of values for each pair, and a closer row around the best
    u, v, over, under, equal = (x[:, None] for x in (u, v, over, under, equal))
    most = np.minimum(u, v) / np.maximum(u, v)
    at = np.linspace(0, 1, GRID) * most
    middle = np.take_along_axis(at, likelihood(at).argmax(axis=1)[:, None], axis=1)
    at = np.clip(middle + np.linspace(-1, 1, GRID) * most / (GRID - 1), 0, most)
    return np.take_along_axis(at, likelihood(at).argmax(axis=1)[:, None], axis=1)[:, 0]


def with_sketch(docs: DataFrame) -> DataFrame:
    """doc_id, fp (digest of the set), n (its size), bytes of the text and the sketch, null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch, 200)):
            texts = part.column(1).to_pylist()
            sets = [shingle_set(x) for x in texts]
            rows = [x.tobytes() if len(s) else None for x, s in zip(sketch(sets), sets)]
            columns = (list(map(near.set_digest, sets)), list(map(len, sets)), [len(utf8(x)) for x in texts])
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in columns), pa.array(rows, pa.binary())], names=["doc_id", "fp", "n", "bytes", "sketch"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, fp long, n long, bytes long, sketch binary")


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document."""
    found = cut(with_sketch(docs))
    distinct = cut(found.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.max("bytes").alias("bytes"), F.first("sketch").alias("sketch")))
    pairs = near.similar(distinct, docs, shingle_set, percent, lambda nodes: near.likely_by_bands(nodes, ROWS, percent, similarity))
    roots = near.components(pairs).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = distinct.select("fp", "least").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component"))
    labels = rooted.join(ids, "root").select("fp", "component")
    alone = F.col("n") == 0
    marked = found.select("doc_id", "fp", "n").join(labels, "fp", "left").withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("component")))
    return marked.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op11_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))


QUERIES = {"op11_setsketch": op11_setsketch}
ORACLE_SQL: dict[str, str] = {}
