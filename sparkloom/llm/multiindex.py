"""Approximate nearest neighbours by cosine: an inverted multi-index.

Vectors are scaled to length one and cut into two halves; each half has its own k-means codebook, fitted on a bounded sample.
A vector's cell is its pair of nearest centroids, so k centroids a half make k^2 cells. A search pops pairs of centroids off a
heap in order of summed squared distance until the cells hold ``wanted`` distinct vectors; these are reranked by the cosine
of the original vectors in double precision. k grows with the table.

``wanted`` is measured, not guessed: for a bounded sample of queries the true neighbours among all rows are found by brute
force, and how many vectors the walk passes before it reaches their cells. ``wanted`` is the number that reaches the share
``aim`` of them. On clustered vectors that is a small part of the table; vectors without structure need a large one.

Equal vectors are indexed once: what they return is decided by their least ids, so copies, however many, cost nothing.
Cells over ``BLOCK_ROWS`` are cut into blocks of about that size, so a crowded cell is searched by several tasks, in full.
Cells are dealt to shards in the order of their centroids along the direction in which these spread most, so that a walk's cells
lie in few shards. A shard's queries are searched ``PROBES`` at a time, each lot by a task of its own, and only vectors
of cells that some query of a round has opened are multiplied.

Defined results: vectors that are null, zero or hold null or non-finite components take no part. Vectors of several lengths are
searched length by length, as a cosine needs equal lengths. Rows without id take no part. Equal scores are ordered by
vec_id; of repeated rows of an id each is a candidate of its own to other ids, none to its own. A query id with several vectors has
a list for each of them, told apart by query_key, a digest of the vector. Fewer candidates than k: all.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import cut, load

K = 5
#: Distinct vectors that codebooks are fitted on, at most about.
SAMPLE_ROWS = 16_384
ROUNDS = 12
#: Mean distinct vectors a cell that the number of centroids aims at, and the most centroids a half. The cells' sizes go to
#: every search task: 512 * 512 numbers at most.
CELL_ROWS, MOST_CENTROIDS = 8, 512
#: Share of true neighbours that the measured ``wanted`` reaches, and the sampled queries it is measured on.
AIM, MEASURED = 0.96, 128
#: Vectors of a block of a cell, and of a task's group of blocks.
BLOCK_ROWS, SHARD_ROWS = 4096, 16_384
#: Queries of a task, and those whose products with a shard are held at once.
PROBES, QUERIES_AT_ONCE = 4096, 128
#: Shards with more than PROBES queries that may be broadcast, and the salts of queries that share a vector.
BROADCAST_SHARDS, SALTS = 100_000, 16

_log = logging.getLogger(__name__)


def centroids_for(n: int) -> int:
    return int(min(MOST_CENTROIDS, max(2, round((n / CELL_ROWS) ** 0.5))))


def _batches(columns: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def valid(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, key (a digest of the vector) and vector, for vectors that take part."""
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = rows.where(F.coalesce(sound, F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column(1).offsets.to_numpy()
            flat = batch.column(1).values.to_numpy(zero_copy_only=False) + 0.0  # no negative zeros
            keys = [hashlib.blake2b(flat[a:b].tobytes(), digest_size=16).digest() for a, b in zip(ends, ends[1:])]
            yield _batches({"vec_id": batch.column(0), "key": pa.array(keys, pa.binary()), "vector": batch.column(1)})

    return rows.mapInArrow(run, "vec_id long, key binary, vector array<double>")


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centroids by Lloyd's rounds; an empty cluster takes a point far from its own."""
    random = np.random.default_rng(seed)
    k = min(k, len(x))
    centers = x[random.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        distances = squared(x, centers)
        nearest = distances.argmin(axis=1)
        sums, counts = np.zeros_like(centers), np.bincount(nearest, minlength=k)
        np.add.at(sums, nearest, x)
        empty = np.flatnonzero(counts == 0)
        centers = sums / np.maximum(counts, 1)[:, None]
        if len(empty):
            centers[empty] = x[np.argsort(-distances[np.arange(len(x)), nearest], kind="stable")[: len(empty)]]
    return centers


def squared(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1)[None])


class Codebooks:
    """Centroids of both halves."""

    def __init__(self, sample: np.ndarray, k: int):
        x = unit(sample)
        self.half = x.shape[1] // 2
        self.first, self.second = kmeans(x[:, : self.half], k, 1) if self.half else np.zeros((1, 0)), kmeans(x[:, self.half :], k, 2)
        self.width = len(self.second)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = unit(x)
        return squared(x[:, : self.half], self.first), squared(x[:, self.half :], self.second)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.distances(x)
        return a.argmin(axis=1) * self.width + b.argmin(axis=1)


def traverse(a: np.ndarray, b: np.ndarray, sizes: dict[int, int], width: int, wanted: int) -> list[int]:
    """Cells that hold vectors, in order of a[i] + b[j], until they hold ``wanted``: the multi-sequence walk, whose heap has each row's next pair."""
    by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    a, b = a[by_a].tolist(), b[by_b].tolist()
    by_a, by_b = by_a.tolist(), by_b.tolist()
    heap, found, have = [(a[0] + b[0], 0, 0)], [], 0
    while heap and have < wanted:
        _, i, j = heapq.heappop(heap)
        cell = by_a[i] * width + by_b[j]
        if (n := sizes.get(cell)) is not None:
            found.append(cell)
            have += n
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return found


def walked(a: np.ndarray, b: np.ndarray, sizes: dict[int, int], width: int, targets: list[int]) -> list[int]:
    """Vectors in the cells that the walk opens up to each target cell."""
    at, have = {}, 0
    for cell in traverse(a, b, sizes, width, 1 << 62):
        have += sizes[cell]
        at[cell] = have
    return [at[t] for t in targets]


class Shards:
    """The shard of each block of a cell: blocks in the order of their centroids, as many to a shard as make about ``rows`` vectors.

    A block's number is its cell's, with the block's place in the cell above it."""

    def __init__(self, books: Codebooks, sizes: dict[int, int], blocks: dict[int, int], rows: int):
        first, second = (spread(c) for c in (books.first, books.second))
        order = sorted(sizes, key=lambda c: (first[c // books.width], second[c % books.width]))
        numbers, shards, held = [], [], 0
        for cell in order:
            n = blocks.get(cell, 1)
            for block in range(n):
                numbers.append(cell + (block << 40))
                shards.append(held // rows)
                held += -(-sizes[cell] // n)
        by = np.argsort(np.array(numbers, np.int64), kind="stable")
        self.numbers, self.shards = np.array(numbers, np.int64)[by], np.array(shards, np.int64)[by]

    def of(self, cells: np.ndarray) -> np.ndarray:
        return self.shards[np.searchsorted(self.numbers, cells)]


def spread(centers: np.ndarray) -> list[int]:
    """Each centroid's place along the direction in which they spread most."""
    x = centers - centers.mean(axis=0)
    along = x @ np.linalg.svd(x, full_matrices=False)[2][0] if x.size else np.zeros(len(x))
    return np.argsort(np.argsort(along, kind="stable"), kind="stable").tolist()


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of a vector with rows, each computed on its own in double precision; scaled first, so that no square leaves its range."""
    x, q = x / np.abs(x).max(axis=1, keepdims=True), q / np.abs(q).max()
    return np.einsum("ij,j->i", x, q) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("j,j->", q, q)))


def _distinct(ids: np.ndarray, n: int) -> int:
    """Length of the shortest beginning that holds n distinct ids, or of all."""
    first = np.sort(np.unique(ids, return_index=True)[1])
    return int(first[n - 1]) + 1 if len(first) >= n else len(ids)


def _rerank(shard: pa.Table, probes: pa.Table, k: int) -> pa.Table:
    """For each query of the shard the best (score, vec_id) there, of k + 1 distinct ids, k of an id: products of all rows first, exact scores of the best few."""
    schema = pa.schema([("key", pa.binary()), ("vec_id", pa.int64()), ("score", pa.float64())])
    if not len(shard) or not len(probes):
        return schema.empty_table()
    x = matrix(shard.column("vector").combine_chunks())
    ids = shard.column("ids").to_pylist()
    least = np.array([own[0] for own in ids])
    cells, cell_of = np.unique(shard.column("cell").to_numpy(), return_inverse=True)
    lists = [np.searchsorted(cells, x.values.to_numpy()) for x in probes.column("cells").combine_chunks()]
    near_by = sorted(range(len(lists)), key=lambda n: lists[n][0])  # queries of a round open much the same cells
    keys, out = probes.column("key").to_pylist(), []
    q = matrix(probes.column("vector").combine_chunks())
    for start in range(0, len(q), QUERIES_AT_ONCE):
        own = near_by[start : start + QUERIES_AT_ONCE]
        opened = np.zeros(len(cells), bool)
        opened[np.concatenate([lists[n] for n in own])] = True
        there = np.flatnonzero(opened[cell_of])
        products = unit(x[there]) @ unit(q[own]).T
        for column, n in enumerate(own):
            opened[:] = False
            opened[lists[n]] = True
            held = np.flatnonzero(opened[cell_of[there]])
            rows, near = there[held], products[held, column]
            if len(rows) > 4 * k + 16:  # what rounding could tell apart stays in
                top = np.argpartition(near, -(k + 1))[-(k + 1) :]
                if len(np.unique(least[rows[top]])) <= k:  # an id has several of them
                    top = np.argsort(-near, kind="stable")
                    top = top[: _distinct(least[rows[top]], k + 1)]
                rows = rows[near >= near[top].min() - 1e-9]
            scores = _scores(x[rows], q[n])
            best = np.lexsort((least[rows], -scores))
            best = best[: _distinct(least[rows[best]], k + 1)]
            times: dict[int, int] = {}
            for s, i in sorted((-scores[b], i) for b in best for i in ids[rows[b]]):
                if i not in times and len(times) > k:
                    break
                times[i] = times.get(i, 0) + 1
                if times[i] <= k:
                    out.append((keys[n], i, -s))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema) if out else schema.empty_table()


def measure(placed: DataFrame, queries: np.ndarray, books: Codebooks, sizes: dict[int, int], k: int, aim: float) -> int:
    """Vectors that a walk must open to reach the share ``aim`` of the queries' true neighbours among all rows."""
    width = k + 1

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = unit(queries)
        scores, cells = np.full((0, len(q)), 0.0), np.zeros((0, len(q)), np.int64)
        for batch in batches:
            if len(batch):
                own = unit(matrix(batch.column(0))) @ q.T
                scores = np.concatenate((scores, own))
                cells = np.concatenate((cells, np.repeat(batch.column(1).to_numpy()[:, None], len(q), axis=1)))
                best = np.argsort(-scores, axis=0, kind="stable")[:width]
                scores, cells = np.take_along_axis(scores, best, 0), np.take_along_axis(cells, best, 0)
        number = np.repeat(np.arange(len(q))[None], len(scores), axis=0)
        yield _batches({"q": pa.array(number.ravel()), "score": pa.array(scores.ravel()), "cell": pa.array(cells.ravel())})

    found = placed.select("vector", "base").mapInArrow(nearest, "q long, score double, cell long")
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cell"))).where(F.col("n") <= width)
    targets: dict[int, list[int]] = {}
    for row in best.where("n > 1").select("q", "cell").collect():  # the first is the query itself
        targets.setdefault(row["q"], []).append(row["cell"])
    a, b = books.distances(queries)
    needed = sorted(x for i, own in targets.items() for x in walked(a[i], b[i], sizes, books.width, own))
    return needed[min(len(needed) - 1, int(aim * len(needed)))] if needed else 1


def search(vectors: DataFrame, is_query: F.Column, k: int = K, aim: float = AIM) -> DataFrame:
    """query_id, rank, vec_id, score and query_key of the k nearest of the rows for which is_query, a condition on vec_id, holds."""
    rows = valid(vectors)
    out = None
    for size in sorted(r["d"] for r in rows.select(F.size("vector").alias("d")).distinct().collect()):
        found = _search(rows.where(F.size("vector") == size), is_query, k, aim)
        out = found if out is None else out.union(found)
    return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double, query_key string") if out is None else out


def _search(rows: DataFrame, is_query: F.Column, k: int, aim: float) -> DataFrame:
    # copies: each salt keeps its least distinct ids, then all salts' together; k rows of an id are all that a list can hold
    salted = Window.partitionBy("key", "salt").orderBy("vec_id")
    own_rows = rows.groupBy("key", "vec_id").agg(F.count("*").alias("times"), F.first("vector").alias("vector"))
    few = own_rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).withColumn("n", F.row_number().over(salted)).where(F.col("n") <= k + 1)
    least = F.slice(F.array_sort(F.collect_list(F.struct("vec_id", F.least("times", F.lit(k)).cast("int").alias("times")))), 1, k + 1)
    ids = few.groupBy("key").agg(least.alias("least"), F.first("vector").alias("vector"))
    ids = ids.select("key", F.flatten(F.transform("least", lambda x: F.array_repeat(x["vec_id"], x["times"]))).alias("ids"), "vector")
    asked = cut(rows.where(is_query).select("key", F.col("vec_id").alias("query_id")).distinct())
    index = cut(ids.join(asked.select("key").distinct().withColumn("asked", F.lit(True)), "key", "left"))
    n = index.count()
    sampled = index.where(F.pmod(F.xxhash64("key"), F.lit(1 << 24)) < int((1 << 24) * min(1.0, SAMPLE_ROWS / n)))
    sample = np.array([r["vector"] for r in sampled.select("key", "vector").sort("key").collect()] or [index.first()["vector"]])
    books = Codebooks(sample, centroids_for(n))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield _batches({"key": batch.column(0), "ids": batch.column(1), "vector": batch.column(2), "base": pa.array(books.cells(matrix(batch.column(2))), pa.int64())})

    assigned = cut(index.select("key", "ids", "vector").mapInArrow(assign, "key binary, ids array<bigint>, vector array<double>, base long"))
    sizes = {r["base"]: r["n"] for r in assigned.groupBy("base").agg(F.count("*").alias("n")).collect()}
    blocks = {cell: -(-size // BLOCK_ROWS) for cell, size in sizes.items() if size > BLOCK_ROWS}
    shards = Shards(books, sizes, blocks, SHARD_ROWS)
    # a query's own vectors, beyond one, are opened besides
    most = asked.groupBy("query_id").count().agg(F.max("count")).first()[0] or 1
    wanted = max(4 * k, measure(assigned, sample[:: max(1, -(-len(sample) // MEASURED))], books, sizes, k, aim)) + most - 1
    _log.info("a walk opens %d of %d distinct vectors", min(wanted, n), n)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                # a block of a crowded cell is a cell of its own: its number goes above the cell's
                base, keys = batch.column(3).to_pylist(), batch.column(0).to_pylist()
                cell = np.array([c + (int.from_bytes(key[:8], "little") % blocks.get(c, 1) << 40) for c, key in zip(base, keys)], np.int64)
                yield _batches({"shard": pa.array(shards.of(cell)), "cell": pa.array(cell), "ids": batch.column(1), "vector": batch.column(2)})

    placed = assigned.mapInArrow(place, "shard long, cell long, ids array<bigint>, vector array<double>")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and shard that has cells of its walk."""
        for batch in batches:
            if not len(batch):
                continue
            a, b = books.distances(matrix(batch.column(1)))
            for i in range(len(batch)):
                cells = np.array([c + (n << 40) for c in traverse(a[i], b[i], sizes, books.width, wanted) for n in range(blocks.get(c, 1))], np.int64)
                own = shards.of(cells)
                cells, own = cells[np.argsort(own, kind="stable")], np.sort(own)
                there, starts = np.unique(own, return_index=True)
                lists = pa.ListArray.from_arrays(pa.array([*starts, len(cells)], pa.int32()), pa.array(cells))
                same = [i] * len(there)
                yield _batches({"shard": pa.array(there), "key": batch.column(0).take(pa.array(same)), "vector": batch.column(1).take(pa.array(same)), "cells": lists})

    asking = index.where("asked").select("key", "vector").repartition(max(1, min(-(-n // 4096), 1000)), "key")
    dealt = cut(asking.mapInArrow(probe, "shard long, key binary, vector array<double>, cells array<bigint>"))
    # a shard that many queries open is searched by several tasks, each with a lot of them
    lots = cut(dealt.groupBy("shard").agg(F.ceil(F.count("*") / PROBES).alias("lots")).where("lots > 1"))
    lots = F.broadcast(lots) if lots.count() <= BROADCAST_SHARDS else lots
    lot_of = F.coalesce("lots", F.lit(1).cast("long"))
    placed = placed.join(lots, "shard", "left").withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), lot_of - 1))).drop("lots")
    dealt = dealt.join(lots, "shard", "left").withColumn("lot", F.pmod(F.xxhash64("key"), lot_of)).drop("lots")
    scored = placed.groupBy("shard", "lot").cogroup(dealt.groupBy("shard", "lot")).applyInArrow(lambda left, right: _rerank(left, right, k), "key binary, vec_id long, score double")
    by_id = scored.groupBy("key", "vec_id").agg(F.max("score").alias("score"), F.collect_list("score").alias("scores"))
    best = by_id.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1)
    each = F.transform("scores", lambda x: F.struct((-x).alias("less"), F.col("vec_id"), x.alias("score")))
    lists = best.groupBy("key").agg(F.flatten(F.collect_list(each)).alias("found"))
    # many queries may share a vector
    lists = lists.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    own = asked.withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(SALTS))).join(lists, ["key", "salt"])
    own = own.select("query_id", "key", F.slice(F.filter(F.array_sort("found"), lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    each = own.select("query_id", "key", F.posexplode("found").alias("rank", "x"))
    return each.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "x.vec_id", "x.score", F.lower(F.hex("key")).alias("query_key"))


def op2_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES = {"op2_inverted_multi_index": op2_inverted_multi_index}
ORACLE_SQL: dict[str, str] = {}
