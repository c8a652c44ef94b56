"""What near-duplicate operators share: candidates from sketches, verification on whole sets, components.

A node is a distinct set of hashed shingles, named by a digest ``fp``; copies of a text are one node. SimHash finds its candidates
itself (``simhash``). SetSketch's are found here: a node's sketch is a row of registers of 16 bits, cut into bands of ROWS; nodes with a band in common form a group. Keys are dealt and sorted once: a task
streams through them, forgets keys of one node, names the group of a key with few nodes by a hash of its members (so a group of
near copies, which shares most of its keys, counts once) and hands members of a crowded key on as they come.

Within groups sketches are compared, and pairs that their registers make likely connect candidates. Candidates' components are the
groups in which whole sets are compared, so a text goes there once, whatever number of keys it shares. In both comparisons a group
is cut into blocks, bounded by members and by bytes. A block only gives a spanning forest of its related pairs. PIVOTS members of
a crowded group stand in each of its blocks: what is connected to the same pivot needs no comparison across blocks, so only
members that aren't connected to the pivot of most meet all blocks. A group of near copies thus costs in proportion to its size;
no link is lost. A group that holds many large groups which are not related still costs their products.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, map_arrow, slices, utf8

#: Bytes of a text whose words are hashed at once.
HASHED_BYTES = 1 << 20
#: Rows of groups that are taken at once.
GROUP_ROWS = 1024
#: Members and bytes of a block, and members of a crowded group that stand in each of its blocks.
BLOCK_ROWS, BLOCK_BYTES, PIVOTS = 256, 1 << 24, 8
#: Share of registers' evidence below which a pair is no candidate for a similarity of 0.8: over five standard errors less.
LEAST_ESTIMATE = 0.6
#: Shingles compared at once, set members counted at once, and ids that may be broadcast.
COLUMNS, AT_ONCE, BROADCAST_IDS = 8192, 1 << 17, 200_000
#: A key is hot if more than this share of a SAMPLED-th of the nodes' keys, and HOT_ROWS of them, are that key: so there are at most 10,000 hot keys.
HOT_SHARE, HOT_ROWS, SAMPLED = 1e-4, 32, 64
#: Pairs whose similarity is estimated at once.
ESTIMATED = 4096
#: Nodes that a task of components keeps at once.
FOREST_NODES = 1 << 20
SEED = 42


_STEP, _MIX_A, _MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


#: A word's hash is the sum of its bytes' numbers times the powers of a base from its first byte on, modulo 2^64: differences of running sums give those of all words at once.
_NUMBERS = np.random.default_rng(SEED).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x5851F42D4C957F2D
_WHITE_BYTES = re.compile(rb"[\x20\x09-\x0d]")
_WHITE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for as many bytes as are hashed at once."""
    return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(HASHED_BYTES, x, np.uint64))]) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


def word_hashes(data: bytes) -> np.ndarray:
    """The 64-bit hash of each run of other than ASCII white space."""
    import xxhash

    out, at = [], 0
    while at < len(data):
        own = np.frombuffer(data, np.uint8, min(len(data) - at, HASHED_BYTES), at)
        word = ~_WHITE[own]
        if len(own) == HASHED_BYTES:  # up to the last white space
            white = np.flatnonzero(~word)
            if not len(white):
                whole = _WHITE_BYTES.split(data[at:], 1)[0]  # a word that is longer than that
                out.append(np.array([xxhash.xxh64_intdigest(whole, SEED)], np.uint64))
                at += len(whole)
                continue
            own = own[: white[-1] + 1]
            word = word[: len(own)]
        at += len(own)
        edges = np.flatnonzero(np.diff(word, prepend=False, append=False)).reshape(-1, 2)
        powers, inverses = _powers()
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_NUMBERS[own] * powers[: len(own)])])
        out.append(mixed((sums[edges[:, 1]] - sums[edges[:, 0]]) * inverses[edges[:, 0]]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles of so many words, A-Z lower-cased; a shorter text is one shingle, a wordless one has none."""
    hashes = word_hashes(utf8(text).lower())  # bytes: only A-Z
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    total = hashes[: len(hashes) - width + 1].copy()
    for k in range(1, width):  # a shingle's words are told apart by their places
        total = mixed(total + _STEP) + hashes[k : len(hashes) - width + 1 + k]
    return distinct(mixed(total + np.uint64(width)))


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted values without repetition."""
    values = np.sort(values)
    return values[np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))] if len(values) else values


def set_digest(own: np.ndarray) -> int:
    """Names a set of shingles, as a signed long."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64))


# ---------------------------------------------------------------- groups


def by_group(rows: DataFrame, keys: list[str], order: list[str], function: Callable[[pa.Table, np.ndarray], list[tuple]], schema: pa.Schema, ddl: str) -> DataFrame:
    """Applies the function to groups' rows and where groups begin in them. A task streams through its groups and takes some at once, so that a group of few rows costs little."""
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        starts: list[int] = []
        at, rows_held, bytes_held = None, 0, 0

        def result() -> Iterator[pa.RecordBatch]:
            out = function(pa.Table.from_batches(held), np.array(starts, np.int64))
            held.clear(), starts.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        for batch in batches:
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(width)]
            new = np.zeros(len(batch), bool)
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            cuts = [0, *np.flatnonzero(new).tolist(), len(batch)]
            for first, last in zip(cuts, cuts[1:]):
                if first == last:
                    continue
                key = tuple(c[first] for c in columns)
                if key != at:
                    if rows_held >= GROUP_ROWS or bytes_held >= BLOCK_BYTES:
                        yield from result()
                        rows_held = bytes_held = 0
                    starts.append(rows_held)
                at = key
                held.append(part := batch.slice(first, last - first))
                rows_held, bytes_held = rows_held + len(part), bytes_held + part.nbytes
        if held:
            yield from result()

    return map_arrow(rows.repartition(_partitions(rows), *keys).sortWithinPartitions(*keys, *order), run, ddl)


def _partitions(df: DataFrame) -> int:
    """As many as the session says: what groups cost is not told by their bytes, by which they would be put together."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def band_keys(sketches: np.ndarray, rows: int) -> np.ndarray:
    """A key for each band of each sketch, as signed longs."""
    import xxhash

    bands = sketches.shape[1] // rows
    out = np.empty((len(sketches), bands), np.uint64)
    for k, sketch in enumerate(sketches):
        data = sketch.tobytes()
        out[k] = [xxhash.xxh64_intdigest(data[2 * rows * n : 2 * rows * (n + 1)], n) for n in range(bands)]
    return out.view(np.int64)


def matrix(sketches: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Sketches of one length as rows of registers."""
    own = sketches.to_pylist()
    return np.frombuffer(b"".join(own), np.uint16).reshape(len(own), -1)


def key_groups(distinct: DataFrame, rows: int) -> DataFrame:
    """(group, fp) of the nodes that share a key; distinct has fp and sketch."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch)):
            keys = band_keys(matrix(part.column("sketch")), rows)
            fps = part.column("fp").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(fps, keys.shape[1]))], names=["key", "fp"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, crowded = np.zeros(0, np.int64), None, False
        for batch in batches:
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            out: list[tuple[int, np.ndarray]] = []
            # keys of one node inside the batch need no look; the first and last key may go on in other batches
            starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            sizes = np.diff(starts)
            for n in np.flatnonzero((sizes > 1) | (np.arange(len(sizes)) == 0) | (np.arange(len(sizes)) == len(sizes) - 1)).tolist():
                first, last = int(starts[n]), int(starts[n + 1])
                if first == last:
                    continue
                key, own = int(keys[first]), fps[first:last]
                if key != at:
                    _close(out, at, held, crowded)
                    held, at, crowded = np.zeros(0, np.int64), key, False
                held = np.concatenate([held, own])
                if len(held) > BLOCK_ROWS:
                    out.append((key, held))
                    held, crowded = np.zeros(0, np.int64), True
            if out:
                yield _members(out)
        out = []
        _close(out, at, held, crowded)
        if out:
            yield _members(out)

    def keys_of(nodes: DataFrame) -> DataFrame:
        return map_arrow(nodes.select("fp", "sketch"), keyed, "key long, fp long")

    # a hot key's nodes are members as they are; which keys are hot has no effect on what is linked
    tried = cut(keys_of(distinct.where(F.pmod(F.xxhash64("fp", F.lit(3)), F.lit(SAMPLED)) == 0)).groupBy("key").agg(F.count("*").alias("n")))
    hot = cut(tried.where(F.col("n") > max(HOT_ROWS, HOT_SHARE * (tried.agg(F.sum("n")).first()[0] or 0))).select("key"))
    own = keys_of(distinct)
    if not hot.limit(1).count():
        return map_arrow(own.repartition(_partitions(distinct), "key").sortWithinPartitions("key"), shared, "group long, fp long").distinct()
    marked = own.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "key", "left")
    others = map_arrow(marked.where("hot is null").select("key", "fp").repartition(_partitions(distinct), "key").sortWithinPartitions("key"), shared, "group long, fp long").distinct()
    return others.union(marked.where("hot").select(F.col("key").alias("group"), "fp"))


def _close(out: list[tuple[int, np.ndarray]], key: int | None, held: np.ndarray, crowded: bool) -> None:
    """The rest of a crowded key's members, or a small group under its members' name."""
    if crowded and len(held):
        out.append((key, held))
    elif len(held) > 1:
        members = np.unique(held)
        out.append((set_digest(members), members))


def _members(groups: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([k for k, _ in groups], np.int64), [len(x) for _, x in groups])), pa.array(np.concatenate([x for _, x in groups]))], names=["group", "fp"])


# ---------------------------------------------------------------- blocks

LINKS = pa.schema([(c, pa.int64()) for c in ("group", "a", "b", "at")])


def spanning(n: int, pairs: np.ndarray) -> tuple[list[tuple[int, int]], list[int]]:
    """A spanning forest of the pairs, and each of n nodes' least node in it."""
    parent, found = list(range(n)), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in pairs.tolist():
        a, b = root(x), root(y)
        if a != b:
            parent[max(a, b)] = min(a, b)
            found.append((x, y))
    return found, [root(x) for x in range(n)]


def connect(members: DataFrame, load: Callable[[DataFrame], DataFrame], relate: Callable[[pa.Table, np.ndarray], tuple[np.ndarray, np.ndarray]], block_rows: int = 0, carry: Sequence[str] = ()) -> DataFrame:
    """Pairs (a, b) that connect what related pairs of each group connect.

    members: group, fp, bytes and what is carried with them; kept, or cheap to tell again. load adds to a table with fp what else relate reads.
    relate gives, for a table and where its blocks begin, the rows that count, in order, and related pairs of them within blocks, by place in
    that list, which connect what all such pairs connect."""
    blocks = lambda rows, size: F.greatest(F.ceil(rows / (block_rows or BLOCK_ROWS)), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("long")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    one, none = F.lit(1).cast("long"), F.lit(PIVOTS).cast("long")

    def compare(table: pa.Table, starts: np.ndarray) -> list[tuple]:
        """Links of blocks, and of crowded groups' members the first pivot that each is connected to here (-1: none), with b null."""
        rows, pairs = relate(table, starts)
        columns = [table.column(c).to_numpy()[rows].tolist() for c in ("group", "fp", "pivot", "blocks")]
        groups, fps, pivots, many = columns
        found, roots = spanning(len(rows), pairs)
        out = [(groups[x], *sorted((fps[x], fps[y])), None) for x, y in found]
        for group, fp, p, n, r in zip(groups, fps, pivots, many, roots):
            if n > 1 and p == PIVOTS:  # pivots come first, so they are the roots of what they are connected to
                out.append((group, fp, None, pivots[r] if pivots[r] < PIVOTS else -1))
        return out

    def compared(dealt: DataFrame, *keys: str) -> DataFrame:
        loaded = load(dealt)
        return by_group(loaded.select(*keys, *(c for c in loaded.columns if c not in keys)), list(keys), ["pivot", "fp"], compare, LINKS, "group long, a long, b long, at long")

    crowded = cut(members.groupBy("group").agg(F.count("*").alias("n"), F.sum("bytes").alias("size")).select("group", blocks(F.col("n"), F.col("size")).alias("blocks")).where("blocks > 1"))
    if not crowded.limit(1).count():
        return compared(members.select("group", F.lit(0).cast("long").alias("block"), "fp", none.alias("pivot"), one.alias("blocks"), *carry), "group", "block").select("a", "b").distinct()
    placed = members.join(crowded, "group", "left").withColumn("blocks", F.coalesce("blocks", one))
    own_block = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    slot = F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(PIVOTS)).cast("long")
    pivots = cut(placed.where("blocks > 1").groupBy("group", slot.alias("pivot")).agg(*(F.min_by(c, "fp").alias(c) for c in ("fp", "blocks", *carry))))
    plain = placed.join(pivots.select("group", "fp"), ["group", "fp"], "left_anti").select("group", own_block.alias("block"), "fp", none.alias("pivot"), "blocks", *carry)
    dealt = plain.union(pivots.select("group", F.explode(upto(F.col("blocks"))).alias("block"), "fp", "pivot", "blocks", *carry))
    first = cut(compared(dealt, "group", "block"))
    found = first.where("b is not null").select("a", "b").distinct()
    # what isn't connected to the pivot that most of the group are connected to meets all of the group
    told = first.where("b is null").select("group", F.col("a").alias("fp"), "at")
    most = told.where("at >= 0").groupBy("group", "at").agg(F.count("*").alias("c")).groupBy("group").agg(F.max_by("at", F.struct("c", "at")).alias("main"))
    loose = told.join(most, "group", "left").where(~F.col("at").eqNullSafe(F.col("main"))).select("group", "fp")
    loose = cut(loose.union(pivots.join(most, "group", "left").where(~F.col("pivot").eqNullSafe(F.col("main"))).select("group", "fp")).distinct())
    if not loose.limit(1).count():
        return found
    rests = loose.join(placed, ["group", "fp"]).groupBy("group").agg(blocks(F.count("*"), F.sum("bytes")).alias("rests"))
    in_rests = placed.join(rests, "group").join(loose.withColumn("is_loose", F.lit(True)), ["group", "fp"], "left").withColumn("block", own_block)
    a_rest = F.pmod(F.xxhash64("fp", F.lit(2)), F.col("rests"))
    meets = in_rests.where("is_loose").select("group", a_rest.alias("rest"), F.explode(upto(F.col("blocks"))).alias("block"), "fp", *carry)
    every = in_rests.select("group", F.explode(upto(F.col("rests"))).alias("rest"), "block", "fp", *carry)
    again = compared(meets.union(every).distinct().select("*", none.alias("pivot"), one.alias("blocks")), "group", "rest", "block")
    return found.union(again.select("a", "b")).distinct()


# ---------------------------------------------------------------- similarity


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two sorted sets share, counted for about AT_ONCE members at once: those of a range of hashes."""
    total = sum(map(len, sets))
    ranges = max(1, -(-total // AT_ONCE))
    edges = np.array([(k << 64) // ranges for k in range(1, ranges)], np.uint64)
    cuts = [[0, *np.searchsorted(x, edges), len(x)] for x in sets]
    out = np.zeros((len(sets), len(sets)), np.int64)
    for k in range(ranges):
        out += _shared([x[c[k] : c[k + 1]] for x, c in zip(sets, cuts)])
    return out


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """The same for few members, of which COLUMNS are compared at once."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    shared = times[at] > 1
    owner, column = owner[shared], number[at[shared]]
    by = np.argsort(column, kind="stable")
    owner, column = owner[by], column[by]
    out = np.zeros((len(sets), len(sets)), np.int64)
    most = int(number[-1]) + 1 if len(number) else 0
    for low in range(0, most, COLUMNS):
        first, last = np.searchsorted(column, (low, low + COLUMNS))
        held = np.zeros((len(sets), min(COLUMNS, most - low)), np.float32)
        held[owner[first:last], column[first:last] - low] = 1
        out += np.rint(held @ held.T).astype(np.int64)
    return out


def similar_pairs(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Places x < y of the sets whose intersection is at least so many hundredths of their union."""
    if len(sets) < 2:
        return np.zeros((0, 2), np.int64)
    sizes = np.array([len(x) for x in sets])
    if len(sets) == 2:
        both = np.array([[sizes[0], 0], [0, sizes[1]]])
        both[0, 1] = both[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
    else:
        both = intersections(sets)
    return np.argwhere(np.triu(100 * both >= percent * (sizes[:, None] + sizes - both), 1))


def places(starts: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Pairs x < y of the rows of each group, some at a time; groups begin at starts."""
    held, n = [], 0
    for first, last in zip(starts.tolist(), [*starts[1:].tolist(), size]):
        own = _triangle(last - first) + first
        held.append(own)
        n += len(own)
        if n >= ESTIMATED:
            yield np.concatenate(held)
            held, n = [], 0
    if n:
        yield np.concatenate(held)


@lru_cache(maxsize=32)
def _small_triangle(n: int) -> np.ndarray:
    return np.stack(np.triu_indices(n, 1), axis=1)


def _triangle(n: int) -> np.ndarray:
    return _small_triangle(n) if n < 32 else np.stack(np.triu_indices(n, 1), axis=1)


def likely_pairs(sketches: np.ndarray, sizes: np.ndarray, percent: int, estimate: Callable, starts: np.ndarray | None = None) -> np.ndarray:
    """Places x < y of the sketches of a group whose registers make a similarity of so many hundredths likely; sizes are the sets'."""
    out = [np.zeros((0, 2), np.int64)]
    for pairs in places(np.zeros(1, np.int64) if starts is None else starts, len(sketches)):
        for own in np.array_split(pairs, -(-len(pairs) // ESTIMATED)):
            n = sizes[own]
            own = own[100 * n.min(axis=1) >= percent * n.max(axis=1)]
            a, b = sketches[own[:, 0]], sketches[own[:, 1]]
            equal = (a == b).sum(axis=1)
            likely = equal >= sketches.shape[1] * LEAST_ESTIMATE  # no estimate is above this share
            if likely.any():
                own, equal, over = own[likely], equal[likely], (a[likely] > b[likely]).sum(axis=1)
                found = estimate(over, sketches.shape[1] - equal - over, equal, sizes[own[:, 0]], sizes[own[:, 1]])
                out.append(own[found >= LEAST_ESTIMATE])
    return np.concatenate(out)


def shares_equal(over: np.ndarray, under: np.ndarray, equal: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """The estimate of registers that are equal with the similarity as chance."""
    return equal / (over + under + equal)


def likely_by_bands(nodes: DataFrame, rows: int, percent: int, estimate: Callable = shares_equal) -> DataFrame:
    """Pairs that connect what pairs of nodes (fp, n, sketch) connect that share a band and whose registers make the similarity likely."""

    def by_sketch(table: pa.Table, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.arange(table.num_rows), likely_pairs(matrix(table.column("sketch")), table.column("n").to_numpy(), percent, estimate, starts)

    members = cut(key_groups(nodes, rows))
    return connect(members.withColumn("bytes", F.lit(1).cast("long")), lambda dealt: dealt.join(nodes, "fp"), by_sketch)


def similar(distinct: DataFrame, docs: DataFrame, shingles: Callable[[str | None], np.ndarray], percent: int, likely: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs a < b that connect what pairs of at least the similarity connect.

    distinct has, for each node with shingles, fp, its set's size n, its text's bytes, its sketch and an id ``least`` of a document that has it.
    docs has doc_id and text, shingles gives a text's sorted set, likely the pairs of nodes (fp, n, sketch) to look at."""
    docs = docs.select("doc_id", "text")

    def by_text(table: pa.Table, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kept, pairs, fps, texts = [], [np.zeros((0, 2), np.int64)], table.column("fp").to_pylist(), table.column("text")
        for first, last in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows]):
            sets, seen, base = [], set(), len(kept)
            for k in range(first, last):
                if fps[k] not in seen and set_digest(own := shingles(texts[k].as_py())) == fps[k]:  # a repeated id may have other texts
                    seen.add(fps[k]), kept.append(k), sets.append(own)
            pairs.append(similar_pairs(sets, percent) + base)
        return np.array(kept, np.int64), np.concatenate(pairs)

    grouped = components(likely(distinct.select("fp", "n", "sketch")))
    both = grouped.select(F.col("u").alias("fp"), F.col("v").alias("group")).union(grouped.select("v", "v").distinct())
    wanted = cut(both.join(distinct.select("fp", "bytes", "least"), "fp"))
    ids, n = wanted.select("fp", "least"), wanted.count()
    few = n <= BROADCAST_IDS
    of_ids = docs.join(F.broadcast(ids.select("least").distinct()) if few else ids.select("least").distinct(), F.col("doc_id").eqNullSafe(F.col("least")), "left_semi")
    each_by_id = ids.agg(F.count_distinct(F.coalesce(F.col("least").cast("string"), F.lit("")))).first()[0] == n == of_ids.select("doc_id").count()

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch)):
            yield pa.RecordBatch.from_arrays([pa.array([set_digest(shingles(x)) for x in part.column(0).to_pylist()], pa.int64()), part.column(0)], names=["fp", "text"])

    def with_text(dealt: DataFrame) -> DataFrame:
        if not each_by_id:  # a node's text is one of those that have its digest
            return dealt.join(map_arrow(of_ids.select("text"), digested, "fp long, text string").dropDuplicates(["fp"]), "fp")
        told = dealt.join(ids, "fp")
        return docs.join(F.broadcast(told) if few and told.count() <= BROADCAST_IDS else told, F.col("doc_id").eqNullSafe(F.col("least"))).drop("doc_id", "least")

    return connect(wanted.select("group", "fp", "bytes"), with_text, by_text)


# ---------------------------------------------------------------- components


def _forest(pairs: DataFrame) -> DataFrame:
    """(u, v) with v < u: links replaced by the stars of components, of FOREST_NODES nodes of a partition at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = parent[x]
            return x

        def stars() -> Iterator[pa.RecordBatch]:
            found = [y for y in ((x, root(x)) for x in parent) if y[0] != y[1]]
            for k in range(0, len(found), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found[k : k + 50_000]], pa.int64()) for j in (0, 1)], names=["u", "v"])
            parent.clear()

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
            if len(parent) > FOREST_NODES:
                yield from stars()
        yield from stars()

    return pairs.mapInArrow(run, "u long, v long")


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    others = e.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(pairs: DataFrame, at_most: int = 60) -> DataFrame:
    """(u, v): v is the least node that u reaches, for each u that reaches a lesser one; pairs has columns a and b."""
    e, before = cut(_forest(pairs)), None
    for _ in range(at_most):
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return e
        before = state
        e = cut(_small_star(_large_star(e)))
    raise RuntimeError("components did not settle")
