"""Property-graph operators over edge tables (src, dst, kind, tier, confidence, source) and symbol tables."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .lineage import Rounds, cut

#: Levels after which a walk's state is written: each level is read by the next one and by what has been seen, so unwritten plans would multiply.
WRITTEN_LEVELS = 2
MOST_DEPTH = 100


#: Neighbours of a block: a hub's are given in several rows.
BLOCK_NEIGHBORS = 10_000


def neighbors(edges: DataFrame, down: bool = True, block_size: int = BLOCK_NEIGHBORS) -> DataFrame:
    """G1: (id, block, neighbors): each node's distinct callees (down) or callers, sorted within a block; a node with more than about block_size has several."""
    own, other = ("src", "dst") if down else ("dst", "src")
    pairs = edges.select(F.col(own).alias("id"), F.col(other).alias("other")).distinct()
    # few neighbours are one block; only hubs are counted first
    hubs = pairs.groupBy("id").agg(F.ceil(F.count("*") / block_size).alias("blocks")).where("blocks > 1")
    dealt = pairs.join(hubs, "id", "left").withColumn("block", F.pmod(F.xxhash64("other"), F.coalesce("blocks", F.lit(1).cast("long"))))
    return dealt.groupBy("id", "block").agg(F.sort_array(F.collect_list("other")).alias("neighbors"))


#: Uris that may be broadcast.
BROADCAST_URIS = 100_000


def resolve_uri(symbols: DataFrame, uris: Sequence[str]) -> DataFrame:
    """(uri, id): the symbol with that id, else the least one whose id ends in ``::`` and the uri. Ids are joined by what stands after each of their ``::``."""
    wanted = symbols.sparkSession.createDataFrame([(u,) for u in set(uris)], "uri string")
    wanted = F.broadcast(wanted) if len(uris) <= BROADCAST_URIS else wanted
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length("id"), F.lit(1))), lambda k: F.substring("id", k, 2) == "::")
    tails = F.transform(places, lambda k: F.struct(F.substring("id", k + 2, F.length("id")).alias("uri"), F.lit(True).alias("other")))
    whole = F.array(F.struct(F.col("id").alias("uri"), F.lit(False).alias("other")))
    found = symbols.select("id", F.explode(F.concat(whole, tails)).alias("x")).select("id", "x.uri", "x.other").join(wanted, "uri")
    return found.groupBy("uri").agg(F.min(F.struct("other", "id")).alias("best")).select("uri", "best.id")


def bfs_levels(edges: DataFrame, starts: DataFrame, depth: int, down: bool = True) -> DataFrame:
    """(id, level) of what the starts (column id) reach in 1 to depth steps, at the least level; starts have level 0."""
    if not 0 <= depth <= MOST_DEPTH:
        raise ValueError(f"depth must be 0 to {MOST_DEPTH}")
    own, other = ("src", "dst") if down else ("dst", "src")
    steps = edges.select(F.col(own).alias("from_id"), F.col(other).alias("id")).where("from_id <> id").distinct()
    seen = frontier = starts.select("id").distinct().withColumn("level", F.lit(0))
    for level in range(1, depth + 1):
        reached = frontier.select(F.col("id").alias("from_id")).join(steps, "from_id").select("id").distinct()
        frontier = reached.join(seen.select("id"), "id", "left_anti").withColumn("level", F.lit(level))
        if level % WRITTEN_LEVELS == 0 and level < depth:
            frontier = cut(frontier)
            if frontier.isEmpty():
                break
            seen = cut(seen.union(frontier))
        else:
            seen = seen.union(frontier)
    return seen


def closure_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct (src, dst) whose ends are both among nodes (column id)."""
    return typed_closure_edges(edges, nodes).select("src", "dst").distinct()


def typed_closure_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edge rows whose ends are both among nodes, with default metadata where it is missing."""
    ids = nodes.select("id").distinct()
    inside = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return with_default_metadata(inside).select("src", "dst", "kind", "tier", "confidence", "source")


def with_default_metadata(edges: DataFrame) -> DataFrame:
    """CS5: calls are semantic at .70, all else structural at .90, where an edge says nothing."""
    calls = F.col("kind") == "calls"
    return edges.withColumns({"tier": F.coalesce("tier", F.when(calls, F.lit("semantic")).otherwise("structural")), "confidence": F.coalesce("confidence", F.when(calls, F.lit(0.7)).otherwise(0.9))})


def filter_edges(edges: DataFrame, min_confidence: float = 0.0, tiers: Sequence[str] = (), sources: Sequence[str] = ()) -> DataFrame:
    """PF3: edges of at least a confidence, of the tiers and sources named; a null source counts as ``unknown``."""
    keep = F.col("confidence") >= min_confidence
    if tiers:
        keep &= F.col("tier").isin(*tiers)
    if sources:
        keep &= F.coalesce("source", F.lit("unknown")).isin(*sources)
    return edges.where(keep)


def cross_language(edges: DataFrame) -> DataFrame:
    """PF4."""
    return edges.where(F.col("kind").startswith("ffi_") | F.col("kind").isin("bridge", "universal_link"))


def edge_summary(edges: DataFrame) -> DataFrame:
    """AG1: (dimension, value, n) over kind, tier and source in one pass."""
    rows = edges.select("kind", "tier", F.coalesce("source", F.lit("unknown")).alias("source"))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in ("kind", "tier", "source")))).alias("x")
    return rows.select(each).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))


def nodes_with_metadata(ids: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each id with its symbol's columns, null where there is none."""
    return ids.select("id").distinct().join(symbols, "id", "left")


def graph_query(edges: DataFrame, symbols: DataFrame, starts: DataFrame, up: int = 1, down: int = 1, min_confidence: float = 0.0, tiers: Sequence[str] = (), sources: Sequence[str] = (), filter_traversal: bool = False) -> dict[str, DataFrame]:
    """Levels both ways, nodes with metadata, edges between them and their summary. The filters hold for the edges returned, and for the walk only with filter_traversal."""
    if filter_traversal:
        edges = filter_edges(with_default_metadata(edges), min_confidence, tiers, sources)
    below, above = bfs_levels(edges, starts, down), bfs_levels(edges, starts, up, down=False)
    levels = below.withColumn("direction", F.lit("down")).union(above.where("level > 0").withColumn("direction", F.lit("up")))
    found = filter_edges(typed_closure_edges(edges, levels), min_confidence, tiers, sources)
    return {"levels": levels, "nodes": nodes_with_metadata(levels, symbols), "edges": found, "summary": edge_summary(found)}


def insert_edges(edges: DataFrame) -> DataFrame:
    """No self loops; of rows with equal (src, dst, kind) the last by seq stays."""
    last = Window.partitionBy("src", "dst", "kind").orderBy(F.desc("seq"))
    return edges.where("src <> dst").withColumn("nth", F.row_number().over(last)).where("nth = 1").drop("nth")


def strongest_edges(edges: DataFrame) -> DataFrame:
    """Of rows with equal (src, dst, kind) one, the most confident, whose metadata goes together; no self loops."""
    best = F.max_by(F.struct("tier", "confidence", "source", "evidence"), F.struct("confidence", "tier", "source")).alias("x")
    return edges.where("src <> dst").groupBy("src", "dst", "kind").agg(best).select("src", "dst", "kind", "x.*")


def mark_faults(symbols: DataFrame, faults: DataFrame) -> DataFrame:
    """Symbols with fault_id from faults (id, fault_id); null is clean."""
    return symbols.drop("fault_id").join(faults.select("id", "fault_id"), "id", "left").withColumn("is_poisoned", F.col("fault_id").isNotNull())


def reach(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """AG3: direct callers and callees of each start, and what it reaches both ways within depth."""
    out = starts.select("id").distinct()
    for name, own, other in (("callee_count", "src", "dst"), ("caller_count", "dst", "src")):
        counts = edges.where("src <> dst").groupBy(F.col(own).alias("id")).agg(F.count_distinct(other).alias(name))
        out = out.join(counts, "id", "left")
    for name, own, other in (("down_reach", "src", "dst"), ("up_reach", "dst", "src")):
        steps = edges.select(F.col(own).alias("at"), F.col(other).alias("to")).distinct()
        seen = frontier = starts.select(F.col("id").alias("root"), F.col("id").alias("at")).distinct()
        for level in range(1, depth + 1):
            frontier = frontier.join(steps, "at").select("root", F.col("to").alias("at")).distinct().join(seen, ["root", "at"], "left_anti")
            if level % WRITTEN_LEVELS == 0 and level < depth:
                frontier = cut(frontier)
                seen = cut(seen.union(frontier))
            else:
                seen = seen.union(frontier)
        counts = seen.where("root <> at").groupBy(F.col("root").alias("id")).agg(F.count("*").alias(name))
        out = out.join(counts, "id", "left")
    return out.fillna(0, ["callee_count", "caller_count", "down_reach", "up_reach"])


#: Longs of a row of reach_all: 64 nodes each.
REACH_LONGS = 8


def numbered(rows: DataFrame, *order: Column, name: str = "number") -> DataFrame:
    """Column ``number``: the place from 0 in an order over the whole table. Each task sorts a range of rows; only the numbers of rows of the ranges are gathered."""
    placed = cut(rows.orderBy(*order)).withColumn("place", F.monotonically_increasing_id())
    sizes = placed.groupBy(F.shiftright("place", 33).alias("part")).agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each task of the sort
    inside = F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    joined = placed.withColumn("part", F.shiftright("place", 33)).join(F.broadcast(before.select("part", "before")), "part")
    return joined.withColumn(name, F.col("before") + inside).drop("part", "place", "before")


def reach_all(edges: DataFrame, depth: int, longs: int = REACH_LONGS) -> DataFrame:
    """AG3 for all nodes at once, exactly: columns as of reach().

    A node holds what it reaches as bits: nodes are numbered in order of their ids, of which neighbours are often alike, and a row has the
    bits of ``longs`` times 64 of them, if any is set. A round hands the bits that are new to whatever leads to the node and unites them
    by bitwise or, within the tasks first; bits that are known go no further. A row is 8 bytes for each long and some 40 more, so what is
    held is bounded by nodes times blocks that they reach into, at most nodes squared by some 5 bits; the pairs of reach() take some 40 bytes each.
    Rounds are cut by checkpoints, and nothing is gathered on the driver."""
    if depth < 0:
        raise ValueError("depth must be 0 or more")
    steps = cut(edges.select("src", "dst").where("src <> dst").distinct())
    ids = steps.select(F.col("src").alias("id")).union(steps.select("dst")).union(edges.where("src = dst").select("src")).distinct()
    n = cut(numbered(ids, F.col("id")))
    by_number = steps.join(n.select(F.col("id").alias("src"), F.col("number").alias("a")), "src").join(n.select(F.col("id").alias("dst"), F.col("number").alias("b")), "dst").select("a", "b")
    by_number, size = cut(by_number), 64 * longs
    bits = [f"b{k}" for k in range(longs)]
    out = n
    for count, reached, own, other in (("callee_count", "down_reach", "a", "b"), ("caller_count", "up_reach", "b", "a")):
        links = by_number.select(F.col(own).alias("number"), F.col(other).alias("to"))
        place = F.col("number") % size
        first = [F.when(F.floor(place / 64) == k, F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))).otherwise(F.lit(0).cast("long")).alias(f"b{k}") for k in range(longs)]
        seen = new = n.select("number", F.floor(F.col("number") / size).cast("long").alias("block"), *first)
        for level in range(depth):
            offered = links.join(new.withColumnRenamed("number", "to"), "to").groupBy("number", "block").agg(*(F.bit_or(b).alias(b) for b in bits))
            if level + 1 == depth:
                seen = seen.union(offered)
                break
            known = seen.select("number", "block", *(F.col(b).alias(f"k{b}") for b in bits))
            fresh = offered.join(known, ["number", "block"], "left").select("number", "block", *(F.col(b).bitwiseAND(F.bitwise_not(F.coalesce(f"k{b}", F.lit(0).cast("long")))).alias(b) for b in bits))
            new = cut(fresh.where(" or ".join(f"{b} <> 0" for b in bits)))
            if new.isEmpty():
                break
            seen = cut(seen.union(new).groupBy("number", "block").agg(*(F.bit_or(b).alias(b) for b in bits)))
        united = seen.groupBy("number", "block").agg(*(F.bit_or(b).alias(b) for b in bits))
        total = sum((F.bit_count(b) for b in bits[1:]), F.bit_count(bits[0]))
        counts = united.groupBy("number").agg((F.sum(total) - 1).cast("long").alias(reached))  # less the node itself
        out = out.join(links.groupBy("number").agg(F.count("*").alias(count)), "number", "left").join(counts, "number", "left")
    return out.select("id", "callee_count", "caller_count", "down_reach", "up_reach").fillna(0)


def reach_estimate(edges: DataFrame, depth: int, down: bool = True, lg_k: int = 12) -> DataFrame:
    """(id, reach): for all nodes at once, about how many others each reaches within depth, by HyperLogLog sketches.

    reach() keeps a row for each start and what it reaches, so it is for starts that are few, and reach_all() bits for all pairs; here a node keeps a sketch of 2^lg_k
    registers whatever it reaches (about 1.6 % off at 12), and a round unites the sketches of what a node leads to."""
    own, other = ("src", "dst") if down else ("dst", "src")
    steps = edges.select(F.col(own).alias("at"), F.col(other).alias("to")).where("at <> to").distinct()
    nodes = steps.select(F.col("at").alias("id")).union(steps.select("to")).distinct()
    held = cut(nodes.groupBy("id").agg(F.hll_sketch_agg("id", F.lit(lg_k)).alias("sketch")))
    for level in range(depth):
        united = steps.join(held, F.col("to") == F.col("id")).select(F.col("at").alias("id"), "sketch").union(held).groupBy("id").agg(F.hll_union_agg("sketch").alias("sketch"))
        held = cut(united) if (level + 1) % WRITTEN_LEVELS == 0 else united
    return held.select("id", F.greatest(F.hll_sketch_estimate("sketch") - 1, F.lit(0)).alias("reach"))


#: Words of sinks that raise a node's score in an audit.
SINK_WORDS = ("exec", "eval", "shell", "command", "unsafe", "write", "delete")


def crawl_rank(counts: DataFrame, mode: str = "heal", top_k: int = 20, sinks: Sequence[str] = SINK_WORDS) -> DataFrame:
    """reach() rows scored by mode, best first, then by id."""
    c, e, u, d = (F.col(x) for x in ("caller_count", "callee_count", "up_reach", "down_reach"))
    word = F.lower("id").rlike("|".join(sinks))
    scores: dict[str, Column] = {
        "heal": 3 * c + 2 * e + u + d,
        "audit": c + e + u + d + F.when(word, 25).otherwise(0),
        "prune": F.greatest(F.lit(10_000) - (c + e + u + d), F.lit(0)),
        "mutate": 2 * c + 3 * e + 2 * u + d,
    }
    return counts.withColumn("score", scores[mode].cast("long")).orderBy(F.desc("score"), "id").limit(top_k)


def crawl_frontier(ranked: DataFrame, visited: DataFrame, top_k: int) -> DataFrame:
    """T4: the first top_k of the ranking that haven't been visited."""
    return ranked.join(visited.select("id"), "id", "left_anti").orderBy(F.desc("score"), "id").limit(top_k)


def components_min_label(pairs: DataFrame, at_most: int = 60) -> DataFrame:
    """(id, root): the least id that each end of the pairs (a, b) reaches, ignoring direction, by large-star and small-star rounds."""
    e = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(at_most):
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return e.select(F.col("u").alias("id"), F.col("v").alias("root")).union(e.select("v", "v").distinct())
        before = state
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(least).distinct())
    raise RuntimeError("components did not settle")


#: Rounds in which nodes without incoming or outgoing edges are trimmed off before components are sought.
TRIMS = 2
#: Edges that one task may take whole: the rest of a graph that is counted to be that small needs no more rounds.
LOCAL_EDGES = 200_000
#: Edges of a part, about; one that holds over PART_ROOM times as many is left as it is. Parts are reduced again while at most MOST_LEFT of the edges are left.
PART_EDGES, PART_ROOM, MOST_LEFT = 100_000, 4, 0.7
#: Pairs of a node's neighbours at most for which it is looked at whether it can be left out.
MOST_PAIRS = 64


def strongly_connected(edges: DataFrame, local_edges: int = LOCAL_EDGES, part_edges: int = PART_EDGES) -> DataFrame:
    """(id, component) of nodes on cycles of two nodes or more; component is the least id of the strongly connected component.

    Ranges of ids are parts, a task each. A part's edges give way to fewer ones by which the nodes at its border reach each other as before,
    and that again, as long as edges fall off. Components of what is left are found, and each part then finds those of its
    nodes, from its edges and from which nodes of its border are in one component.

    What is left goes to one task if it has at most local_edges edges. Else a round gives every node the least label that reaches it and
    the least that it reaches; labels are ids in an order that hashing
    draws anew for each round. Where both are one label, the nodes are its component. An edge goes on to the next round only if its
    ends agree in both labels and aren't settled, so what no cycle joins falls apart as in a random quicksort: the rounds grow
    with the logarithm of the nodes, as do the steps of a round, whose labels also take over their own labels' labels."""
    rounds = Rounds(edges.sparkSession)
    kind = edges.schema["src"].dataType.simpleString()
    e = rounds.put("edges", edges.select("src", "dst", F.lit(1).cast("long").alias("length")).where("src <> dst").distinct())
    e, parted = _parted(e, local_edges, part_edges, _border_of_cycles, rounds)
    components = _components(e.select("src", "dst"), local_edges, rounds)
    for k, (placed, nodes) in reversed(list(enumerate(parted))):
        members = components.join(nodes, "id").select("id", "component", "part")
        least = members.where("part is not null").groupBy("part", "component").agg(F.min("id").alias("least"))
        star = members.join(least, ["part", "component"]).select("part", "id", "least", "component")
        joined = star.select("part", F.col("id").alias("src"), F.col("least").alias("dst"), "component").union(star.select("part", "least", "id", "component"))
        own = placed.where("part is not null").select("part", "src", "dst", F.lit(None).cast(kind).alias("component"))
        found = own.union(joined).groupBy("part").applyInArrow(_components_in_part, f"id {kind}, root {kind}")
        found = rounds.put(f"found in parts {k}", found.union(members.where("part is null").select("id", "component")))
        components = _named(found)
    return rounds.last(components)


def _named(found: DataFrame) -> DataFrame:
    """(id, component) of (id, root): components of two nodes or more by their least ids."""
    components = found.groupBy("root").agg(F.min("id").alias("component"), F.count("*").alias("n")).where("n > 1").select("root", "component")
    return found.join(components, "root").select("id", "component")


def _parted(e: DataFrame, local_edges: int, part_edges: int, border: Callable[[pa.Table], pa.Table], rounds: Rounds) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]]]:
    """The edges (src, dst, length; src may be null) that are left once parts of ranges of ids have been reduced to their borders until it doesn't help or at most
    local_edges are left; and for each time the edges with their part and the nodes (id, part). Part is null for edges between parts and in ones that hold too many edges."""
    parted, kind, n = [], e.schema["dst"].dataType.simpleString(), e.count()
    while n > local_edges:
        k, parts = len(parted), max(2, -(-n // part_edges))
        ends = e.select(F.col("dst").alias("id")).union(e.select("src").where("src is not null"))
        nodes = rounds.put(f"nodes {k}", ends.repartitionByRange(parts, "id").select("id", F.spark_partition_id().alias("part")).distinct())
        both = e.join(nodes.select(F.col("id").alias("dst"), F.col("part").alias("to")), "dst").join(nodes.select(F.col("id").alias("src"), F.col("part").alias("from_part")), "src", "left")
        placed = rounds.put(f"placed {k}", both.select("src", "dst", "length", F.when(F.coalesce("from_part", "to") == F.col("to"), F.col("to")).alias("part")))
        crowded = [r["part"] for r in placed.where("part is not null").groupBy("part").count().where(F.col("count") > PART_ROOM * part_edges).collect()]
        if crowded:
            placed, nodes = (x.withColumn("part", F.when(~F.col("part").isin(crowded), F.col("part"))) for x in (placed, nodes))
        across = placed.where("part is null")
        kept = across.select(F.col("dst").alias("id")).union(across.select("src")).distinct().join(nodes.where("part is not null"), "id")
        inner = placed.where("part is not null").select("part", "src", "dst", "length").union(kept.select("part", "id", F.lit(None).cast(kind), F.lit(None).cast("long")))
        fewer = inner.groupBy("part").applyInArrow(border, f"src {kind}, dst {kind}, length long")
        e = rounds.put("edges", across.select("src", "dst", "length").union(fewer))
        parted.append((placed, nodes))
        before, n = n, e.count()
        if n > MOST_LEFT * before:
            break
    return e, parted


def _components(e: DataFrame, local_edges: int, rounds: Rounds) -> DataFrame:
    """(id, component), in one task or by rounds of labels."""
    kind, number = e.schema["src"].dataType, 0
    found = e.select(F.col("src").alias("id"), F.col("src").alias("root")).limit(0)
    e = e.where("src <> dst").distinct()
    while True:
        for _ in range(TRIMS):
            e = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        e = rounds.put("trimmed", e)
        n = e.count()
        if n <= local_edges:
            if n:
                found = found.union(e.coalesce(1).mapInArrow(_components_of, f"id {kind.simpleString()}, root {kind.simpleString()}"))
            break
        into = _least_reaching(e, number, rounds, "into")
        out_of = _least_reaching(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), number, rounds, "out")
        both = rounds.put("both", into.withColumnRenamed("label", "a").join(out_of.withColumnRenamed("label", "b"), "id"))
        found = found.union(rounds.put(f"found{number}", both.where("a = b").select("id", F.col("a").alias("root"))))
        ends = lambda column, n: both.where("a <> b").select(F.col("id").alias(column), F.col("a").alias(f"a{n}"), F.col("b").alias(f"b{n}"))
        e = rounds.put("inner", e.join(ends("src", 1), "src").join(ends("dst", 2), "dst").where("a1 = a2 and b1 = b2").select("src", "dst"))
        number += 1
    return rounds.put("components", _named(found))


def _least_reaching(e: DataFrame, number: int, rounds: Rounds, name: str) -> DataFrame:
    """(id, label): of the nodes that reach a node, itself included, the first in the round's hashed order."""
    label = F.struct(F.xxhash64("id", F.lit(number)).alias("rank"), F.col("id").alias("id")).alias("label")
    labels = rounds.put(name, e.select(F.col("src").alias("id")).union(e.select("dst")).distinct().select("id", label))
    while True:
        offered = e.join(labels.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("label").alias("new"))
        best = labels.join(offered, "id", "left").select("id", "label", F.least("label", F.coalesce("new", "label")).alias("new"))
        # what reaches a label's node reaches what the label reaches
        jump = labels.select(F.col("id").alias("via"), F.col("label").alias("far"))
        after = best.join(jump, F.col("new.id") == F.col("via")).select("id", F.least("new", "far").alias("label"), (F.least("new", "far") != F.col("label")).alias("moved"))
        labels = rounds.put(name, after)
        if not labels.agg(F.bool_or("moved")).first()[0]:
            return labels.select("id", F.col("label.id").alias("label"))
        labels = labels.drop("moved")


def _numbered(columns: Iterable[tuple[list, list]]) -> tuple[list, list[list[int]]]:
    """Ids of a small graph's nodes, and the numbers of what each leads to."""
    numbers: dict = {}
    pairs = [(numbers.setdefault(a, len(numbers)), numbers.setdefault(b, len(numbers))) for src, dst in columns for a, b in zip(src, dst)]
    to: list[list[int]] = [[] for _ in numbers]
    for a, b in pairs:
        to[a].append(b)
    return list(numbers), to


def _roots(to: list[list[int]]) -> list[int]:
    """The number of a node for each node that names its strongly connected component, by one depth-first search."""
    place, low, held, stack, roots = [-1] * len(to), [0] * len(to), [False] * len(to), [], [0] * len(to)
    clock = 0
    for start in range(len(to)):
        walk = [(start, iter(to[start]))] if place[start] < 0 else []
        while walk:
            node, onward = walk[-1]
            if place[node] < 0:
                place[node] = low[node] = clock
                clock += 1
                stack.append(node)
                held[node] = True
            for other in onward:
                if place[other] < 0:
                    walk.append((other, iter(to[other])))
                    break
                if held[other]:
                    low[node] = min(low[node], place[other])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[node])
                if low[node] == place[node]:
                    while True:
                        member = stack.pop()
                        held[member], roots[member] = False, node
                        if member == node:
                            break
    return roots


def _components_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, root) of a small graph's nodes."""
    ids, to = _numbered((b.column(0).to_pylist(), b.column(1).to_pylist()) for b in batches)
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([ids[r] for r in _roots(to)])], names=["id", "root"])


def _components_in_part(table: pa.Table) -> pa.Table:
    """(id, root) of a part (part, src, dst, component); a root is the component that is known of a node, if of any."""
    src, dst, known = (table.column(k).to_pylist() for k in (1, 2, 3))
    ids, to = _numbered([(src, dst)])
    of = dict(zip(ids, _roots(to)))
    names = {of[a]: c for a, c in zip(src, known) if c is not None}
    kind = table.schema.field(1).type
    return pa.table({"id": pa.array(ids, kind), "root": pa.array([names.get(r, ids[r]) for r in of.values()], kind)})


def _leave_out(onward: dict, kept: set) -> None:
    """Nodes that aren't kept are taken out of a graph {node: {next: length}} where that adds no edges: what leads to one leads on to what follows it, by the greatest length."""
    back: dict = {}
    for a, to in onward.items():
        for b in to:
            back.setdefault(b, set()).add(a)
    ready = deque(sorted({*onward, *back} - kept))  # in order of ids, along which graphs are often narrow
    while ready:
        node = ready.popleft()
        into, out = back.get(node, ()), onward.get(node, {})
        if node in out or len(into) * len(out) > MOST_PAIRS or sum(b not in onward[a] for a in into for b in out) > len(into) + len(out):
            continue
        for a in into:
            length = onward[a].pop(node)
            for b, more in out.items():
                onward[a][b] = max(onward[a].get(b, 0), length + more)
                back[b].add(a)
        for b in out:
            back[b].discard(node)
        ready.extend(x for x in (*into, *out) if x not in kept)
        onward.pop(node, None)
        back.pop(node, None)


def _part_of(table: pa.Table) -> tuple[dict, dict]:
    """The graph {node: {next: length}} of a part (part, src, dst, length), and the nodes to keep, which have no dst."""
    onward, kept = {}, {}
    for a, b, length in zip(*(table.column(k).to_pylist() for k in (1, 2, 3))):
        if b is None:
            kept[a] = None
        else:
            to = onward.setdefault(a, {})
            to[b] = max(to.get(b, 0), length)
    return onward, kept


def _edge_table(edges: list[tuple], kind: pa.DataType) -> pa.Table:
    return pa.table({name: pa.array([x[k] for x in edges], t) for k, (name, t) in enumerate((("src", kind), ("dst", kind), ("length", pa.int64())))})


def _border_of_cycles(table: pa.Table) -> pa.Table:
    """Edges by which the kept nodes of a part reach each other as before: those of a component in a ring, and between components what can't be left out."""
    onward, kept = _part_of(table)
    ids, to = _numbered([([a for a, far in onward.items() for _ in far], [b for far in onward.values() for b in far])])
    members: dict = {}
    of = {x: ids[r] for x, r in zip(ids, _roots(to))}
    for x in kept:
        members.setdefault(of.get(x, x), []).append(x)
    edges = [(a, b, 1) for ring in members.values() if len(ring) > 1 for a, b in zip(ring, [*ring[1:], ring[0]])]
    name = {x: members[r][0] if r in members else r for x, r in of.items()}
    between: dict = {}
    for a, far in onward.items():
        for b in far:
            if name[a] != name[b]:
                between.setdefault(name[a], {})[name[b]] = 1
    _leave_out(between, {ring[0] for ring in members.values()})
    return _edge_table(edges + [(a, b, 1) for a, far in between.items() for b in far], table.schema.field(1).type)


def _border_of_levels(table: pa.Table) -> pa.Table:
    """Edges that give the kept nodes of a part the same longest paths; null stands for what is before all starts."""
    onward, kept = _part_of(table)
    _leave_out(onward, {None, *kept})
    return _edge_table([(a, b, length) for a, far in onward.items() for b, length in far.items()], table.schema.field(1).type)


def cycle_report(edges: DataFrame, at_most: int = 10, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """The first components on cycles with their sorted members."""
    return strongly_connected(edges, local_edges).groupBy("component").agg(F.sort_array(F.collect_set("id")).alias("members")).orderBy("component").limit(at_most)


#: Nodes of a walk's front that may be broadcast.
BROADCAST_FRONT = 100_000


def steps_within(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """The distinct edges (src, dst) that walks of at most depth steps from the roots (column id) take. A small front is broadcast, so the edges are only scanned; each node goes on once."""
    rounds = Rounds(edges.sparkSession)
    e = rounds.put("edges", edges.select("src", "dst").where("src <> dst"))
    found, seen = e.limit(0), None
    front = rounds.put("front", roots.select("id").distinct())
    for level in range(depth):
        n = front.count()
        if not n:
            break
        near = F.broadcast(front) if n <= BROADCAST_FRONT else front
        onward = rounds.put(f"onward {level}", e.join(near, F.col("src") == F.col("id"), "left_semi").distinct())
        found = found.union(onward)
        seen = rounds.put("seen", front if seen is None else seen.union(front))
        front = rounds.put("front", onward.select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti"))
    return rounds.last(found)


def paths(edges: DataFrame, roots: DataFrame, depth: int = 64, at_most: int = 50_000) -> DataFrame:
    """The first paths, in order of their ids joined by ``;``, from roots (column id) to nodes where a walk ends, as arrays; a walk also ends
    before a node it has passed, and at depth. An id must not hold ``;``.

    Every walk that goes on ends somewhere, so each of the first ``at_most`` walks of a length stands for a path at least, and none that
    comes after them is needed: a step extends at most some at_most walks, however many paths there are."""
    steps = steps_within(edges, roots, depth)
    # a walk's text as a path, and before what follows it: which of both counts is known once it has been tried to go on
    walking = roots.select(F.array("id").alias("path"), F.col("id").alias("src"), F.col("id").cast("string").alias("text")).distinct()
    done = walking.select("path", "text").limit(0)
    for _ in range(depth):
        walking = cut(walking)
        onward = walking.join(steps, "src").where(~F.array_contains("path", F.col("dst"))).select("text", "path", "dst")
        ended = walking.join(onward.select("text").distinct(), "text", "left_anti").select("path", "text")
        done = cut(done.union(ended))
        walking = cut(onward.select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("src"), F.concat("text", F.lit(";"), F.col("dst").cast("string")).alias("text")))
        n = walking.count()
        if not n:
            break
        if n + done.count() > at_most:
            upper = done.select("text").union(walking.select(F.concat("text", F.lit(";"))))
            last = upper.orderBy("text").limit(at_most).agg(F.max("text")).first()[0]
            done, walking = done.where(F.col("text") <= last), walking.where(F.col("text") <= last)
    return done.union(walking.select("path", "text")).orderBy("text").limit(at_most).select("path")


def count_paths(edges: DataFrame, roots: DataFrame, depth: int = 64) -> DataFrame:
    """(id, paths): how many paths each root of an acyclic graph has, without making any, over the edges that the roots' walks take. The number of a node's paths of at most some steps is the sum over what it leads to; beyond 38 digits it is null."""
    steps = steps_within(edges, roots, depth)
    one = F.lit(1).cast("decimal(38,0)")
    counts = cut(steps.select(F.col("src").alias("id")).union(steps.select("dst")).union(roots.select("id")).distinct().withColumn("paths", one))
    for _ in range(depth):
        summed = steps.join(counts.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.try_sum("paths").cast("decimal(38,0)").alias("more"), F.count("*").alias("n"))
        after = counts.join(summed, "id", "left").select("id", F.when(F.col("n").isNull(), one).otherwise(F.col("more")).alias("paths"), (F.col("n").isNotNull() & ~F.col("more").eqNullSafe(F.col("paths"))).alias("moved"))
        counts = cut(after)
        if not counts.where("moved").limit(1).count():
            break
        counts = counts.drop("moved")
    return counts.join(roots.select("id").distinct(), "id", "left_semi").select("id", "paths")


def topological_levels(edges: DataFrame, nodes: DataFrame | None = None, local_edges: int = LOCAL_EDGES, part_edges: int = PART_EDGES) -> DataFrame:
    """(id, level): a node's level is one more than the greatest of what it depends on. A cycle raises ValueError. An edge goes from what is needed to what needs it.

    A graph of at most local_edges edges goes to one task. Of a larger one, parts are reduced to their borders as in strongly_connected(), with the lengths
    of the longest paths; levels of what is left come from one task or from longest_paths(), and each part then takes those of its own nodes from its border's."""
    kind, one = edges.schema["src"].dataType, F.lit(1).cast("long")
    e = edges.select("src", "dst").distinct()
    ids = e.select(F.col("src").alias("id")).union(e.select("dst"))
    ids = (ids if nodes is None else ids.union(nodes.select("id"))).distinct()
    first = ids.join(e.select(F.col("dst").alias("id")), "id", "left_anti").select(F.lit(None).cast(kind).alias("src"), F.col("id").alias("dst"), one.alias("length"))
    every = e.withColumn("length", one).union(first)
    if e.limit(local_edges + 1).count() <= local_edges:
        return _levels_in_one(every).select("id", F.col("level").cast("int").alias("level"))
    rounds = Rounds(edges.sparkSession)
    every = rounds.put("edges", every)
    start = every.where("src is null").agg(F.min("dst")).first()[0]
    if start is None or every.where("dst is null").limit(1).count():
        raise ValueError("the graph has a cycle or a null id")
    e, parted = _parted(every, local_edges, part_edges, _border_of_levels, rounds)
    if e.limit(local_edges + 1).count() <= local_edges:
        levels = _levels_in_one(e)
    else:  # one start stands for all, at level 0
        after = e.where("src is not null or length > 1").select(F.coalesce("src", F.lit(start)).alias("src"), "dst", (F.col("length") - F.when(F.col("src").isNull(), 1).otherwise(0)).alias("length"))
        left = e.select(F.col("dst").alias("id")).union(after.select("src")).distinct()
        levels, _ = longest_paths(after, left, rounds)
    for k, (placed, nodes) in reversed(list(enumerate(parted))):
        known = levels.join(nodes, "id").select("part", F.lit(None).cast(kind).alias("src"), "id", (F.col("level") + 1).alias("length"))
        own = placed.where("part is not null").select("part", "src", "dst", "length").union(known.where("part is not null"))
        found = own.groupBy("part").applyInArrow(_levels_in_part, f"id {kind.simpleString()}, level long")
        levels = rounds.put(f"levels in parts {k}", found.union(known.where("part is null").select("id", F.col("length") - 1)))
    return rounds.last(levels.select("id", F.col("level").cast("int").alias("level")))


def _levels_in_one(every: DataFrame) -> DataFrame:
    """(id, level) by one task from edges (src, dst, length), with one of length 1 from null to each start."""
    levels = cut(every.coalesce(1).mapInArrow(_levels_of, f"id {every.schema['dst'].dataType.simpleString()}, level long"))
    if levels.where("level is null").limit(1).count():
        raise ValueError("the graph has a cycle")
    return levels.select("id", (F.col("level") - 1).alias("level"))


def _levels_in_part(table: pa.Table) -> pa.Table:
    found = list(_levels_of(table.select([1, 2, 3]).to_batches()))
    levels = [x - 1 for batch in found for x in batch.column(1).to_pylist()]
    return pa.table({"id": pa.array([x for batch in found for x in batch.column(0).to_pylist()], table.schema.field(2).type), "level": pa.array(levels, pa.int64())})


def longest_paths(e: DataFrame, ids: DataFrame, rounds: Rounds) -> tuple[DataFrame, int]:
    """(id, level) of the ids, by improving choices, and the number of times that all nodes chose. A cycle raises ValueError. Edges (src, dst) may have a length.

    Each node that needs others chooses one of them. Along the choices, which form a forest, levels are lengths that doubling of pointers
    gives, in as many joins as the depth has bits. A node that another choice would put higher takes that one, and the lengths are taken
    anew, until no choice is better: levels then are one more than the greatest of what a node needs. A choice carries all of what
    hangs on it along, so chains and trees settle at once, and ladders and layers in some rounds, not one a level; a round more is due
    where better choices follow on each other in one path. Choices on a cycle never reach a start, which the doubling notices."""
    if "length" not in e.columns:
        e = e.withColumn("length", F.lit(1).cast("long"))
    choice = rounds.put("choice", e.groupBy(F.col("dst").alias("id")).agg(F.max(F.struct("src", "length")).alias("x")).select("id", F.col("x.src").alias("to"), "x.length"))
    starts = rounds.put("starts", ids.join(choice.select("id"), "id", "left_anti"))
    taken = 0
    while True:
        taken += 1
        if choice.isEmpty():
            return starts.withColumn("level", F.lit(0).cast("long")), taken
        lengths = _to_starts(choice, rounds)
        levels = rounds.put("levels", lengths.select("id", F.col("length").alias("level")).union(starts.withColumn("level", F.lit(0).cast("long"))))
        best = e.join(levels.select(F.col("id").alias("src"), "level"), "src").groupBy(F.col("dst").alias("id")).agg(F.max(F.struct((F.col("level") + F.col("length")).alias("level"), "src", "length")).alias("best"))
        better = F.col("best.level") > F.col("level")
        take = lambda own, new: F.when(better, F.col(f"best.{new}")).otherwise(F.col(own)).alias(own)
        choice = rounds.put("choice", choice.join(best, "id").join(levels, "id").select("id", take("to", "src"), take("length", "length"), better.alias("moved")))
        if not choice.where("moved").limit(1).count():
            return levels, taken
        choice = choice.drop("moved")


def _to_starts(points: DataFrame, rounds: Rounds) -> DataFrame:
    """(id, to, length) whose ``to`` is none of the ids: pointers are doubled until each has left their number behind."""
    points = rounds.put("points", points)
    for _ in range(points.count().bit_length() + 2):
        far = points.select(F.col("id").alias("via"), F.col("to").alias("far"), F.col("length").alias("more"))
        went = F.col("via").isNotNull()
        points = rounds.put("points", points.join(far, F.col("to") == F.col("via"), "left").select("id", F.when(went, F.col("far")).otherwise(F.col("to")).alias("to"), (F.col("length") + F.coalesce("more", F.lit(0))).alias("length"), went.alias("went")))
        if not points.where("went").limit(1).count():
            return points.drop("went")
        points = points.drop("went")
    raise ValueError("the graph has a cycle")


def _levels_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, level) of a small graph of edges (src, dst, length), by taking away what needs nothing; null where a cycle forbids it."""
    out: dict[object, list] = {}
    needs: dict[object, int] = {}
    for batch in batches:
        for src, dst, length in zip(*(c.to_pylist() for c in batch.columns)):
            out.setdefault(src, []).append((dst, length))
            needs[dst] = needs.get(dst, 0) + 1
    levels = dict.fromkeys([None, *out], 0)
    ready = [x for x in levels if x not in needs]
    done = []
    while ready:
        node = ready.pop()
        for dst, length in out.get(node, ()):
            levels[dst] = max(levels.get(dst, 0), levels[node] + length)
            needs[dst] -= 1
            if not needs[dst]:
                ready.append(dst)
                done.append(dst)
    rows = [(x, levels[x]) for x in done] + [(x, None) for x, n in needs.items() if n]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows]), pa.array([y for _, y in rows], pa.int64())], names=["id", "level"])


def prune_to_focus(items: DataFrame, edges: DataFrame, focus: DataFrame, distance: int) -> DataFrame:
    """Items (column id) within a distance of the focus in either direction."""
    near = bfs_levels(edges, focus, distance).select("id").union(bfs_levels(edges, focus, distance, down=False).select("id"))
    return items.join(near.distinct(), "id", "left_semi")


def dangling_edges(edges: DataFrame, alias: str) -> DataFrame:
    """Edges from outside a linked context into it, which its removal would leave dangling."""
    prefix = f"@{alias}::"
    return edges.where(F.col("dst").startswith(prefix) & ~F.col("src").startswith(prefix))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
