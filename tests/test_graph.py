from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import edges as E, graph as G, integrity as I, search as S, snapshots as N

SYM = "id string, filepath string, name string, kind string, role string, link_name string, start_byte long, end_byte long"


def edges(spark, *pairs, kind="calls"):
    return spark.createDataFrame([(a, b, kind, "semantic", 0.8, None) for a, b in pairs], "src string, dst string, kind string, tier string, confidence double, source string")


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def symbols(spark, *items):
    """(file, name, kind, start, end)"""
    return spark.createDataFrame([(f"{f}::{n}", f, n, k, "definition", None, a, b) for f, n, k, a, b in items], SYM)


def sources(spark, **files):
    return spark.createDataFrame([(k.replace("__", "/").replace("_rs", ".rs"), v) for k, v in files.items()], "filepath string, content string")


def test_call_in_the_same_file_is_confident(spark):
    text = "fn callee() {}\nfn caller() { callee(); }"
    s = symbols(spark, ("src/lib.rs", "callee", "function", 0, 14), ("src/lib.rs", "caller", "function", 15, len(text)))
    (edge,) = E.call_edges(s, sources(spark, src__lib_rs=text)).collect()
    assert (edge["src"], edge["dst"], edge["kind"], edge["tier"]) == ("src/lib.rs::caller", "src/lib.rs::callee", "calls", "semantic")
    assert edge["confidence"] == pytest.approx(0.92)
    assert not G.filter_edges(E.call_edges(s, sources(spark, src__lib_rs=text)), 0.93).count()


def test_import(spark):
    s = symbols(spark, ("src/helper.rs", "callee", "function", 0, 14), ("src/lib.rs", "caller", "function", 28, 42))
    (edge,) = E.import_edges(s, sources(spark, src__helper_rs="fn callee() {}", src__lib_rs="use crate::helper::callee;\n\nfn caller() {}")).collect()
    assert (edge["dst"], edge["kind"], edge["tier"]) == ("src/helper.rs::callee", "imports", "structural")
    assert edge["confidence"] == pytest.approx(0.94) and {"import_scan", "qualified_import"} <= set(edge["evidence"])


def test_import_names(spark):
    text = "use a::{b, c as d, self};\npub use x::y;\nimport os, sys as s\nimport { q, r } from 'm';\nfrom pkg.mod import (f, g as h)\n#include <dir/head.h>\n#include \"own.hpp\"\n"
    assert {r["imported"] for r in E.import_names(sources(spark, a_rs=text)).collect()} == {"a::b", "a::c", "x::y", "os", "sys", "q", "r", "pkg.mod.f", "pkg.mod.g", "head", "own"}


def test_containment_takes_the_nearest(spark):
    s = symbols(spark, ("a.rs", "outer", "module", 0, 60), ("a.rs", "inner", "module", 16, 56), ("a.rs", "helper", "function", 36, 50), ("a.rs", "S", "struct", 61, 90), ("a.rs", "m", "method", 70, 80))
    found = E.containment_edges(s)
    assert rows(found.where("kind = 'contains'"), "src", "dst") == [("a.rs::S", "a.rs::m"), ("a.rs::inner", "a.rs::helper"), ("a.rs::outer", "a.rs::inner")]
    declares = {(r["src"], r["dst"]): r for r in found.where("kind = 'declares'").collect()}
    assert declares["a.rs::inner", "a.rs::helper"]["confidence"] == pytest.approx(0.95)
    (member,) = found.where("kind = 'owns_member'").collect()
    assert member["confidence"] == pytest.approx(0.94) and "owner_kind:struct" in member["evidence"]


def test_ambiguous_call_has_two_weak_edges(spark):
    s = symbols(spark, ("src/main.rs", "caller", "function", 0, 24), ("src/a.rs", "target", "function", 0, 14), ("src/b.rs", "target", "function", 0, 14))
    found = E.call_edges(s, sources(spark, src__main_rs="fn caller() { target() }", src__a_rs="fn target() {}", src__b_rs="fn target() {}"))
    assert [r["confidence"] for r in found.collect()] == pytest.approx([0.59, 0.59])
    assert G.filter_edges(found, 0.55).count() == 2 and G.filter_edges(found, 0.80).count() == 0


def test_refresh_equals_rebuild(spark):
    from sparkloom.sources.extract import symbols as extract

    before = {"src/a.rs": "fn callee() {}\n", "src/b.rs": "use crate::a::callee;\nfn caller() {\n    callee();\n}\n", "src/c.rs": "fn other() {\n    caller();\n}\n"}
    after = before | {"src/a.rs": "fn helper() {}\n", "src/d.rs": "mod m {\n    fn callee() {}\n}\n"}
    frame = lambda files: spark.createDataFrame(list(files.items()), "filepath string, content string")
    old, new = extract(frame(before)), extract(frame(after))
    touched = spark.createDataFrame([("src/a.rs",), ("src/d.rs",)], "filepath string")
    removed = old.join(new.select("id"), "id", "left_anti")
    refreshed = E.refresh_edges(E.build_edges(old, frame(before)), new, frame(after), touched, removed)
    columns = ("src", "dst", "kind", "confidence")
    assert rows(refreshed, *columns) == rows(E.build_edges(new, frame(after)), *columns)
    # with stored sites and imports, the text of files that weren't touched isn't needed
    only = frame({k: v for k, v in after.items() if before.get(k) != v})
    stored = E.refresh_edges(E.build_edges(old, frame(before)), new, only, touched, removed, E.call_sites(old, frame(before)), E.import_names(frame(before)))
    assert rows(stored, *columns) == rows(refreshed, *columns)
    assert ("src/b.rs::caller", "src/a.rs::callee") not in rows(refreshed, "src", "dst")


def test_bfs_levels(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("b", "d"), ("d", "e"), ("x", "a"), *((f"n{k}", f"n{k + 1}") for k in range(12)))
    assert rows(G.bfs_levels(e, ids(spark, "a"), 2), "id", "level") == [("a", 0), ("b", 1), ("c", 2), ("d", 2)]
    assert rows(G.bfs_levels(e, ids(spark, "a"), 1, down=False), "id", "level") == [("a", 0), ("c", 1), ("x", 1)]
    assert rows(G.bfs_levels(e, ids(spark, "n0"), 100), "id", "level") == sorted((f"n{k}", k) for k in range(13))
    assert rows(G.bfs_levels(e, ids(spark, "lonely"), 3), "id", "level") == [("lonely", 0)]
    with pytest.raises(ValueError):
        G.bfs_levels(e, ids(spark, "a"), 256)


def test_components_of_cycles(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("g", "g"))
    assert rows(G.strongly_connected(e), "id", "component") == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")]
    assert [r["members"] for r in G.cycle_report(e).collect()] == [["a", "b", "c"], ["d", "e"]]
    assert G.strongly_connected(edges(spark, ("a", "b"))).count() == 0


@pytest.mark.parametrize("local", [0, 1000])
def test_components_and_levels_of_any_depth(spark, local):
    """Both ways of a round against one process; rings and chains are longer than any number of rounds."""
    import random

    r = random.Random(local)
    ring = [(f"r{k:03}", f"r{(k + 1) % 60:03}") for k in range(60)]
    nested = [(f"c{k}a", f"c{k}b") for k in range(5)] + [(f"c{k}b", f"c{k}a") for k in range(5)] + [(f"c{j}a", f"c{k}b") for j in range(5) for k in range(j + 1, 5)]
    loose = [(f"x{r.randrange(30)}", f"x{r.randrange(30)}") for _ in range(40)]
    reach = {}
    every = ring + nested + loose + [("r005", "c0a"), ("c4b", "tail"), ("g", "g")]
    for a, b in every:
        reach.setdefault(a, set()).add(b)
    nodes = {x for pair in every for x in pair}
    for k in nodes:
        for i in nodes:
            if k in reach.get(i, ()):
                reach[i] |= reach.get(k, set())
    want = sorted((a, min(b for b in nodes if b == a or (b in reach.get(a, ()) and a in reach.get(b, ())))) for a in nodes if any(b != a and b in reach.get(a, ()) and a in reach.get(b, ()) for b in nodes))
    assert rows(G.strongly_connected(edges(spark, *every), local), "id", "component") == want
    dag = [(f"n{a:03}", f"n{b:03}") for a, b in {tuple(sorted(r.sample(range(60), 2))) for _ in range(90)}] + [(f"n{k:03}", f"n{k + 1:03}") for k in range(60, 120)] + [(f"n{k:03}", f"n{k + d:03}") for k in range(120, 160, 3) for d in (1, 2)] + [(f"n{k + d:03}", f"n{k + 3:03}") for k in range(120, 160, 3) for d in (1, 2)]
    level = {x: 0 for pair in dag for x in pair}
    for _ in level:
        for a, b in dag:
            level[b] = max(level[b], level[a] + 1)
    assert rows(G.topological_levels(edges(spark, *dag), ids(spark, "alone"), local), "id", "level") == sorted({**level, "alone": 0}.items())
    for cycle in ([("a", "b"), ("b", "a")], [("s", "a"), ("a", "b"), ("b", "a")], [("a", "a")], dag[:20] + [("z", "y"), ("y", "z"), ("n000", "y")]):
        with pytest.raises(ValueError):
            G.topological_levels(edges(spark, *cycle), None, local)
    assert G.topological_levels(edges(spark, ("a", "b")).limit(0)).count() == 0


def test_hubs_and_estimates(spark):
    e = edges(spark, *(("hub", f"n{k}") for k in range(300)), *((f"n{k}", f"m{k}") for k in range(300)), ("hub", "n1"))
    blocks = [r for r in G.neighbors(e, block_size=100).collect() if r["id"] == "hub"]
    assert len(blocks) == 3 and sorted(x for r in blocks for x in r["neighbors"]) == sorted(f"n{k}" for k in range(300))
    about = {r["id"]: r["reach"] for r in G.reach_estimate(e, 2).collect()}
    assert about["hub"] == pytest.approx(600, rel=0.1) and about["n7"] == 1 and about["m7"] == 0
    walked = G.graph_query(edges(spark, ("a", "b"), ("b", "c")).unionByName(edges(spark, ("a", "x")).withColumn("confidence", F.lit(0.1))), ids(spark, "a", "b", "c", "x"), ids(spark, "a"), 0, 2, 0.5, filter_traversal=True)
    assert rows(walked["levels"], "id") == [("a",), ("b",), ("c",)]


def test_paths_and_levels(spark):
    e = edges(spark, ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"))
    assert [";".join(r["path"]) for r in G.paths(e, ids(spark, "a")).collect()] == ["a;b;d", "a;c;d"]
    assert [";".join(r["path"]) for r in G.paths(edges(spark, ("a", "b"), ("b", "a")), ids(spark, "a")).collect()] == ["a;b"]
    assert rows(G.topological_levels(e), "id", "level") == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    with pytest.raises(ValueError):
        G.topological_levels(edges(spark, ("a", "b"), ("b", "a")))


def test_fan_out_and_cross_module(spark):
    before, after = edges(spark).limit(0), edges(spark, *(("run", f"c{k}") for k in range(4)))
    assert [(r["id"], r["delta"]) for r in I.fan_out_spikes(before, after).collect()] == [("run", 4)]
    files = spark.createDataFrame([("s", "src/icp.rs"), ("f", "src/loop.rs"), ("t", "src/icp.rs")], "id string, filepath string")
    assert rows(I.cross_module_alerts(before, edges(spark, ("s", "f"), ("s", "t")), files), "src", "dst") == [("s", "f")]


def test_search(spark):
    s = spark.createDataFrame([("1", "main", "a.rs", "function"), ("2", "helper_func", "b.rs", "function"), ("3", "X", "c.rs", "class")], "id string, name string, filepath string, kind string")
    for q, want in (("helper", ["2"]), ("main", ["1"]), ("help", ["2"]), ("elper", ["2"]), ("zzz", []), ("x", ["3"]), ("el", [])):
        assert [r["id"] for r in S.search_ranked(s, q).collect()] == want, q


def test_find_is_mapped_to_the_enclosing_symbol(spark):
    text = "x = 1\ndef f():\n    magic_string = 'foobar'\n"
    files = spark.createDataFrame([("main.py", text)], "file string, text string")
    spans = spark.createDataFrame([("main.py", "main.py::f", 6, len(text))], "file string, id string, start long, end long")
    (hit,) = S.find(files, spans, "foobar").collect()
    assert hit["id"] == "main.py::f" and hit["at"] == text.index("foobar")
    assert S.find_occurrences(spark.createDataFrame([("f", "a.b a.b a+b")], "file string, text string"), "a.b").count() == 2


def test_traces(spark):
    t = spark.createDataFrame([("1", "thread 'main' panicked at src/lib.rs:12:5\n0: mycrate::worker::run_job"), ("2", 'File "pkg/service.py", line 41, in handle_event')], "id string, text string")
    found = S.trace_tokens(t)
    by_id = {i: {r["token"] for r in found.where(f"id = '{i}'").collect()} for i in ("1", "2")}
    assert {"mycrate::worker::run_job", "run_job", "src/lib", "lib"} <= by_id["1"] and {"pkg/service", "service", "handle_event"} <= by_id["2"]
    first = S.trace_summary(found).where("id = '1'").first()
    assert first["primary_kind"] == "qualified_symbol" and first["file_candidates"] == 1


def test_snapshots(spark):
    a, b = edges(spark, ("a", "b"), ("b", "c")), edges(spark, ("a", "b"), ("c", "d"))
    assert rows(N.changed_keys(a, b, ["src", "dst"]), "src", "dst", "change") == [("b", "c", "removed"), ("c", "d", "added")]
    assert N.changed_keys(a, a, ["src", "dst"]).count() == 0 and N.delta_risk(a, a).first()["risk"] == "low"
    assert N.delta_risk(a, b).first()["risk"] == "high"
    many = spark.createDataFrame([(k % 50, str(k % 7)) for k in range(500)], "k int, v string")
    assert N.state_hash(many, "k", "v").first() == N.state_hash(many.repartition(7), "k", "v").first()
    assert N.state_hash(many, "k", "v").first() != N.state_hash(many.limit(499), "k", "v").first()


def test_error_places(spark):
    from sparkloom.operators import faults as X

    lines = ["  --> src/a.rs:10:5", "    at run (/x/b.js:7:1)", "at c.js:3:2", '  File "d.py", line 9, in f', "e.cpp:4:5: error: no", "C:/f.c:8: error: no", "note: nothing:1:2"]
    found = [r["p"] for r in spark.createDataFrame([(x,) for x in lines], "line string").select(X.error_place(F.col("line")).alias("p")).collect()]
    assert [tuple(p) if p else None for p in found] == [("src/a.rs", 10), ("/x/b.js", 7), ("c.js", 3), ("d.py", 9), ("e.cpp", 4), ("C:/f.c", 8), None]
    symbols = spark.createDataFrame([("o", "src/a.rs", 1, 20), ("i", "src/a.rs", 9, 12)], "id string, filepath string, start_line long, end_line long")
    marked = {r["id"]: r["is_poisoned"] for r in X.annotate(symbols, spark.createDataFrame([(lines[0],)], "line string")).collect()}
    assert marked == {"o": False, "i": True}


def test_find_enclosing_reads_whole_texts(spark):
    """The query's texts have no size limit, the operator's own default has one."""
    from sparkloom.queries import search as queries

    text = "x" * (600 * 1024) + "\nAll rights reserved.\n"
    docs = spark.createDataFrame([(1, text), (2, "All rights reserved.")], "doc_id long, text string")
    docs.write.parquet(folder := f"{spark.conf.get('spark.checkpoint.dir')}/tx3/documents.parquet")
    found = queries.query.queries["tx3_find_enclosing"](spark, folder.rpartition("/")[0])
    assert sorted((r["file"], r["id"], r["at"]) for r in found.collect()) == [("1", "1:1", 600 * 1024 + 1), ("2", "2:0", 0)]
    files = docs.selectExpr("cast(doc_id as string) as file", "text")
    assert [r["file"] for r in S.find_occurrences(files, "All rights").collect()] == ["2"]


def test_tiered(spark):
    s = spark.createDataFrame([("1", "load_a", "a.rs", "function"), ("2", "load_b", "b.rs", "function"), ("3", "other", "a.rs", "function")], "id string, name string, filepath string, kind string")
    files = spark.createDataFrame([("a.rs", "fn load() {}"), ("b.rs", "fn f() {}")], "file string, text string")
    spans = spark.createDataFrame([("a.rs", "1", 0, 12)], "file string, id string, start long, end long")
    runs = spark.range(8).withColumnRenamed("id", "ts_unix")
    found = S.tiered(s, files, spans, runs, "load")
    assert rows(found["seeds"], "filepath") == [("a.rs",)] and rows(found["symbols"], "id") == [("1",)] and rows(found["runs"], "ts_unix") == [(k,) for k in range(3, 8)]
    nowhere = S.tiered(s, files.limit(0), spans, runs, "load")
    assert rows(nowhere["seeds"], "filepath") == [] and rows(nowhere["symbols"], "id") == [("1",), ("2",)]


def test_trace_graph(spark):
    traces = spark.createDataFrame([("1", "at crate::run"), ("2", "in nothing_here"), ("3", "run then stop")], "id string, text string")
    s = spark.createDataFrame([("a", "run"), ("b", "stop"), ("c", "far"), ("d", "off")], "id string, name string")
    graph = S.trace_graph(S.trace_tokens(traces), s, edges(spark, ("a", "b"), ("c", "a"), ("a", "a"), ("c", "d"), ("c", "a")))
    assert rows(graph["seeds"], "id", "symbol") == [("1", "a"), ("3", "a"), ("3", "b")]
    near = [("a", "a"), ("a", "b"), ("c", "a"), ("c", "a")]
    assert rows(graph["edges"], "id", "src", "dst") == [(i, *e) for i in ("1", "3") for e in near]
    assert graph["edges"].columns[1:] == edges(spark, ("a", "b")).columns and graph["summary"].count() == 3


def test_reach_of_all_nodes_equals_reach_of_each(spark):
    r = random.Random(8)
    pairs = {(f"n{r.randrange(90):02d}", f"n{r.randrange(90):02d}") for _ in range(260)} | {("self", "self")}
    edges = spark.createDataFrame(sorted(pairs), "src string, dst string")
    to = {}
    for a, b in pairs:
        if a != b:
            to.setdefault(a, set()).add(b)
    back = {}
    for a, own in to.items():
        for b in own:
            back.setdefault(b, set()).add(a)

    def within(steps, start, depth):
        seen = front = {start}
        for _ in range(depth):
            front = {y for x in front for y in steps.get(x, ())} - seen
            seen = seen | front
        return len(seen) - 1

    want = sorted((x, len(to.get(x, ())), len(back.get(x, ())), within(to, x, 3), within(back, x, 3)) for x in {n for p in pairs for n in p})
    got = G.reach_all(edges, 3, longs=1).select("id", "callee_count", "caller_count", "down_reach", "up_reach").collect()
    assert sorted(map(tuple, got)) == want


def test_levels_settle_in_few_rounds(spark):
    """A ladder of 40 layers whose first choices are wrong takes some rounds, not one a layer; a cycle is told."""
    from sparkloom.operators.lineage import Rounds

    steps = [(2 * layer + k, 2 * (layer + far) + m) for layer in range(40) for far in (1, 5) for k in (0, 1) for m in (0, 1) if layer + far < 40]
    edges = spark.createDataFrame([(f"v{999 - a:03d}", f"v{999 - b:03d}") for a, b in steps], "src string, dst string")
    ids = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    rounds = Rounds(spark)
    levels, taken = G.longest_paths(edges, ids, rounds)
    assert {r["id"]: r["level"] for r in levels.collect()} == {f"v{999 - k:03d}": k // 2 for k in range(80)} and taken <= 8
    with pytest.raises(ValueError, match="cycle"):
        G.topological_levels(edges.union(spark.createDataFrame([("v920", "v999")], "src string, dst string")), local_edges=1)


def test_first_paths_of_cyclic_graphs(spark):
    r = random.Random(3)
    steps = {(r.choice("abcdefg") * r.randrange(1, 3), r.choice("abcdefg") * r.randrange(1, 3)) for _ in range(40)}
    edges = spark.createDataFrame(sorted(steps), "src string, dst string")
    to = {a: sorted({b for x, b in steps if x == a and b != a}) for a, _ in steps}

    def walk(path, depth):
        onward = [b for b in to.get(path[-1], ()) if b not in path] if depth else []
        return [x for b in onward for x in walk([*path, b], depth - 1)] if onward else [";".join(path)]

    want = sorted({x for root in ("a", "b") for x in walk([root], 5)})
    assert len(want) > 60
    roots = spark.createDataFrame([("a",), ("b",)], "id string")
    for at_most in (7, 50, 10_000):
        assert [";".join(x["path"]) for x in G.paths(edges, roots, 5, at_most).collect()] == want[:at_most]


def test_qualified_calls_meet_what_ends_alike(spark):
    r = random.Random(5)
    parts = ["a", "bar", "x.get", "get", "io", "Foo"]
    symbols = [(f"{d}/{p}.{e}::{n}", f"{d}/{p}.{e}", n) for d in ("src", "lib/Foo") for p in parts for e in ("rs", "py") for n in ("get", "new")] + [(f"plain{k}::get", f"plain{k}", "get") for k in range(40)]
    sites = [(f"c{k}", f"{r.choice(['src', 'lib', 'no'])}/q.{r.choice(['rs', 'go'])}", r.choice(["x.get", "Foo::new", "o::get", "io.rs::get", "get", "a.py::new", "::get", "n7::get", "zz.get"])) for k in range(120)]
    found = E.call_candidates(spark.createDataFrame(sites, "caller string, filepath string, called string"), spark.createDataFrame(symbols, "id string, filepath string, name string"))
    got = {(x["caller"], x["target"], x["score"]) for x in found.collect()}

    def parent(p):
        return p.rpartition("/")[0]

    def extension(p):
        last = p.rpartition("/")[2]
        return last.rpartition(".")[2] if "." in last[1:] else ""

    want = set()
    for caller, path, called in sites:
        leaf = re.split("[.:]", called)[-1]
        scored = [(100 * (p == path) + 20 * (parent(p) == parent(path)) + 10 * (extension(p) == extension(path)) + 15 * (("::" in called or "." in called) and (called in i or called in p)), i) for i, p, n in symbols if n == leaf]
        best = max(s for s, _ in scored)
        want |= {(caller, i, s) for s, i in scored if s == best}
    assert got == want
    # a call that nothing of the name matches meets none of the name's symbols to tell so
    many = spark.range(5000).select(F.format_string("d%d/f.rs::get", "id").alias("target"), F.format_string("d%d/f.rs", "id").alias("target_path"), F.lit("get").alias("name"))
    asked = spark.createDataFrame([("c", "x.get", "no/q.go", "get", True)], "caller string, called string, filepath string, leaf string, qualified boolean")
    assert E.qualified_matches(asked, many).count() == 0
