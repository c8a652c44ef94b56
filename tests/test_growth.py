"""What may not grow faster than its input: symbols met by traces, hubs' lists, calls that many files share."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import diffs as D, edges as E, graph as G, search as S
from sparkloom.operators.lineage import Rounds, spread_join
from sparkloom.queries import extract as QX, graph as QG, policy as QP
from sparkloom.sources import extract as X


def test_traces_meet_the_first_symbols_of_a_name_only(spark):
    symbols = spark.createDataFrame([(f"x{k:03}", "Run" if k % 2 else "run") for k in range(300)] + [("a", None), ("b", "other")], "id string, name string")
    assert sorted(map(tuple, S.first_named(symbols, 2).collect())) == [("other", "b"), ("run", "x000"), ("run", "x001")]
    found = spark.createDataFrame([("t", "m::run"), ("t", "run"), ("u", "other"), ("u", "none")], "id string, token string")
    assert sorted(map(tuple, S.trace_seeds(found, symbols).collect())) == [("t", "x000"), ("t", "x001"), ("t", "x002"), ("t", "x003"), ("u", "b")]
    links = spark.createDataFrame([("x000", "x001"), ("x001", "q"), ("q", "x001"), (None, "b"), ("x200", "x201")], "src string, dst string")
    graph = S.trace_graph(found, symbols, links)["edges"]
    assert sorted(map(repr, map(tuple, graph.collect()))) == sorted(map(repr, [("t", "x000", "x001"), ("t", "x001", "q"), ("t", "q", "x001"), ("u", None, "b")]))


def test_tokens_of_a_trace_are_not_dealt_again(spark):
    """F16: a trace's tokens are told apart in its row; only ids of several rows, null ones too, are compared across rows."""
    once = spark.createDataFrame([("1", "at src/a.b.rs:12:5: m::run, m::run in a/x"), ("2", "..\\win\\y.py:3 none ab"), ("3", None)], "id string, text string")
    found = S.trace_tokens(once)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = [("1", x) for x in ("m::run", "run", "src/a.b", "src/a.b.rs")] + [("1", "a/x")] + [("2", x) for x in ("none", "win\\y", "win\\y.py")]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    again = spark.createDataFrame([("1", "m::run"), ("1", "see run"), ("1", "see run"), (None, "see"), (None, "see it"), ("2", "see")], "id string, text string")
    assert sorted(map(repr, map(tuple, S.trace_tokens(again).collect()))) == sorted(map(repr, [("1", "m::run"), ("1", "run"), ("1", "see"), (None, "see"), ("2", "see")]))


def test_a_hub_has_one_row_in_the_query(spark):
    rows = spark.createDataFrame([(f"n{k:03}", "hub") for k in range(300)], "src string, dst string")
    blocks = G.neighbors(rows, down=False, block_size=100)
    assert blocks.count() > 1
    assert [tuple(r) for r in QG._listed(blocks).collect()] == [("hub", ",".join(f"n{k:03}" for k in range(300)))]


def test_callers_that_share_file_and_text_share_candidates(spark, monkeypatch):
    asked = []
    whole = E.near_candidates
    monkeypatch.setattr(E, "near_candidates", lambda sites, targets: asked.append(sites.count()) or whole(sites, targets))
    sites = spark.createDataFrame([(f"c{k}", "a/x.py", "run") for k in range(50)] + [("c0", "b/z.rs", "run"), ("c1", "a/x.py", "none")], "caller string, filepath string, called string")
    symbols = spark.createDataFrame([("a/x.py::run", "a/x.py", "run"), ("a/y.py::run", "a/y.py", "run"), ("b/q.rs::run", "b/q.rs", "run"), ("b/r.rs::run", "b/r.rs", "run")], "id string, filepath string, name string")
    rows = E.call_candidates(sites, symbols).collect()
    assert asked == [3]  # not a row for each caller
    # c0 also stands in another file, where candidates score less
    assert sorted((r["caller"], r["target"], r["score"], r["confidence"]) for r in rows) == sorted((f"c{k}", "a/x.py::run", 130, 0.92) for k in range(50))


def test_a_large_key_is_dealt_into_parts(spark):
    left = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").alias("a"))
    right = spark.createDataFrame([(1, b) for b in range(100)], "k long, b long")
    found = spread_join(left, right, ["k"], "a", part_rows=1000)
    assert found.count() == found.distinct().count() == 50_000
    sizes = [r["n"] for r in found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 20 and max(sizes) < 10_000


def test_texts_of_spans_are_not_broadcast(spark):
    sources = spark.range(3).select(F.concat(F.lit("f"), "id").alias("filepath"), F.lit("run()").alias("content"))
    spans = sources.select("filepath", F.col("filepath").alias("id"), F.lit(0).cast("long").alias("start_byte"), F.lit(5).cast("long").alias("end_byte"))
    sites = E.call_sites(spans, sources)
    assert "Broadcast" not in sites._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, sites.collect())) == [(f"f{k}", f"f{k}", "run") for k in range(3)]


def test_parts_are_reduced_to_their_borders(spark):
    """Rings and chains through many parts of ids take a task a part and no rounds of labels; results are those of one task."""
    ring = [(f"r{k:04}", f"r{(k + 1) % 600:04}") for k in range(600)]
    sevens = [(f"s{7 * g + k:04}", f"s{7 * g + (k + 1) % 7:04}") for g in range(60) for k in range(7)] + [(f"s{7 * g:04}", f"s{7 * (g + d):04}") for g in range(57) for d in (1, 2, 3)]
    tails = [("r0003", "s0000"), ("a", "r0001"), ("s0405", "z"), ("s0200", "s0100"), ("s0014", "s0014")]
    edges = spark.createDataFrame(ring + sevens + tails, "src string, dst string")
    one = sorted(map(tuple, G.strongly_connected(edges, 10_000).collect()))
    rounds = Rounds(spark)
    steps = edges.where("src <> dst").withColumn("length", F.lit(1).cast("long"))
    left, parted = G._parted(steps, 20, 50, G._border_of_cycles, rounds)
    assert len(parted) > 1 and left.count() < 60
    assert sorted(map(tuple, G.strongly_connected(edges, 20, 50).collect())) == one and len(one) == 1020
    dag = [(f"n{k:04}", f"n{k + d:04}") for k in range(400) for d in (1, 2)] + [(f"m{999 - 2 * k - i:04}", f"m{997 - 2 * k - j:04}") for k in range(100) for i in (0, 1) for j in (0, 1)] + [("n0003", "m0990")]
    order = spark.createDataFrame(dag, "src string, dst string")
    levels = sorted(map(tuple, G.topological_levels(order, local_edges=10_000).collect()))
    assert sorted(map(tuple, G.topological_levels(order, None, 20, 50).collect())) == levels
    assert sorted(map(tuple, G.topological_levels(order, None, 1, 50).collect())) == levels  # what is left goes to longest_paths()


def test_walks_read_only_the_steps_of_their_roots(spark):
    edges = spark.createDataFrame([(f"v{4 * k + i:04}", f"v{4 * k + 4 + j:04}") for k in range(60) for i in range(4) for j in range(4)] + [("v0005", "v0000"), ("v0001", "v0001")], "src string, dst string")
    roots = spark.createDataFrame([("v0000",), ("none",)], "id string")
    steps = G.steps_within(edges, roots, 3)
    assert steps.count() == steps.distinct().count() == 4 + 16 + 17
    chain = edges.where("dst <> 'v0000'")
    assert sorted(map(tuple, G.count_paths(chain, roots, 3).collect())) == [("none", 1), ("v0000", 64)]
    assert G.paths(chain, roots, 3).count() == 65


def test_letters_are_told_once_and_comments_passed_once(spark, small_dir):
    """sc11_scopes: a text's letters aren't told again for each language; a declaration is tried where one may begin, not at each place of what a comment leaves."""
    plan = QX.query.queries["sc11_scopes"](spark, small_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1 and plan.index("Generate") < plan.index("regexp_replace")
    rust = next(x for x in X.BUILT_IN if x.name == "rust")
    assert X._masked("a /* b\n\n c */ d", rust) == "a     \n\n      d"
    edge = "/***/ fn a() {}\n/*/ fn no() {} */ fn b() {} mod m; fn c() { fn d() {} }struct S;fn e() {}\n  pub fn f() {}\n/* open fn g() {}"
    assert [r[1] for r in X.extract_symbols("a.rs", edge)] == ["a", "b", "m", "c", "d", "S", "e", "f"]
    masked = X._masked(edge, rust)
    places = [0, *(m.end() for m in X._BEFORE_ANCHOR.finditer(masked))]
    for _, _, pattern in X._patterns(rust):
        assert [m.span() for m in X._matches(pattern, masked, places)] == [m.span() for m in pattern.finditer(masked)]
    assert [r[1] for r in X.extract_symbols("a.js", "function f() { return `a ${g(`}`)} \\` $ {`; }\nclass K {}")] == ["f", "K"]


def test_small_tables_of_sources_go_to_all_tasks(spark, small_dir):
    sources = QX._sources(QX.Tables(spark, small_dir))
    assert sources.rdd.getNumPartitions() == 4 and sources.select(F.spark_partition_id()).distinct().count() == 4


def test_changes_of_some_files_at_a_time():
    n = 2 * D.ROWS + 1
    batch = pa.RecordBatch.from_arrays([pa.array([f"p{k}" for k in range(n)]), pa.array(["modified"] * n), pa.array(["a\nb"] * n), pa.array(["a\nc"] * n)], names=["path", "change", "old", "new"])
    out = list(D.change_batches(iter([batch])))
    assert [len(x) for x in out] == [D.ROWS, D.ROWS, 1]
    assert [x["path"] for part in out for x in part.to_pylist()] == [f"p{k}" for k in range(n)]
    assert out[2].to_pylist()[0] == {"path": f"p{n - 1}", "change": "modified", "added_lines": [{"line_no": 2, "line": "c"}], "removed": 1, "diff": " a\n-b\n+c"}


@pytest.mark.parametrize("name", ["j17_df2_raw_changes", "df3_review_findings"])
def test_long_texts_have_whole_diffs(spark, tmp_path, name):
    """texts of over 2,000 lines were taken as all removed and all added."""
    texts = ["\n".join(f"{'TODO' if k % 5 == 0 else 'line'} {k % 7}" for k in range(n)) for n in (2600, 12, 2300)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QP.query.queries[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(QP.query.sql[name]).project(", ".join(got.columns)).fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_common_lines_are_a_tables(monkeypatch):
    """Numbers of bits give the pairs that a whole table gives, whatever rows and masks are held."""
    import random

    r = random.Random(3)
    for n in range(300):
        monkeypatch.setattr(D, "ROWS_HELD", r.choice((2, 3, 64)))
        monkeypatch.setattr(D, "MASK_BYTES", r.choice((1, 1000)))
        a, b = ([str(r.randrange(1 + n % 30)) for _ in range(r.randrange(60))] for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in reversed(range(len(a))):
            for j in reversed(range(len(b))):
                table[i][j] = table[i + 1][j + 1] + 1 if a[i] == b[j] else max(table[i + 1][j], table[i][j + 1])
        pairs, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                pairs.append((i, j))
                i, j = i + 1, j + 1
            elif table[i + 1][j] >= table[i][j + 1]:
                i += 1
            else:
                j += 1
        assert list(D.common_lines(a, b)) == pairs
        assert len(D.matched_lines(a, b)) == table[0][0]


def test_a_refresh_scans_a_text_once(spark, small_dir, monkeypatch):
    """symbols were extracted anew wherever they were read; now each file's once, and touched files' once more."""
    scanned, whole = spark.sparkContext.accumulator(0), X.extract_symbols

    def counted(*given):
        scanned.add(1)
        return whole(*given)

    monkeypatch.setattr(X, "extract_symbols", counted)
    found = QX.query.queries["g10_refresh"](spark, small_dir)
    keys = spark.read.parquet(f"{small_dir}/customer.parquet").select("c_custkey")
    edited = keys.where("c_custkey % 9 = 4 and c_custkey * 3 % 100 <> c_custkey * 7 % 100").count()
    assert found.count() > 0 and edited > 0 and scanned.value == keys.count() + edited
    assert "MapInArrow" not in found._jdf.queryExecution().toString()


def test_edges_of_stored_sites_are_those_of_texts(spark):
    files = [("src/a.rs", "fn callee() {}\n"), ("src/b.rs", "use crate::a::callee;\nfn caller() {\n    callee();\n}\n")]
    sources = spark.createDataFrame(files, "filepath string, content string")
    symbols = X.symbols(sources)
    stored = E.build_edges(symbols, sources.limit(0), sites=E.call_sites(symbols, sources), imports=E.import_names(sources))
    assert sorted(map(repr, stored.collect())) == sorted(map(repr, E.build_edges(symbols, sources).collect()))
