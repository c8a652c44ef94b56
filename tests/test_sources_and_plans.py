from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import diffs as D, logs as L, policy as Y, render as R
from sparkloom.plans import dag as P, script as Q
from sparkloom.sources import extract as X, manifests as M, remote, scan as C, sinks as K


def test_scan(spark, tmp_path):
    for name, text in {"src/a.rs": "fn a() {}", "src/b.py": "x = 1", "notes.txt": "x", "target/x.rs": "fn x() {}", ".hidden/h.rs": "", "src/gen/g.rs": "", "Cargo.toml": "[dependencies]\nserde = \"1\"\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = C.scan(spark, str(tmp_path), ignored=["gen/"])
    assert sorted(r["filepath"] for r in found.collect()) == ["src/a.rs", "src/b.py"]
    assert [r["filepath"] for r in C.listing(found, "src/a").collect()] == ["src/a.rs"]
    everything = C.scan(spark, str(tmp_path), extensions=())
    assert [(r["name"], r["version"], r["manager"]) for r in M.dependencies(everything).collect()] == [("serde", "1", "cargo")]
    assert C.delta(found, found).count() == 0
    assert C.delta(found, found.where("filepath = 'src/a.rs'")).count() == 1


def test_excluded_dirs(spark, tmp_path):
    for name in ("package.json", "dist/a.js", "src/a.js", "src/dist.js", "src/dist/b.js", "target/c.js", "lib/go.mod", "vendor/d.js"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    files = C.scan(spark, str(tmp_path), ())
    assert {r["dir"] for r in C.excluded_dirs(files).collect()} == {"node_modules", "dist", "build"}
    assert {r["filepath"] for r in files.collect()} == {"package.json", "src/a.js", "src/dist.js", "target/c.js", "lib/go.mod", "vendor/d.js"}


def test_manifests():
    assert M.parse("pyproject.toml", '[project]\ndependencies = ["a>=1", "b[x]"]\n[tool.poetry.dependencies]\npython = "3"\nc = "^2"\n') == [("a", ">=1", "runtime"), ("b", None, "runtime"), ("c", "^2", "runtime")]
    assert M.parse("package.json", '{"dependencies": {"a": "1"}, "devDependencies": {"b": "2"}}') == [("a", "1", "runtime"), ("b", "2", "dev")]
    assert M.parse("go.mod", "module m\nrequire (\n\texample.com/x v1.2.3\n)\n") == [("example.com/x", "v1.2.3", "runtime")]
    assert M.parse("Cargo.toml", "not toml [") == []


def test_extraction():
    python = "import os\n\nclass A:\n    def f(self):\n        return g()\n\ndef g():\n    pass\n"
    found = {x[1]: x for x in X.extract_symbols("a.py", python)}
    assert {k: (v[2], v[5], v[6]) for k, v in found.items()} == {"A": ("class", 3, 5), "f": ("function", 4, 5), "g": ("function", 7, 8)}
    assert python.encode()[found["g"][3] : found["g"][4]].decode() == "def g():\n    pass"
    assert {x[1]: (x[5], x[6]) for x in X.extract_symbols("a.py", python + "x = (\n")} == {"A": (3, 5), "f": (4, 5), "g": (7, 8)}  # doesn't parse
    js = {x[1]: x[2] for x in X.extract_symbols("a.js", "export function p() {\n}\nconst q = (x) => x\nclass R {}\n")}
    assert js == {"p": "function", "q": "function", "R": "class"}
    assert X.extract_symbols("a.txt", "fn x() {}") == []


def spans(path, text):
    return {x[1]: (x[2], x[8], text.encode()[x[3] : x[4]].decode()) for x in X.extract_symbols(path, text)}


def test_extraction_by_brackets():
    rust = 'struct U;\n// fn no() {}\nfn a<\'x>(p: [u8; 2],\n  q: &\'x str) -> u8 { let s = "} é fn no2() {"; let c = \'}\'; 1 }\npub(crate) async fn b() {} fn c() { /* } */ }\nlet r = r#"fn d() { "#;\ntrait T { fn sig(&self); fn full(&self) {} }\n'
    found = spans("x.rs", rust)
    assert set(found) == {"U", "a", "b", "c", "T", "full"} and found["U"] == ("struct", "definition", "struct U;")
    assert found["a"][2].startswith("fn a<'x>") and found["a"][2].endswith("1 }") and found["b"][2] == "pub(crate) async fn b() {}" and found["c"][2] == "fn c() { /* } */ }"
    assert found["T"][0] == "interface" and found["T"][2].endswith("{} }")
    c = spans("x.c", "int f(int a, char *b);\nstatic int *g(void)\n{\n  return f(1, \"{\");\n}\ntypedef struct S { int x; } S;\n")
    assert c == {"f": ("function", "stub", "int f(int a, char *b);"), "g": ("function", "definition", 'static int *g(void)\n{\n  return f(1, "{");\n}'), "S": ("struct", "definition", "struct S { int x; }")}
    ts = spans("x.ts", "export default function f(a: string) { return `}` }\nexport const q = async (x) => {\n  x }\nconst z = y => y + 1\nexport interface I { a: number }\ndeclare function d(): void;\n")
    assert {k: v[:2] for k, v in ts.items()} == {"f": ("function", "definition"), "q": ("function", "definition"), "z": ("function", "definition"), "I": ("interface", "definition"), "d": ("function", "stub")}
    assert ts["f"][2].startswith("function f") and ts["q"][2].endswith("x }") and ts["z"][2] == "const z = y => y + 1"
    java = spans("X.java", "public class X {\n  private static int m(int a) { return 1; }\n  public abstract void n();\n}\n")
    assert java["m"] == ("function", "definition", "private static int m(int a) { return 1; }") and java["n"][2] == "public abstract void n();" and java["X"][2].endswith("}")
    go = spans("x.go", "func (r *R) m() int {\n\treturn 1\n}\ntype P struct {\n\tq struct { a int }\n}\n")
    assert go["m"][2].endswith("}") and go["P"][2].startswith("P struct") and set(go) == {"m", "P"}
    for path in ("x.rs", "x.c", "x.ts", "x.py", "x.go", "x.java", "x.cpp"):
        for text in ("", "{", "}", "fn a(", "int f(", "def f(:\n  x", "class", "\ud800 fn a() {", "'" * 50, "func f() { \"", "\x00"):
            assert all(0 <= x[3] <= x[4] for x in X.extract_symbols(path, text)) and X.count_syntax_errors(path, text) >= 0
    assert [X.count_syntax_errors("a.rs", x) for x in ("fn a() {}", "fn a() {", "fn a(]) {}", '// }\n"{"')] == [0, 1, 1, 0] and X.count_syntax_errors("a.py", "def f(:") == 1 and X.count_syntax_errors("a.md", "(") == 0


def test_declarations_by_scope():
    """Counted by hand: what stands in classes, objects, templates, constants and namespaces."""
    ts = spans("a.ts", """import { x } from 'y';
@Injectable({ a: 1 })
export class Store<T extends { id: string }> extends Base<T> {
  private readonly map = new Map<string, T>();
  state: { a: number } = { a: 1 }
  constructor(private db: Db) { super(); }
  @Input() static async load<K>(id: string, o: { deep: boolean }): Promise<{ ok: boolean }> {
    if (id) { return fetchIt(`${id ? `}` : { a: 1 }.a}{`); }
    function inner() { return /[/}]{/.test(id); }
  }
  get size(): number { return this.map.size; }
  get(id: string) { return this.map.get(id) }
  *walk() { yield 1; }
  declared(a: string): void;
  handler = (e) => { e.stop(); };
  abstract none(): void
  last() {}
}
const api = { start() { go(); }, async stop(now = true) {}, plain: function named() {}, 'quoted'() {} };
type Id = { a: string } | { b: number };
namespace Inner { export function deep() {} }
const f = function notDeclared() {};
let Klass = class { inClass() {} };
switch (x) { case 1: function cased() {} }
""")
    assert {k: v[0] for k, v in ts.items()} == {"Store": "class", "constructor": "function", "load": "function", "inner": "function", "size": "function", "get": "function", "walk": "function", "last": "function", "start": "function", "stop": "function", "Id": "interface", "deep": "function", "inClass": "function", "cased": "function"}
    assert ts["load"][2].startswith("static async load<K>") and ts["load"][2].endswith("test(id); }\n  }") and ts["size"][2] == "get size(): number { return this.map.size; }" and ts["stop"][2] == "async stop(now = true) {}"
    assert ts["Store"][2].startswith("class Store") and ts["Store"][2].endswith("last() {}\n}") and ts["Id"][2] == "type Id = { a: string } | { b: number };"
    js = spans("a.js", "class A { m() {} }\nfunction f() {\n  return `${g({a: `}`})}`;\n}\nvar r = a / b; function h() { x = 1 / 2 }\n")
    assert {k: v[0] for k, v in js.items()} == {"A": "class", "f": "function", "h": "function"}  # of scripts' classes the members are no symbols
    java = spans("A.java", """package p;
@Deprecated
public class A<T> extends B<T> implements C {
  static { init(); }
  private Map<String, List<T>> map = new HashMap<>();
  A() { this(1); }
  int bare(int a) { return a; }
  @Override public <R> R generic(Map<R, ? super T> m) throws IOException, X { Runnable r = new Runnable() { public void run() { if (a) {} } }; return null; }
  abstract void none();
  String text = "void no() {";
  Object o = call(1);
  int[] rows()[] { return null; }
  enum Kind { ONE(1) { int own() { return 1; } }, TWO; private final int n = 1; Kind next() { return TWO; } }
  interface Part { void go(); default int size() { return 0; } }
  class Nested { java.util.List<String> far() { while (x()) { y(); } return null; } }
}
""")
    assert {k: v[0] for k, v in java.items()} == {"A": "class", "bare": "function", "generic": "function", "run": "function", "none": "function", "rows": "function", "Kind": "class", "own": "function", "next": "function", "Part": "interface", "go": "function", "size": "function", "Nested": "class", "far": "function"}
    assert java["bare"][2] == "int bare(int a) { return a; }" and java["generic"][2].startswith("@Override public <R> R generic") and java["go"][2] == "void go();" and java["A"][2].startswith("public class A<T>")
    cpp = spans("a.cpp", """#define X(a) { a
namespace one { namespace two {
template <class T, typename U> T twice(T a) { return a + a; }
static inline int add(int a, int b) noexcept { return a + b; }
class Box : public Base<int> { int x; void inside() { add(1, 2); } };
}}
void Box::outside() {}
extern "C" { int from_c(void); }
enum class Color { RED };
int value = compute(3);
struct P { int x; };
const char *text() { return R"x(} int no() { )x"; }
int main() { if (add(1, 2)) { struct Local { int y; } l; } }
""")
    assert {k: v[:2] for k, v in cpp.items()} == {"one": ("module", "definition"), "two": ("module", "definition"), "twice": ("function", "definition"), "add": ("function", "definition"), "Box": ("class", "definition"), "from_c": ("function", "stub"), "P": ("struct", "definition"), "text": ("function", "definition"), "main": ("function", "definition"), "Local": ("struct", "definition")}
    assert [X.count_syntax_errors("a.ts", x) for x in ("`${a ? `}` : 1}`", "`${a", "f(/[(]/)", "`}{`")] == [0, 1, 0, 0]



def test_language_packages(spark):
    rows = spark.createDataFrame([("kotlin", ["kt"], "function", r"fun\s+(?P<name>\w+)", "skip"), ("kotlin", ["kts"], "class", r"class\s+(?P<name>\w+)", "definition")], "name string, extensions array<string>, kind string, pattern string, bodiless string")
    files = spark.createDataFrame([("a.kt", "class A {\n  fun f() { }\n}\n"), ("b.rs", "fn g() {}"), ("c.xx", "fun h() {}")], "filepath string, content string")
    found = X.symbols(files, packages=X.language_packages(rows)).collect()
    assert sorted((r["id"], r["kind"], r["role"]) for r in found) == [("a.kt::A", "class", "definition"), ("a.kt::f", "function", "definition"), ("b.rs::g", "function", "definition")]


def test_text_graph(spark):
    s = spark.createDataFrame([("a.rs", "fn one() {\n    two();\n}\npub fn two() {}\ndef three():\n    none()\n")], "filepath string, content string")
    nodes, edges = X.text_graph(s)
    assert sorted(r["id"] for r in nodes.collect()) == ["a.rs::one", "a.rs::three", "a.rs::two"]
    # the scan looks for the name before a bracket anywhere, so none( holds one(
    assert sorted((r["src"], r["dst"], r["confidence"]) for r in edges.collect()) == [("a.rs::one", "a.rs::two", 0.55), ("a.rs::three", "a.rs::one", 0.55)]


def test_sinks(spark, tmp_path):
    rows = spark.range(10).withColumnRenamed("id", "filepath")
    assert K.compact_if_large(rows.limit(1), 1000, str(tmp_path))["rows"] == [{"filepath": 0}]
    stub = K.compact_if_large(rows, 10, str(tmp_path))
    assert stub["stub"] and spark.read.parquet(stub["path"]).count() == 10
    K.append(rows, f"{tmp_path}/log", "json")
    K.append(rows, f"{tmp_path}/log", "json")
    assert spark.read.json(f"{tmp_path}/log").count() == 20
    K.truncate(spark, f"{tmp_path}/t", "a int")
    assert spark.read.parquet(f"{tmp_path}/t").count() == 0


def test_peers():
    public, private = (lambda _: ["93.184.216.34"]), (lambda _: ["93.184.216.34", "10.0.0.1"])
    assert remote.allowed_peer("https://peer.example", public) and not remote.allowed_peer("https://peer.example", private)
    assert not remote.allowed_peer("ftp://peer.example", public) and not remote.allowed_peer("nothing", public)


@pytest.mark.parametrize("old,new", [("", "a"), ("a\nb\nc", "x\na\nb\nc"), ("a\nb\nc\nd", "a\nc\nb\nd"), ("a\na\nb", "b\na\na"), ("x", ""), ("same", "same")])
def test_diffs(old, new):
    added, removed = D.added_removed(old, new)
    kept = len(D.split_lines(new)) - len(added)
    assert kept == len(D.split_lines(old)) - removed
    text = D.unified(old, new).split("\n") if D.unified(old, new) else []
    assert [x[1:] for x in text if x[0] != "+"] == D.split_lines(old) and [x[1:] for x in text if x[0] != "-"] == D.split_lines(new)


def test_diff_beyond_the_table():
    a, b = [str(k) for k in range(30)], [str(k) for k in range(29, -1, -1)]
    assert len(D.matched_lines(a, b, most_cells=10)) == 0
    old, new = [f"l{k}" for k in range(3000)], [f"l{k}" for k in range(3000) if k % 100 != 50] + ["end"]
    new[500:500] = [f"more{k}" for k in range(10)]
    text = D.unified("\n".join(old), "\n".join(new)).split("\n")
    assert [x[1:] for x in text if x[0] != "+"] == old and [x[1:] for x in text if x[0] != "-"] == new and sum(x[0] != " " for x in text) == 30 + 11
    assert D.realigned_lines(["a"] + ["x"] * 30 + ["b"], ["b", "c"]) == [] and D.realigned_lines(["a", "b"], ["b"]) == [(1, 0)]


def test_diagnostics_and_pages(spark):
    d = spark.createDataFrame([(1, "m", 1, 1, "error", "syntax"), (2, "m", 1, 1, "error", "semantic"), (3, "n", 1, 1, "error", "syntax")], "seq int, message string, line int, column int, severity string, source string")
    assert sorted(r["source"] for r in L.dedup_diagnostics(d).collect()) == ["semantic", "syntax"]
    assert [r["seq"] for r in L.paginate(d, ["seq"], 1, 2).collect()] == [2, 3]


def test_chain(spark):
    log = L.chain(spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "by string, seq int, operation string"), ["seq", "operation"], "by")
    assert L.verify_chain(log, ["seq", "operation"], "by").first()["valid"]
    forged = log.withColumn("operation", F.when(F.col("seq") == 2, "z").otherwise(F.col("operation")))
    assert L.verify_chain(forged, ["seq", "operation"], "by").first()["first_bad"] == 2


def test_stacks(spark):
    stacks = L.parse_folded(spark.createDataFrame([("a;b 2",), ("a;c 1",)], "line string"))
    assert {r["frame"]: r["weight"] for r in L.frame_weights(stacks).collect()} == {"a": 3, "b": 2, "c": 1}
    document = json.loads(R.speedscope(stacks).first()["document"])
    assert [x["name"] for x in document["shared"]["frames"]] == ["a", "b", "c"] and sorted(document["profiles"][0]["weights"]) == [1, 2]


def test_redaction():
    assert Y.redact({"code": 1, "a": [{"nonce": "x", "b": 2}]}) == {"code": "[REDACTED]", "a": [{"nonce": "[REDACTED]", "b": 2}]}


def test_reading(spark):
    s = spark.createDataFrame([("a.py", 0, 8, 1, "i"), ("b.py", 0, 8, 2, "j"), ("a.py", 0, 99, 2, "k")], "filepath string, start_byte long, end_byte long, verbosity int, id string")
    files = spark.createDataFrame([("a.py", "def f():\n    pass\n")], "filepath string, content string")
    found = {r["id"]: (r["body"], r["error"]) for r in R.read_symbols(s, files).collect()}
    assert found == {"i": ("def f():", None), "j": (None, "file not found"), "k": (None, "span beyond the file")}
    o = spark.createDataFrame([("a", "f", "x", 1, 5), ("a", "f", "y", 7, 9)], "filepath string, name string, id string, start_line int, end_line int")
    wanted = spark.createDataFrame([("a", "f", 8)], "filepath string, name string, line int")
    assert R.resolve_overloads(o, wanted).first()["id"] == "y"


def tools(spark):
    t, calls = P.Tools(), []

    @t.register("search")
    def _(query, limit=3, **_):
        calls.append(query)
        return {"symbols": [{"id": f"{query}{k}"} for k in range(limit)]}

    @t.register("flaky")
    def _(**_):
        calls.append("flaky")
        if calls.count("flaky") < 2:
            raise RuntimeError("once")
        return 1

    return t, calls


def test_plans(spark):
    t, calls = tools(spark)
    nodes = [P.Node("follow", "search", {"query": "$seed.symbols[0].id"}, ("seed", "missing")), P.Node("seed", "search", {"query": "a"}), P.Node("f", "flaky", {}, ("seed",), retry_limit=1)]
    run = P.execute(nodes, t)
    assert [n.id for n in P.order(nodes)][0] == "seed" and calls[:2] == ["a", "a0"] and run.status == "ok"
    assert [x["status"] for x in run.log if x["node"] == "f"] == ["failed", "ok"] and run.table(spark).count() == 4
    assert P.validate([P.Node("a", "search"), P.Node("a", "search")]) and P.validate([P.Node("a", "search", output_limit=2 << 20)])
    with pytest.raises(ValueError):
        P.order([P.Node("a", "x", {}, ("b",)), P.Node("b", "x", {}, ("a",))])
    assert P.simulate([P.Node("a", "edit")])["warnings"] and P.can_approve("ok", "ok", "s", "s") == (True, "")
    assert not P.can_approve("ok", "ok", "s", "t")[0]
    assert P.resolve({"x": "$a.b[1]", "y": "is $a.b[0]!"}, {"a": {"b": [1, 2]}}) == {"x": 2, "y": "is 1!"} and P.substitute("${a}-${b}", {"a": 1}) == "1-${b}"


def test_table_function(spark):
    class Words:
        def eval(self, text: str):
            for k, word in enumerate((text or "").split()):
                yield k, word

    P.register_table_function(spark, "words_of", Words, "k int, word string")
    found = spark.sql("SELECT x.id, w.k, w.word FROM VALUES (1, 'a b'), (2, NULL), (3, 'c') AS x(id, text), LATERAL words_of(x.text) AS w")
    assert sorted(tuple(r) for r in found.collect()) == [(1, 0, "a"), (1, 1, "b"), (3, 0, "c")]

    class Slow:
        def eval(self, n: int):
            import time

            for k in range(n):
                time.sleep(0.01)
                yield k, "x" * 10

    P.register_table_function(spark, "few_words", Words, "k int, word string", most_bytes=100)
    assert spark.sql("SELECT * FROM few_words('a b')").count() == 2
    with pytest.raises(Exception, match="over 100 bytes"):
        spark.sql("SELECT * FROM few_words(repeat('word ', 99))").collect()
    P.register_table_function(spark, "slow_words", Slow, "k int, word string", seconds=0.05)
    with pytest.raises(Exception, match="over 0.05 seconds"):
        spark.sql("SELECT * FROM slow_words(1000)").collect()


def test_scripts(spark):
    t, calls = tools(spark)
    script = Q.parse('#@explain finds things\nuse profile careful\narg limit: int = 2\narg name\nlet q = "x$name"\nsequence s {\n  search query=$q limit=$limit // go\n}\nlet first = $last.symbols[0].id\n')
    assert script.metadata == {"profile": "careful"} and script.notes == {"explain": ["finds things"]}
    assert Q.run(script, t, {"name": "y"})["first"] == "xy0"
    assert [n.args for n in Q.compile_plan(script, {"name": "y"})] == [{"query": "xy", "limit": 2}]
    with pytest.raises(Q.ScriptError):
        Q.bind(script, {})
    with pytest.raises(Q.ScriptError):
        Q.compile_plan(Q.parse("parallel { search query=a }"))
    with pytest.raises(Q.Aborted):
        Q.run(Q.parse('abort "no"'), t)
    assert Q.parse('call a=[1, -2.5, {k: true}] b=null').body[0]["named"] == {"a": [1, -2.5, {"k": True}], "b": None}
    undone = []
    with pytest.raises(KeyError):
        Q.run(Q.parse("atomic step {\n nothing\n}"), t, {}, undone.append)
    assert undone == ["step"] and Q.targets(Q.parse("edit uri=a::b\nread path=c")) == ["a::b", "c"]


def test_search_through_an_index(spark, tmp_path):
    from sparkloom.operators import search as S

    names = ["a a a", "a a b", "ab a", "parse file", "file parse", "Parse_files now", "", None, "parse"]
    symbols = spark.createDataFrame([(f"i{k}", n, f"src/parse/f{k}.rs", "function") for k, n in enumerate(names)], "id string, name string, filepath string, kind string")
    S.write_index(symbols, f"file://{tmp_path}/index")
    for query in ("a a", "a", "parse fil", "parse", "src parse f", "rs", "a a a a"):
        want = [(r["id"], r["score"]) for r in S.search_ranked(symbols, query).collect()]
        assert [tuple(r) for r in S.search_index(spark, f"file://{tmp_path}/index", query).collect()] == want, query
    assert S.search_index(spark, f"file://{tmp_path}/index", " - ").count() == 0
    none = S.symbol_search(symbols, "zz", 9, peers=symbols.limit(1).withColumn("score", F.lit(1.0))).collect()
    assert [(r["provenance"], r["coverage_state"]) for r in none] == [("external", "full")]
