"""Extraction on source files made from customers, and streams over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import diffs as D, edges as E, search as S
from ..operators.lineage import cut
from ..sources import extract as X, manifests as M
from ..streaming import logs as L, run as R
from .base import Registry, Tables

query = Registry()


def _sources(t: Tables, edited: bool = False) -> DataFrame:
    """A file for each customer: an import, a function that calls another customer's, and one that calls the file's first. A ninth is edited to call yet others."""
    k = F.col("c_custkey")
    called = F.when(F.lit(edited) & (k % 9 == 4), k * 3 % 100).otherwise(k * 7 % 100)
    content = F.format_string("use crate::m::c%d;\nfn c%d() {\n    c%d();\n}\n\npub fn d%d(x: u8) -> u8 {\n    c%d();\n}\n", k % 50, k, called, k, k)
    # narrow keys are dealt to all tasks before texts are made of them: a small file would be one task's
    keys = t.customer.select("c_custkey").repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    return keys.select(F.format_string("src/c%d.rs", k).alias("filepath"), content.alias("content"))


_K = "ks AS (SELECT c_custkey AS k, 'src/c' || c_custkey || '.rs' AS filepath, 'use crate::m::c' || (c_custkey % 50) || ';' || chr(10) AS head, 'fn c' || c_custkey || '() {' || chr(10) || '    c' || (c_custkey * 7 % 100) || '();' || chr(10) || '}' || chr(10) || chr(10) AS one, 'pub fn d' || c_custkey || '(x: u8) -> u8 {' || chr(10) || '    c' || c_custkey || '();' || chr(10) || '}' || chr(10) AS two FROM customer)"


@query("sc11_symbols", f"""WITH {_K} SELECT filepath || '::c' || k AS id, 'function' AS kind, length(head)::BIGINT AS start_byte, (length(head || one) - 2)::BIGINT AS end_byte, 2::BIGINT AS start_line, 4::BIGINT AS end_line, sha256(one[:-3]) AS semantic_hash FROM ks
UNION ALL SELECT filepath || '::d' || k, 'function', length(head || one), length(head || one || two) - 1, 6, 8, sha256(two[:-2]) FROM ks""")
def _(t: Tables) -> DataFrame:
    return X.symbols(_sources(t)).select("id", "kind", "start_byte", "end_byte", "start_line", "end_line", "semantic_hash")


#: A file in each language for each document: @N is its number, @T the letters of its whole text, in a comment. With each file go the declarations that it has: name, kind, role and text.
_LANGUAGES = {
    "rs": ("/* @T */\npub struct S@N { a: u8 }\nimpl S@N {\n    pub async fn m@N(&self) -> u8 { let s = \"} fn no() {\"; 1 }\n}\ntrait T@N { fn sig(&self); fn full@N(&self) {} }\n", (
        ("S@N", "struct", "definition", "pub struct S@N { a: u8 }"), ("m@N", "function", "definition", "pub async fn m@N(&self) -> u8 { let s = \"} fn no() {\"; 1 }"),
        ("T@N", "interface", "definition", "trait T@N { fn sig(&self); fn full@N(&self) {} }"), ("full@N", "function", "definition", "fn full@N(&self) {}"))),
    "py": ("# @T\nclass A@N:\n    async def m@N(self):\n        return 1\n", (("A@N", "class", "definition", "class A@N:\n    async def m@N(self):\n        return 1"), ("m@N", "function", "definition", "async def m@N(self):\n        return 1"))),
    "js": ("/* @T */\nexport class A@N { m() {} }\nfunction f@N(a) { return `${g(`}`)}{ @T`; }\n", (("A@N", "class", "definition", "class A@N { m() {} }"), ("f@N", "function", "definition", "function f@N(a) { return `${g(`}`)}{ @T`; }"))),
    "ts": ("/* @T */\nexport class A@N<T extends { id: number }> {\n  private x = { a: 1 };\n  async m@N(o: { a: number }): Promise<void> { if (o) { return; } }\n  sig@N(): void;\n}\nconst api = { start@N() {} };\ninterface I@N { a: string }\n", (
        ("A@N", "class", "definition", "class A@N<T extends { id: number }> {\n  private x = { a: 1 };\n  async m@N(o: { a: number }): Promise<void> { if (o) { return; } }\n  sig@N(): void;\n}"),
        ("m@N", "function", "definition", "async m@N(o: { a: number }): Promise<void> { if (o) { return; } }"), ("start@N", "function", "definition", "start@N() {}"), ("I@N", "interface", "definition", "interface I@N { a: string }"))),
    "go": ("// @T\nfunc (r *R) m@N() int {\n\treturn 1\n}\ntype P@N struct {\n\ta int\n}\n", (("m@N", "function", "definition", "func (r *R) m@N() int {\n\treturn 1\n}"), ("P@N", "struct", "definition", "P@N struct {\n\ta int\n}"))),
    "c": ("/* @T */\n#define OPEN {\nint f@N(int a);\nstatic char *g@N(void) { if (1) { f@N(2); } return \"}\"; }\n", (("f@N", "function", "stub", "int f@N(int a);"), ("g@N", "function", "definition", "static char *g@N(void) { if (1) { f@N(2); } return \"}\"; }"))),
    "cpp": ("// @T\nnamespace n@N {\ntemplate <class T> T twice@N(T a) { return a + a; }\nclass B@N : public A<int> { int x; };\n}\n", (
        ("n@N", "module", "definition", "namespace n@N {\ntemplate <class T> T twice@N(T a) { return a + a; }\nclass B@N : public A<int> { int x; };\n}"), ("twice@N", "function", "definition", "T twice@N(T a) { return a + a; }"), ("B@N", "class", "definition", "class B@N : public A<int> { int x; }"))),
    "java": ("/* @T */\npublic class A@N {\n  A@N() { this(1); }\n  int bare@N(int a) { return a; }\n  Runnable r = new Runnable() { public void run@N() {} };\n  abstract void none@N();\n}\n", (
        ("A@N", "class", "definition", "public class A@N {\n  A@N() { this(1); }\n  int bare@N(int a) { return a; }\n  Runnable r = new Runnable() { public void run@N() {} };\n  abstract void none@N();\n}"),
        ("bare@N", "function", "definition", "int bare@N(int a) { return a; }"), ("run@N", "function", "definition", "public void run@N() {}"), ("none@N", "function", "definition", "abstract void none@N();"))),
}


def _filled(sql: str) -> str:
    return f"replace(replace({sql}, '@N', CAST(doc_id AS VARCHAR)), '@T', letters)"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_SCOPES = ", ".join(f"({_text(extension)}, {_text(content)}, {_text(name)}, {_text(kind)}, {_text(role)}, {_text(own)})" for extension, (content, found) in _LANGUAGES.items() for name, kind, role, own in found)


@query("sc11_scopes", f"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^A-Za-z ]', '', 'g') AS letters FROM documents),
rows AS (SELECT 'd' || doc_id || '.' || extension AS path, {_filled('name')} AS name, kind, role, {_filled('content')} AS content, {_filled('own')} AS own FROM d, (VALUES {_SCOPES}) AS f(extension, content, name, kind, role, own))
SELECT path || '::' || name AS id, kind, role, CAST(strpos(content, own) - 1 AS BIGINT) AS start_byte, CAST(strpos(content, own) - 1 + length(own) AS BIGINT) AS end_byte, sha256(own) AS semantic_hash FROM rows""")
def _(t: Tables) -> DataFrame:
    files = F.explode(F.array(*(F.struct(F.lit(x).alias("extension"), F.lit(content).alias("content")) for x, (content, _) in _LANGUAGES.items()))).alias("file")
    letters = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z ]", "")
    number = F.col("doc_id").cast("string")
    content = F.replace(F.replace(F.col("file.content"), F.lit("@N"), number), F.lit("@T"), F.col("letters"))
    sources = t.documents.select("doc_id", letters.alias("letters")).select("doc_id", "letters", files).select(F.concat(F.lit("d"), number, F.lit("."), "file.extension").alias("filepath"), content.alias("content"))
    return X.symbols(sources, None).select("id", "kind", "role", "start_byte", "end_byte", "semantic_hash")


@query("sc12_audit_names", f"WITH {_K} SELECT filepath, 'def' AS what, 'c' || k AS name FROM ks UNION ALL SELECT filepath, 'def', 'd' || k FROM ks UNION SELECT filepath, 'call', 'c' || k FROM ks UNION SELECT filepath, 'call', 'c' || (k * 7 % 100) FROM ks UNION SELECT filepath, 'call', 'd' || k FROM ks")
def _(t: Tables) -> DataFrame:
    return X.audit_names(_sources(t))


@query("sc13_text_graph", f"WITH {_K} SELECT filepath || '::d' || k AS src, filepath || '::c' || k AS dst FROM ks")
def _(t: Tables) -> DataFrame:
    return X.text_graph(_sources(t))[1].select("src", "dst")


@query("df3_syntax_errors", f"WITH {_K} SELECT 'high' AS severity, 'syntax_error' AS code, filepath AS file, NULL::BIGINT AS line FROM ks WHERE k % 4 = 1 UNION ALL SELECT 'medium', 'missing_tests', NULL, NULL")
def _(t: Tables) -> DataFrame:
    # of the changed files one half loses its last line, with the bracket that closes, the other half gets a comment with one
    before, k = _sources(t), F.regexp_extract("filepath", "([0-9]+)", 1).cast("long")
    cut, noted = F.expr("left(content, length(content) - 2)"), F.concat("content", F.lit("// }\n"))
    after = before.withColumn("content", F.when(k % 4 == 1, cut).when(k % 4 == 3, noted).otherwise(F.col("content")))
    named = [x.select(F.col("filepath").alias("path"), "content") for x in (before, after)]
    return D.review_findings(D.raw_changes(*named), X.syntax_errors(after))


@query("tx10_imports", f"WITH {_K} SELECT filepath, 'crate::m::c' || (k % 50) AS imported FROM ks")
def _(t: Tables) -> DataFrame:
    return E.import_names(_sources(t))


@query("g9_call_edges", f"WITH {_K}, e AS (SELECT filepath || '::c' || k AS src, 'src/c' || (k * 7 % 100) || '.rs::c' || (k * 7 % 100) AS dst, k <> k * 7 % 100 AND (k * 7 % 100) IN (SELECT k FROM ks) AS there, 0.77::DOUBLE AS confidence FROM ks UNION ALL SELECT filepath || '::d' || k, filepath || '::c' || k, true, 0.92 FROM ks) SELECT src, dst, confidence FROM e WHERE there")
def _(t: Tables) -> DataFrame:
    sources = _sources(t)
    return E.call_edges(X.symbols(sources), sources).where("src <> dst").select("src", "dst", "confidence")


def _all_edges(called: str) -> str:
    """SQL of all edges of the files: calls of other files' functions and of the file's own, and what each function's file imports."""
    return f"""WITH {_K}, t AS (SELECT k, filepath, {called} AS called, k % 50 AS used FROM ks),
e AS (SELECT filepath || '::c' || k AS src, 'src/c' || called || '.rs::c' || called AS dst, 'calls' AS kind, 0.77::DOUBLE AS confidence FROM t WHERE called <> k AND called IN (SELECT k FROM ks)
UNION ALL SELECT filepath || '::d' || k, filepath || '::c' || k, 'calls', 0.92 FROM t
UNION ALL SELECT filepath || '::' || x || k, 'src/c' || used || '.rs::c' || used, 'imports', 0.94 FROM t, (VALUES ('c'), ('d')) AS v(x) WHERE used IN (SELECT k FROM ks) AND (x = 'd' OR used <> k))
SELECT * FROM e"""


_EDITED = "CASE WHEN k % 9 = 4 THEN k * 3 % 100 ELSE k * 7 % 100 END"


@query("g9_build_edges", _all_edges("k * 7 % 100"))
def _(t: Tables) -> DataFrame:
    sources = _sources(t)
    return E.build_edges(X.symbols(sources), sources).select("src", "dst", "kind", "confidence")


@query("g10_refresh", _all_edges(_EDITED))
def _(t: Tables) -> DataFrame:
    before, after = _sources(t), _sources(t, edited=True)
    touched = cut(after.join(before, ["filepath", "content"], "left_anti").select("filepath"))
    # texts are scanned once for each of these tables, however often they are read, and of those after only touched files'
    symbols = lambda files: X.symbols(files).select("id", "filepath", "name", "kind", "role", "link_name", "start_byte", "end_byte")
    old = cut(symbols(before))
    new = cut(old.join(touched, "filepath", "left_anti").unionByName(symbols(after.join(touched, "filepath", "left_semi"))))
    sites, imports = cut(E.call_sites(old, before)), cut(E.import_names(before))
    stored = E.build_edges(old, before, sites=sites, imports=imports)
    return E.refresh_edges(stored, new, after, touched, old.join(touched, "filepath", "left_semi"), sites, imports).select("src", "dst", "kind", "confidence")


@query("tx9_contracts", f"WITH {_K} SELECT filepath || '::d' || k AS id, 'x: u8' AS inputs, 'u8' AS output, '' AS effects, false AS may_fail FROM ks UNION ALL SELECT filepath || '::c' || k, '', '', '', false FROM ks")
def _(t: Tables) -> DataFrame:
    sources = _sources(t)
    body = F.substring(F.col("content"), (F.col("start_byte") + 1).cast("int"), (F.col("end_byte") - F.col("start_byte")).cast("int"))
    symbols = X.symbols(sources).join(sources, "filepath").select("id", body.alias("source_text"))
    return S.contracts(symbols).select("id", F.array_join("inputs", ",").alias("inputs"), "output", F.array_join("effects", ",").alias("effects"), "may_fail")


@query("sc3_sc4_manifests", "SELECT lower(replace(n_name, ' ', '-')) AS name, CAST(n_nationkey AS VARCHAR) AS version, 'runtime' AS kind, 'cargo' AS manager FROM nation")
def _(t: Tables) -> DataFrame:
    line = F.format_string('%s = "%d"', F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))), F.col("n_nationkey"))
    cargo = t.nation.agg(F.concat(F.lit("[dependencies]\n"), F.array_join(F.collect_list(line), "\n")).alias("content")).select(F.lit("Cargo.toml").alias("filepath"), "content")
    node = t.spark.createDataFrame([("package.json", '{"dependencies": {"a": "1"}}')], "filepath string, content string")
    return M.dependencies(cargo.union(node)).select("name", "version", "kind", "manager")


def _event_stream(t: Tables) -> DataFrame:
    schema = t.events.schema
    stream = t.spark.readStream.format("parquet").schema(schema).option("pathGlobFilter", "events*.parquet").load(t.sf_dir)
    # an event-time column needs a time zone
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("st1_stream_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(t: Tables) -> DataFrame:
    return R.available_now(_event_stream(t)).groupBy("event_type").agg(F.count("*").alias("n"))


@query("st5_stream_windows", """WITH w AS (SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, strftime(start, '%Y-%m-%d') AS start, n FROM w WHERE n >= 5 AND start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def _(t: Tables) -> DataFrame:
    found = R.available_now(L.edit_alerts(_event_stream(t), "event_type", "1 day", "1 day", 5))
    return found.select("event_type", F.date_format("start", "yyyy-MM-dd").alias("start"), "n")


@query("st10_stream_budgets", "SELECT user_id, CAST(sum(floor(length(coalesce(props, '')) / 4)) AS BIGINT) AS tokens, count(*) FILTER (event_type = 'error') AS hazardous, count(*) AS calls FROM events GROUP BY user_id")
def _(t: Tables) -> DataFrame:
    events = _event_stream(t).select("user_id", F.col("props").alias("input"), (F.col("event_type") == "error").alias("hazard"))
    return R.available_now(L.running_budgets(events, "user_id"), "complete")
