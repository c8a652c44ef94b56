"""Predicates, scalar functions, diffs and renderings on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import adapters as A
from ..functions import paths as P
from ..operators import diffs as D, policy as Y, render as R
from .base import Registry, Tables

query = Registry()

_TOOLS = "['search', 'graph', 'read', 'edit', 'shell', 'workspace', 'context', 'nothing']"
_REQ = f"""requests AS (SELECT o_orderkey AS id, {_TOOLS}[CAST(o_orderkey % 8 AS INT) + 1] AS tool, CASE o_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '../x' WHEN 2 THEN 'src/m' || (o_custkey % 9) || '.rs' WHEN 3 THEN '.state/db' WHEN 4 THEN 'docs/a.md' ELSE 'src/secret/k.pem' END AS path,
 'u' || (o_custkey % 5) AS uri, CASE o_orderkey % 3 WHEN 0 THEN 'ls -l' WHEN 1 THEN 'rm x; ls' ELSE 'curl x' END AS command, o_custkey % 10 = 0 AS is_human FROM orders)"""
_TOOL_LIST = ["search", "graph", "read", "edit", "shell", "workspace", "context", "nothing"]


def _requests(t: Tables) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    path = F.when(c % 6 == 1, "../x").when(c % 6 == 2, F.concat(F.lit("src/m"), (c % 9).cast("string"), F.lit(".rs"))).when(c % 6 == 3, ".state/db").when(c % 6 == 4, "docs/a.md").when(c % 6 == 5, "src/secret/k.pem")
    return t.orders.select(k.alias("id"), F.element_at(F.array(*map(F.lit, _TOOL_LIST)), (k % 8).cast("int") + 1).alias("tool"), path.alias("path"), F.concat(F.lit("u"), (c % 5).cast("string")).alias("uri"), F.when(k % 3 == 0, "ls -l").when(k % 3 == 1, "rm x; ls").otherwise("curl x").alias("command"), (c % 10 == 0).alias("is_human"))


@query("pf5_policy_chain", f"""WITH {_REQ}, r AS (SELECT id, CASE WHEN NOT is_human AND path LIKE '.state/%' THEN 'deny:state' WHEN NOT is_human AND path LIKE '..%' THEN 'deny:sandbox' WHEN NOT is_human AND tool = 'shell' AND contains(command, ';') THEN 'deny:chaining' WHEN NOT is_human AND tool = 'shell' AND split_part(command, ' ', 1) NOT IN ('ls', 'git') THEN 'deny:binary'
 WHEN path LIKE 'src/secret/%' THEN 'deny:blocklist' WHEN path LIKE 'src/%.rs' THEN 'allow:allowlist' WHEN tool = 'edit' AND uri = 'u3' THEN 'deny:protected' WHEN path IS NOT NULL THEN 'deny:strict_path' WHEN tool NOT IN ('search', 'graph', 'workspace') THEN 'deny:strict_tool' ELSE 'allow:strict' END AS r FROM requests) SELECT id, split_part(r, ':', 1) AS decision, split_part(r, ':', 2) AS rule FROM r""")
def _(t: Tables) -> DataFrame:
    return Y.evaluate(_requests(t), "strict", ["src/*.rs"], ["src/secret/*"], ["u3"], [".state"], ["ls", "git"]).select("id", "decision", "rule")


@query("pf6_operation_policy", f"""WITH {_REQ}, r AS (SELECT id, CASE WHEN tool NOT IN ('search', 'graph', 'read', 'workspace') THEN 'deny:ceiling' WHEN tool NOT IN ('search', 'read') THEN 'deny:capability' ELSE 'allow:operation' END AS r FROM requests) SELECT id, split_part(r, ':', 1) AS decision, split_part(r, ':', 2) AS rule FROM r""")
def _(t: Tables) -> DataFrame:
    req = _requests(t).withColumns({"action": F.lit("list"), "session_open": F.lit(False)})
    return Y.evaluate_operations(req, "lite", ["lookup", "read"], session_required=True).select("id", "decision", "rule")


@query("pf7_roles", """WITH r AS (SELECT c_custkey, ['owner', 'editor', 'planner', 'reviewer', 'observer'][CAST(c_custkey % 5 AS INT) + 1] AS role, ['read', 'plan_create', 'plan_review', 'role_bind', 'plan_compare', 'edit'][CAST(c_custkey % 6 AS INT) + 1] AS cap FROM customer)
SELECT c_custkey, role, cap, CASE role WHEN 'owner' THEN true WHEN 'editor' THEN cap <> 'role_bind' WHEN 'planner' THEN cap IN ('read', 'plan_create', 'plan_compare') WHEN 'reviewer' THEN cap IN ('read', 'plan_compare', 'plan_review') ELSE cap = 'read' END AS allowed FROM r""")
def _(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(values)).cast("int") + 1)
    rows = t.customer.select("c_custkey", pick(["owner", "editor", "planner", "reviewer", "observer"]).alias("role"), pick(["read", "plan_create", "plan_review", "role_bind", "plan_compare", "edit"]).alias("cap"))
    return rows.withColumn("allowed", Y.role_allows(F.col("role"), F.col("cap")))


@query("pf8_operations", f"WITH {_REQ} SELECT id, CASE tool WHEN 'search' THEN 'lookup' WHEN 'graph' THEN 'traverse' WHEN 'read' THEN 'read' WHEN 'edit' THEN 'change' WHEN 'shell' THEN 'exec' WHEN 'workspace' THEN 'session' WHEN 'context' THEN 'context' ELSE 'other' END AS op, CASE tool WHEN 'search' THEN 'lookup' WHEN 'graph' THEN 'traverse' WHEN 'read' THEN 'read' WHEN 'edit' THEN 'change.apply' WHEN 'shell' THEN 'exec.task' WHEN 'workspace' THEN 'session.begin' WHEN 'context' THEN 'context' ELSE 'other' END AS capability FROM requests")
def _(t: Tables) -> DataFrame:
    return _requests(t).select("id", Y.operation_of(F.col("tool")).alias("op"), Y.capability_of(F.col("tool")).alias("capability"))


@query("pf9_unexpired", "SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-15'")
def _(t: Tables) -> DataFrame:
    return Y.unexpired(t.events.select("event_id", F.col("ts").alias("expires_at")), F.lit("2024-01-15").cast("timestamp")).withColumnRenamed("expires_at", "ts")


@query("pf10_tool_lists", f"WITH {_REQ} SELECT id, tool NOT IN ('shell') AND tool IN ('search', 'shell', 'read') AS listed, tool NOT IN ('shell') AS open_list FROM requests")
def _(t: Tables) -> DataFrame:
    tool = F.col("tool")
    return _requests(t).select("id", Y.tool_allowed(tool, ["search", "shell", "read"], ["shell"]).alias("listed"), Y.tool_allowed(tool, [], ["shell"]).alias("open_list"))


@query("pf11_redaction", "SELECT event_id, '{\"k\":\"[REDACTED]\"}' AS props FROM events WHERE props IS NOT NULL UNION ALL SELECT event_id, NULL FROM events WHERE props IS NULL")
def _(t: Tables) -> DataFrame:
    return Y.redacted(t.events.select("event_id", "props"), "props", ["k"])


@query("pf12_safe_paths", "WITH p AS (SELECT o_orderkey AS id, ['a/b.rs', '../x', 'a/../b', 'a/../../b', '/etc/x', 'a/.env', 'a/.env.local', 'a/.envx'][CAST(o_orderkey % 8 AS INT) + 1] AS path FROM orders) SELECT id, path IN ('a/b.rs', 'a/../b', 'a/.envx') AS safe FROM p")
def _(t: Tables) -> DataFrame:
    paths = ["a/b.rs", "../x", "a/../b", "a/../../b", "/etc/x", "a/.env", "a/.env.local", "a/.envx"]
    return t.orders.select(F.col("o_orderkey").alias("id"), F.element_at(F.array(*map(F.lit, paths)), (F.col("o_orderkey") % 8).cast("int") + 1).alias("path")).select("id", Y.safe_path(F.col("path")).alias("safe"))


@query("pf13_file_classes", "WITH p AS (SELECT o_orderkey AS id, ['src/a.rs', 'src/tests/a.rs', 'x/test/b.py', 'a_test.py', 'web/a.spec.ts', 'README.md', 'Makefile', 'src\\tests\\b.go'][CAST(o_orderkey % 8 AS INT) + 1] AS path FROM orders) SELECT id, path IN ('src/a.rs', 'a_test.py', 'web/a.spec.ts') AS source, path IN ('src/tests/a.rs', 'x/test/b.py', 'a_test.py', 'web/a.spec.ts', 'src\\tests\\b.go') AS test FROM p")
def _(t: Tables) -> DataFrame:
    paths = ["src/a.rs", "src/tests/a.rs", "x/test/b.py", "a_test.py", "web/a.spec.ts", "README.md", "Makefile", "src\\tests\\b.go"]
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.element_at(F.array(*map(F.lit, paths)), (F.col("o_orderkey") % 8).cast("int") + 1).alias("path"))
    return rows.select("id", Y.is_source_file(F.col("path")).alias("source"), Y.is_test_file(F.col("path")).alias("test"))


@query("f_scalar_functions", """SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_-]', '', 'g') AS clean_id, regexp_replace(url, '[^A-Za-z0-9_]', '_', 'g') AS diagram_id, regexp_extract(url, '^(.*)/[^/]*$', 1) AS up, regexp_extract(url, '([^/]*)$', 1) AS leaf, sha256(url) AS digest,
least(greatest(page_id / 100.0, 0.5), 1.5)::DOUBLE AS clamped, array_to_string(list_sort(list_distinct([page_id % 3, page_id % 2, 1])), ',') AS small_set, map_extract(map(['a', 'b'], [page_id, page_id + 1]), 'b')[1] AS got FROM pages""")
def _(t: Tables) -> DataFrame:
    """F1, F2, F5-F8, F10, F11."""
    u, k = F.col("url"), F.col("page_id")
    numbers = F.array_distinct(F.array_sort(F.array(k % 3, k % 2, F.lit(1).cast("long"))))
    return t.pages.select("page_id", P.sanitize_id(u).alias("clean_id"), P.safe_diagram_id(u).alias("diagram_id"), P.parent(u).alias("up"), P.leaf(u, "[/]").alias("leaf"), P.content_hash(u).alias("digest"), P.clamp(k / 100.0, 0.5, 1.5).cast("double").alias("clamped"), F.array_join(numbers.cast("array<string>"), ",").alias("small_set"), F.element_at(F.create_map(F.lit("a"), k, F.lit("b"), k + 1), "b").alias("got"))


@query("f6_f9_paths_and_time", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds, CASE WHEN user_id % 2 = 0 THEN 'src/u' ELSE 'x.rs' END AS module, props::JSON ->> '$.k' AS k FROM events")
def _(t: Tables) -> DataFrame:
    path = F.when(F.col("user_id") % 2 == 0, "src/u/x.rs").otherwise("x.rs")
    return t.events.select("event_id", F.unix_timestamp("ts").alias("seconds"), P.module_of(path).alias("module"), F.get_json_object("props", "$.k").alias("k"))


@query("scope_of_ids", "SELECT doc_id, source AS scope FROM documents")
def _(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", P.scope_of(F.concat(F.lit("@"), "source", F.lit("::"), F.col("doc_id").cast("string"))).alias("scope"))


#: Lines with their numbers, so that no two of a document are equal; some go, some change, some get a new one after them.
_EDITS = """old_lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS line FROM documents),
edits AS (SELECT doc_id, n, n || ' ' || line AS line, CASE (doc_id * 31 + n * 7) % 11 WHEN 0 THEN 'goes' WHEN 1 THEN 'changes' WHEN 2 THEN 'more' ELSE 'stays' END AS act, CASE doc_id % 3 WHEN 0 THEN 'TODO ' WHEN 1 THEN 'x.unwrap() ' ELSE 'new ' END || n AS fresh FROM old_lines),
gaps AS (SELECT *, act IN ('stays', 'more') AS kept, count(*) FILTER (act IN ('stays', 'more')) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM edits),
marked AS (SELECT doc_id, gap, 2 AS what, n, ' ' || line AS shown FROM gaps WHERE kept UNION ALL SELECT doc_id, gap, 0, n, '-' || line FROM gaps WHERE NOT kept UNION ALL SELECT doc_id, gap, 1, n, '+' || fresh FROM gaps WHERE act = 'changes' UNION ALL SELECT doc_id, gap + 1, 1, n, '+' || fresh FROM gaps WHERE act = 'more'),
new_lines AS (SELECT doc_id, what, shown, row_number() OVER (PARTITION BY doc_id ORDER BY gap, what, n) AS place FROM marked WHERE what > 0),
changed AS (SELECT doc_id, 'src/d' || doc_id || '.rs' AS path, string_agg(shown, chr(10) ORDER BY gap, what, n) AS diff, count(*) FILTER (what = 1) AS added, count(*) FILTER (what = 0) AS removed FROM marked GROUP BY doc_id HAVING count(*) FILTER (what < 2) > 0)"""


def _versions(t: Tables) -> tuple[DataFrame, DataFrame]:
    lines = F.split("text", "\n", -1)
    numbered = F.transform(lines, lambda x, k: F.struct((k + 1).cast("long").alias("n"), F.concat((k + 1).cast("string"), F.lit(" "), x).alias("line")))
    path, doc = F.concat(F.lit("src/d"), F.col("doc_id").cast("string"), F.lit(".rs")).alias("path"), F.col("doc_id")

    def edited(x: F.Column) -> F.Column:
        act, fresh = (doc * 31 + x["n"] * 7) % 11, F.concat(F.when(doc % 3 == 0, "TODO ").when(doc % 3 == 1, "x.unwrap() ").otherwise("new "), x["n"].cast("string"))
        return F.when(act == 0, F.array().cast("array<string>")).when(act == 1, F.array(fresh)).when(act == 2, F.array(x["line"], fresh)).otherwise(F.array(x["line"]))

    rows = t.documents.where("text is not null").select(path, "doc_id", numbered.alias("l"))
    return rows.select("path", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("content")), rows.select("path", F.array_join(F.flatten(F.transform("l", edited)), "\n").alias("content"))


@query("j17_df2_raw_changes", f"WITH {_EDITS} SELECT path, 'modified' AS change, added, removed FROM changed")
def _(t: Tables) -> DataFrame:
    return D.raw_changes(*_versions(t)).select("path", "change", F.size("added_lines").cast("long").alias("added"), "removed")


@query("df1_unified_diff", f"WITH {_EDITS} SELECT path, diff FROM changed")
def _(t: Tables) -> DataFrame:
    return D.raw_changes(*_versions(t)).select("path", "diff")


@query("df3_review_findings", f"""WITH {_EDITS}, fresh AS (SELECT doc_id, 'src/d' || doc_id || '.rs' AS file, shown, place AS line FROM new_lines WHERE what = 1)
SELECT 'low' AS severity, 'todo_marker' AS code, file, line FROM fresh WHERE regexp_matches(shown, 'TODO|FIXME|XXX') UNION ALL SELECT 'medium', 'risky_api', file, line FROM fresh WHERE contains(shown, 'unwrap(')
UNION ALL SELECT 'medium', 'large_change', path, NULL FROM changed WHERE added + removed > 300 UNION ALL SELECT 'medium', 'missing_tests', NULL, NULL""")
def _(t: Tables) -> DataFrame:
    return D.review_findings(D.raw_changes(*_versions(t)))


@query("t5_largest_changes", f"WITH {_EDITS} SELECT path, added + removed AS changed_lines FROM changed ORDER BY changed_lines DESC, path LIMIT 20")
def _(t: Tables) -> DataFrame:
    return D.largest_changes(D.raw_changes(*_versions(t)), 20).select("path", F.col("changed_lines").cast("long").alias("changed_lines"))


@query("rd1_read_by_uri", "SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN string_split(text, chr(10))[1] ELSE text END AS body FROM documents")
def _(t: Tables) -> DataFrame:
    symbols = t.documents.select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("filepath"), F.lit(0).cast("long").alias("start_byte"), F.octet_length("text").cast("long").alias("end_byte"), (F.col("doc_id") % 3).alias("verbosity"))
    sources = t.documents.select(F.col("doc_id").cast("string").alias("filepath"), F.col("text").alias("content"))
    return R.read_symbols(symbols, sources).select("id", "body")


@query("rd2_mermaid", f"WITH {A.TRANSITIONS}, l AS (SELECT '  ' || regexp_replace(src, '[^A-Za-z0-9_]', '_', 'g') || ' --> ' || regexp_replace(dst, '[^A-Za-z0-9_]', '_', 'g') AS line FROM transitions) SELECT 'graph TD' || chr(10) || string_agg(line, chr(10) ORDER BY line) AS diagram FROM l")
def _(t: Tables) -> DataFrame:
    return R.mermaid(A.transitions(t))


@query("rd2_ascii", f"WITH {A.TRANSITIONS}, l AS (SELECT src || ' -> ' || dst AS line FROM transitions) SELECT string_agg(line, chr(10) ORDER BY line) AS diagram FROM l")
def _(t: Tables) -> DataFrame:
    return R.ascii_edges(A.transitions(t))


@query("rd3_flamegraph", "WITH w AS (SELECT c_mktsegment AS frame, count(*) AS weight FROM customer GROUP BY 1) SELECT frame, weight, repeat('#', CAST(ceil(40.0 * weight / max(weight) OVER ()) AS INT)) AS bar FROM w")
def _(t: Tables) -> DataFrame:
    return R.flamegraph(t.customer.groupBy(F.col("c_mktsegment").alias("frame")).agg(F.count("*").alias("weight")))
