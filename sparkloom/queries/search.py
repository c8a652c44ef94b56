"""Retrieval on documents as symbols, and on traces made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import adapters as A
from ..operators import search as S
from .base import Registry, Tables

query = Registry()

_DOCS = "docs AS (SELECT CAST(doc_id AS VARCHAR) AS id, text AS name, source AS filepath, lang AS kind, regexp_extract_all(lower(text), '[a-z0-9]+') AS a, regexp_extract_all(lower(source), '[a-z0-9]+') AS b FROM documents)"


def _bm25(words: list[str], docs: str = "docs") -> str:
    """SQL of all documents' BM25 for a phrase whose last word is a prefix."""
    at = lambda x: " AND ".join([f"{x}[i + {k}] = '{w}'" for k, w in enumerate(words[:-1])] + [f"starts_with({x}[i + {len(words) - 1}], '{words[-1]}')"])
    count = lambda x: f"len(list_filter(range(1, len({x}) + 1 - {len(words) - 1}), lambda i: {at(x)}))"
    return f"""tfs AS (SELECT *, {count('a')} + {count('b')} AS tf, len(a) + len(b) AS dl FROM {docs}),
facts AS (SELECT count(*) AS n, avg(dl) AS avgdl, count(*) FILTER (tf > 0) AS df FROM tfs),
scored AS (SELECT id, filepath, kind, round(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)), 4) AS score FROM tfs, facts WHERE tf > 0)"""


@query("tx1_bm25_topk", f"WITH {_DOCS}, {_bm25(['the', 'of'])} SELECT id, filepath, kind, score FROM scored ORDER BY score DESC, id LIMIT 50")
def _(t: Tables) -> DataFrame:
    return S.search_ranked(A.documents_as_symbols(t), "the of").select("id", "filepath", "kind", "score")


@query("tx1_postings_topk", f"WITH {_DOCS}, {_bm25(['the', 'of'])} SELECT id, score FROM scored ORDER BY score DESC, id LIMIT 50")
def _(t: Tables) -> DataFrame:
    symbols = A.documents_as_symbols(t)
    return S.search_postings(S.index_rows(symbols), S.index_facts(symbols), "the of")


@query("t1_single_term_topk", f"WITH {_DOCS}, {_bm25(['licens'])} SELECT id, filepath, kind, score FROM scored ORDER BY score DESC, id LIMIT 10")
def _(t: Tables) -> DataFrame:
    return S.search_ranked(A.documents_as_symbols(t), "LICENS", 10).select("id", "filepath", "kind", "score")


@query("t2_empty_query", "SELECT CAST(doc_id AS VARCHAR) AS id, 0.0::DOUBLE AS score FROM documents ORDER BY id LIMIT 50")
def _(t: Tables) -> DataFrame:
    return S.search_ranked(A.documents_as_symbols(t), " ").select("id", "score")


@query("tx2_substring_fallback", "SELECT CAST(doc_id AS VARCHAR) AS id, 0.0::DOUBLE AS score FROM documents WHERE contains(lower(text), 'cense, ver') ORDER BY id LIMIT 50")
def _(t: Tables) -> DataFrame:
    return S.search_ranked(A.documents_as_symbols(t), "cense, ver").select("id", "score")


@query("pf2_kind_after_cut", f"WITH {_DOCS}, {_bm25(['la'])}, top AS (SELECT * FROM scored ORDER BY score DESC, id LIMIT 100) SELECT id, kind, score FROM top WHERE kind = 'fr'")
def _(t: Tables) -> DataFrame:
    return S.search(A.documents_as_symbols(t), "la", "fr").select("id", "kind", "score")


@query("pf2_kind_before_cut", f"WITH {_DOCS}, own AS (SELECT * FROM docs WHERE kind = 'fr'), {_bm25(['la'], 'own')} SELECT id, kind, score FROM scored ORDER BY score DESC, id LIMIT 100")
def _(t: Tables) -> DataFrame:
    return S.search(A.documents_as_symbols(t), "la", "fr", filter_before_limit=True).select("id", "kind", "score")


@query("se1_union_alias", f"""WITH {_DOCS}, bench AS (SELECT '@bench::' || item_id AS id, text AS name, 'benchmark' AS filepath, 'item' AS kind, regexp_extract_all(lower(text), '[a-z0-9]+') AS a, ['benchmark'] AS b FROM benchmark),
every AS (SELECT * FROM docs UNION ALL SELECT * FROM bench), {_bm25(['the', 'a'], 'every')} SELECT id, score FROM scored ORDER BY score DESC, id LIMIT 100""")
def _(t: Tables) -> DataFrame:
    bench = t.benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("name"), F.lit("benchmark").alias("filepath"), F.lit("item").alias("kind"))
    return S.search_contexts(A.documents_as_symbols(t), {"bench": bench}, "the a").select("id", "score")


@query("d3_postings", """WITH every AS (SELECT CAST(item_id AS VARCHAR) AS id, 'name' AS field, regexp_extract_all(lower(text), '[a-z0-9]+') AS terms FROM benchmark UNION ALL SELECT CAST(item_id AS VARCHAR), 'filepath', ['items'] FROM benchmark)
SELECT id, field, CAST(generate_subscripts(terms, 1) - 1 AS INTEGER) AS position, unnest(terms) AS term FROM every""")
def _(t: Tables) -> DataFrame:
    return S.postings(t.benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("name"), F.lit("items").alias("filepath")))


@query("d3_document_frequencies", "WITH every AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) SELECT term, count(*) AS df FROM every GROUP BY term")
def _(t: Tables) -> DataFrame:
    return S.document_frequencies(S.postings(t.documents.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("name"), F.lit("").alias("filepath"))))


@query("tx3_find_enclosing", f"""WITH RECURSIVE {A.LINE_SPANS}, hits AS (SELECT CAST(doc_id AS VARCHAR) AS file, text, 1 AS from_at, strpos(text, 'All rights reserved.') AS p FROM documents WHERE strpos(text, 'All rights reserved.') > 0
 UNION ALL SELECT file, text, from_at + p + 19, strpos(substring(text, from_at + p + 19), 'All rights reserved.') FROM hits WHERE p > 0),
points AS (SELECT file, CAST(from_at + p - 2 AS BIGINT) AS at FROM hits WHERE p > 0),
held AS (SELECT p.file, p.at, s.id, row_number() OVER (PARTITION BY p.file, p.at ORDER BY s."end" - s.start, s.start, s.id) AS nth FROM points p JOIN spans s ON p.file = s.file AND p.at BETWEEN s.start AND s."end" WHERE s.kind = 'function'),
named AS (SELECT p.file, p.at, h.id FROM points p LEFT JOIN held h ON p.file = h.file AND p.at = h.at AND h.nth = 1)
SELECT file, id, min("at") AS "at" FROM named GROUP BY file, id""")
def _(t: Tables) -> DataFrame:
    return S.find(t.documents.select(F.col("doc_id").cast("string").alias("file"), "text"), A.line_spans(t).where("kind = 'function'"), "All rights reserved.", max_size=None)


@query("j15_seeded_symbols", "SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE source IN (SELECT source FROM documents WHERE contains(text, 'All rights reserved.'))")
def _(t: Tables) -> DataFrame:
    return S.seeded_symbols(A.documents_as_symbols(t), t.documents.where(F.contains("text", F.lit("All rights reserved."))).select(F.col("source").alias("filepath"))).select("id")


@query("j15_seeded_symbols_none", "SELECT CAST(doc_id AS VARCHAR) AS id FROM documents")
def _(t: Tables) -> DataFrame:
    return S.seeded_symbols(A.documents_as_symbols(t), t.documents.where("false").select(F.col("source").alias("filepath"))).select("id")


@query("tx4_tiered_symbols", f"WITH {_DOCS}, own AS (SELECT * FROM docs WHERE filepath IN (SELECT source FROM documents WHERE contains(text, 'All rights reserved.'))), {_bm25(['rights', 'res'], 'own')} SELECT id, score FROM scored ORDER BY score DESC, id LIMIT 20")
def _(t: Tables) -> DataFrame:
    symbols = A.documents_as_symbols(t)
    seeds = t.documents.where(F.contains("text", F.lit("All rights reserved."))).select(F.col("source").alias("filepath"))
    return S.search_ranked(S.seeded_symbols(symbols, seeds), "rights res", 20).select("id", "score")


_TRACES = "traces AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, 'thread ''main'' panicked at src/' || lower(replace(o_orderpriority, ' ', '')) || '/m' || (o_custkey % 7) || '.rs:' || (o_orderkey % 90) || ':5: crate::w' || (o_custkey % 11) || '::run_job, File \"pkg/svc' || (o_custkey % 5) || '.py\", line 41, in handle' AS text FROM orders)"
_TRACE_TOKENS = rf"""{_TRACES}, raws AS (SELECT id, regexp_replace(unnest(regexp_split_to_array(text, '[^A-Za-z0-9_:./\\]+')), '^[:./\\]+|[:./\\]+$', '', 'g') AS raw FROM traces),
base AS (SELECT id, regexp_replace(raw, '(:[0-9]*)(:[0-9]*)?$', '') AS token FROM raws WHERE raw <> ''),
named AS (SELECT id, token FROM base UNION SELECT id, regexp_extract(token, '^(.+)[.][A-Za-z0-9]{{0,4}}$', 1) FROM base WHERE contains(token, '/') UNION SELECT id, regexp_extract(token, '([^:./\\]*)$', 1) FROM base UNION SELECT id, regexp_extract(token, '([^/\\.]*)([.][^/\\]*)?$', 1) FROM base WHERE contains(token, '/')),
tokens AS (SELECT DISTINCT id, token FROM named WHERE length(token) >= 3 AND token NOT IN ('thread', 'panicked', 'at', 'main'))"""


def _traces(t: Tables) -> DataFrame:
    k = lambda n: (F.col("o_custkey") % n).cast("string")
    text = F.concat(F.lit("thread 'main' panicked at src/"), F.lower(F.replace("o_orderpriority", F.lit(" "), F.lit(""))), F.lit("/m"), k(7), F.lit(".rs:"), (F.col("o_orderkey") % 90).cast("string"), F.lit(":5: crate::w"), k(11), F.lit('::run_job, File "pkg/svc'), k(5), F.lit('.py", line 41, in handle'))
    # a small file of orders is one task's: they are dealt to all tasks before texts are made of them
    dealt = t.orders.select(F.col("o_orderkey").cast("string").alias("id"), "o_orderkey", "o_custkey", "o_orderpriority").repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "id")
    return dealt.select("id", text.alias("text"))


@query("tx7_trace_tokens", f"WITH {_TRACE_TOKENS} SELECT id, token FROM tokens")
def _(t: Tables) -> DataFrame:
    return S.trace_tokens(_traces(t))


@query("tx8_trace_summary", f"""WITH {_TRACE_TOKENS}, counts AS (SELECT id, count(DISTINCT CASE WHEN contains(token, '::') THEN token END) AS qualified_symbols, count(DISTINCT CASE WHEN contains(token, '/') THEN coalesce(nullif(regexp_extract(token, '^(.+)[.][A-Za-z0-9]{{0,4}}$', 1), ''), token) END) AS file_candidates, count(DISTINCT CASE WHEN NOT contains(token, '::') AND NOT contains(token, '/') THEN token END) AS leaf_candidates FROM tokens GROUP BY id)
SELECT *, CASE WHEN qualified_symbols > 0 THEN 'qualified_symbol' WHEN file_candidates > 0 THEN 'file' WHEN leaf_candidates > 0 THEN 'leaf_symbol' ELSE 'unknown' END AS primary_kind FROM counts""")
def _(t: Tables) -> DataFrame:
    return S.trace_summary(S.trace_tokens(_traces(t)))


_TRACE_SEEDS = rf"""{_TRACE_TOKENS}, syms AS (SELECT 'sym' || s_suppkey AS symbol, 'W' || (s_suppkey % 13) AS name FROM supplier UNION ALL SELECT 'symsvc' || s_suppkey, 'svc' || (s_suppkey % 6) FROM supplier),
pairs AS (SELECT id, token, symbol, row_number() OVER (PARTITION BY id, token ORDER BY symbol) AS nth FROM tokens JOIN syms ON lower(regexp_extract(token, '([^:./\\]*)$', 1)) = lower(name)),
firsts AS (SELECT id, symbol, min(token) AS token FROM pairs WHERE nth <= 4 GROUP BY id, symbol),
seeds AS (SELECT id, symbol FROM (SELECT id, symbol, row_number() OVER (PARTITION BY id ORDER BY token, symbol) AS nth FROM firsts) WHERE nth <= 6)"""


def _trace_symbols(t: Tables) -> DataFrame:
    k = F.col("s_suppkey").cast("string")
    return t.supplier.select(F.concat(F.lit("sym"), k).alias("id"), F.concat(F.lit("W"), (F.col("s_suppkey") % 13).cast("string")).alias("name")).union(t.supplier.select(F.concat(F.lit("symsvc"), k), F.concat(F.lit("svc"), (F.col("s_suppkey") % 6).cast("string"))))


@query("tx8_trace_seeds", f"WITH {_TRACE_SEEDS} SELECT id, symbol FROM seeds")
def _(t: Tables) -> DataFrame:
    return S.trace_seeds(S.trace_tokens(_traces(t)), _trace_symbols(t))


@query("tx8_trace_graph", f"""WITH {_TRACE_SEEDS}, links AS (SELECT 'sym' || s_suppkey AS src, 'symsvc' || (s_suppkey + s_suppkey % 3) AS dst, 'calls' AS kind FROM supplier UNION ALL SELECT 'symsvc' || s_suppkey, 'sym' || (s_suppkey + s_nationkey % 5), 'references' FROM supplier)
SELECT q.id, l.src, l.dst, l.kind FROM (SELECT DISTINCT id FROM seeds) q JOIN links l ON EXISTS (SELECT 1 FROM seeds s WHERE s.id = q.id AND s.symbol IN (l.src, l.dst))""")
def _(t: Tables) -> DataFrame:
    k, sym, svc = F.col("s_suppkey"), F.lit("sym"), F.lit("symsvc")
    calls = t.supplier.select(F.concat(sym, k.cast("string")).alias("src"), F.concat(svc, (k + k % 3).cast("string")).alias("dst"), F.lit("calls").alias("kind"))
    links = calls.union(t.supplier.select(F.concat(svc, k.cast("string")), F.concat(sym, (k + F.col("s_nationkey") % 5).cast("string")), F.lit("references")))
    return S.trace_graph(S.trace_tokens(_traces(t)), _trace_symbols(t), links)["edges"]


@query("tx5_symbol_search", f"WITH {_DOCS}, {_bm25(['the', 'of'])}, top AS (SELECT * FROM scored ORDER BY score DESC, id LIMIT 100) SELECT id, score, 'local' AS provenance, round((SELECT count(DISTINCT source) FROM documents) / 25.0, 4)::DOUBLE AS coverage, 'partial' AS coverage_state FROM top WHERE kind = 'en'")
def _(t: Tables) -> DataFrame:
    return S.symbol_search(A.documents_as_symbols(t), "the of", 25, "en").select("id", "score", "provenance", "coverage", "coverage_state")


@query("tx5_ag11_coverage", "SELECT doc_id AS id, (SELECT count(DISTINCT source) FROM documents) AS indexed_files, round((SELECT count(DISTINCT source) FROM documents) / 25.0, 4)::DOUBLE AS coverage, 'partial' AS coverage_state FROM documents")
def _(t: Tables) -> DataFrame:
    found = t.documents.select(F.col("doc_id").alias("id"))
    return S.with_coverage(found, A.documents_as_symbols(t), 25)
