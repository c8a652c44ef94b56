"""Text retrieval over symbols (id, name, filepath, kind): ranked phrase-prefix search, substring fallback, literal find, traces, tiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.paths import leaf
from .lineage import cut
from .ranges import stab

#: Okapi BM25's published defaults.
K1, B = 1.2, 0.75
TOKEN = r"[a-z0-9]+"


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), 1)


def query_tokens(query: str) -> list[str]:
    import re

    return re.findall(TOKEN, query.lower())


def postings(symbols: DataFrame) -> DataFrame:
    """D3: (id, field, position, term) of name and path."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("terms")) for f in ("name", "filepath")))).alias("x")
    return symbols.select("id", each).select("id", "x.field", F.posexplode("x.terms").alias("position", "term"))


def index_rows(symbols: DataFrame) -> DataFrame:
    """The postings with ``dl``, the tokens of their symbol: what search_postings() reads."""
    fields = F.array(*(F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("terms")) for f in ("name", "filepath")))
    each = symbols.select("id", fields.alias("fields")).withColumn("dl", F.aggregate("fields", F.lit(0), lambda n, x: n + F.size(x["terms"])))
    return each.select("id", "dl", F.explode("fields").alias("x")).select("id", "dl", "x.field", F.posexplode("x.terms").alias("position", "term"))


def index_facts(symbols: DataFrame) -> DataFrame:
    """One row: n symbols and their average length."""
    return symbols.agg(F.count("*").alias("n"), F.avg(F.size(tokens(F.col("name"))) + F.size(tokens(F.col("filepath")))).alias("avgdl"))


def write_index(symbols: DataFrame, path: str) -> None:
    """The postings as Parquet in order of term, so that a search reads the row groups of its terms; a frequent term spans several files."""
    rows = index_rows(symbols)
    rows.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{path}/postings")
    index_facts(symbols).write.mode("overwrite").parquet(f"{path}/facts")


def search_index(spark: SparkSession, path: str, query: str, limit: int = 50) -> DataFrame:
    return search_postings(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/facts"), query, limit)


def search_postings(postings: DataFrame, facts: DataFrame, query: str, limit: int = 50, digits: int = 4) -> DataFrame:
    """TX1, T1: (id, score) as search_ranked() ranks them, from the postings of the query's terms alone. Nothing where no symbol matches, or the query has no token."""
    wanted = query_tokens(query)
    if not wanted:
        return postings.select("id", F.lit(0.0).alias("score")).limit(0)
    *whole, prefix = wanted
    is_last = F.col("term").startswith(prefix)
    # a row stands at each place of the query that its term may have; a phrase begins where all places are taken
    places = F.array_compact(F.array(*(F.when(F.col("term") == word, F.lit(k)) for k, word in enumerate(whole)), F.when(is_last, F.lit(len(whole)))))
    own = postings.where(F.col("term").isin(*whole) | is_last if whole else is_last).select("id", "field", "dl", "position", F.explode(places).alias("at"))
    phrases = own.groupBy("id", "field", "dl", (F.col("position") - F.col("at")).alias("start")).agg(F.count("*").alias("found")).where(F.col("found") == len(wanted))
    hits = phrases.groupBy("id", "dl").agg(F.count("*").alias("tf"))
    known = hits.agg(F.count("*").alias("df")).crossJoin(F.broadcast(facts))  # a row each
    n, df, tf = F.col("n"), F.col("df"), F.col("tf")
    score = F.log(1.0 + (n - df + 0.5) / (df + 0.5)) * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.crossJoin(F.broadcast(known)).select("id", F.round(score, digits).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def document_frequencies(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count_distinct("id").alias("df"))


def phrase_hits(symbols: DataFrame, query: str, fields: Sequence[str] = ("name", "filepath")) -> DataFrame:
    """TX1: symbols with ``tf``, the places where the query's tokens stand in a row, the last as a prefix, and ``dl``, their tokens. Nothing is exploded or shuffled."""
    wanted = query_tokens(query)
    if not wanted:
        return symbols.withColumns({"tf": F.lit(0), "dl": F.lit(0)}).limit(0)
    phrase = f"(?= {' '.join(wanted)})"
    lists = [tokens(F.col(f)) for f in fields]
    places = [F.regexp_count(F.concat(F.lit(" "), F.array_join(x, " ")), F.lit(phrase)) for x in lists]
    return symbols.withColumns({"tf": sum(places[1:], places[0]), "dl": sum((F.size(x) for x in lists[1:]), F.size(lists[0]))})


def search_ranked(symbols: DataFrame, query: str, limit: int = 50, fields: Sequence[str] = ("name", "filepath"), digits: int = 4) -> DataFrame:
    """T1, TX1, TX6: the best by BM25, then by id; the fallback by substring if none matches and the query has three characters; the first by id if it is empty."""
    if not query.strip():
        return symbols.withColumn("score", F.lit(0.0)).orderBy("id").limit(limit)
    hits = phrase_hits(symbols, query, fields)
    facts = hits.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.count_if(F.col("tf") > 0).alias("df")).first()
    if not facts or not facts["df"]:
        return substring_fallback(symbols, query, limit).withColumn("score", F.lit(0.0)) if len(query) >= 3 else symbols.withColumn("score", F.lit(0.0)).limit(0)
    n, df, average = facts["n"], facts["df"], facts["avgdl"]
    idf = F.log(F.lit(1.0 + (n - df + 0.5) / (df + 0.5)))
    score = idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(average)))
    return hits.where("tf > 0").withColumn("score", F.round(score, digits)).drop("tf", "dl").orderBy(F.desc("score"), "id").limit(limit)


def substring_fallback(symbols: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """TX2: names that contain the query, whatever the case."""
    return symbols.where(F.contains(F.lower("name"), F.lit(query.lower()))).orderBy("id").limit(limit)


def search(symbols: DataFrame, query: str, kind: str | None = None, limit: int = 100, filter_before_limit: bool = False) -> DataFrame:
    """PF2: ranked search with a kind; by default the kind is told after the cut."""
    if kind and filter_before_limit:
        return search_ranked(symbols.where(F.col("kind") == kind), query, limit)
    found = search_ranked(symbols, query, limit)
    return found.where(F.col("kind") == kind) if kind else found


def union_contexts(local: DataFrame, linked: dict[str, DataFrame]) -> DataFrame:
    """SE1: symbols of the local and the linked contexts; ids and paths of a linked one begin with its alias."""
    out = local.withColumn("alias", F.lit("local"))
    for alias, symbols in sorted(linked.items()):
        out = out.unionByName(symbols.withColumns({"id": F.concat(F.lit(f"@{alias}::"), "id"), "alias": F.lit(alias)}))
    return out


def search_contexts(local: DataFrame, linked: dict[str, DataFrame], query: str, limit: int = 100) -> DataFrame:
    """``@alias::q`` searches one linked context, ``@local::q`` the local one, anything else all."""
    if query.startswith("@") and "::" in query:
        alias, _, query = query[1:].partition("::")
        every = union_contexts(local, linked)
        return search_ranked(every.where(F.col("alias") == alias), query, limit)
    return search_ranked(union_contexts(local, linked), query, limit)


def find_occurrences(sources: DataFrame, query: str, max_size: int | None = 512 * 1024) -> DataFrame:
    """(file, point_id, at): each place of a literal text in files (file, text) up to a size, if any, counted in characters; places do not overlap."""
    hits = sources.where(F.contains("text", F.lit(query)))
    hits = hits if max_size is None else hits.where(F.octet_length("text") <= max_size)
    parts = F.split("text", F.lit(_quoted(query)), -1)
    each = hits.select("file", F.monotonically_increasing_id().alias("row"), F.posexplode(F.transform(F.slice(parts, 1, F.size(parts) - 1), F.length)).alias("point_id", "size"))
    # a place is what stands before it: the parts so far, and the query as often
    before = F.sum("size").over(Window.partitionBy("file", "row").orderBy("point_id").rowsBetween(Window.unboundedPreceding, 0))
    return each.select("file", F.col("point_id").cast("long").alias("point_id"), (before + F.col("point_id") * len(query)).cast("long").alias("at"))


def _quoted(text: str) -> str:
    import re

    return "".join("\\" + c if re.match(r"[^\w\s]", c) else c for c in text)


def find(sources: DataFrame, spans: DataFrame, query: str, max_size: int | None = 512 * 1024) -> DataFrame:
    """TX3, SE7: (file, id, at): the first place of the text in each span, or in the file where no span holds it (id is null then)."""
    found = stab(find_occurrences(sources, query, max_size), spans)
    return found.groupBy("file", "id").agg(F.min("at").alias("at"))


def seeded_symbols(symbols: DataFrame, seeds: DataFrame) -> DataFrame:
    """The symbols of the seed files (filepath); all symbols if that leaves none."""
    found = symbols.join(seeds.select("filepath").distinct(), "filepath", "left_semi")
    return symbols if found.isEmpty() else found


def tiered(symbols: DataFrame, sources: DataFrame, spans: DataFrame, runs: DataFrame, query: str, limit: int = 20) -> dict[str, DataFrame]:
    """TX4: text seeds, the symbols of their files that match, and the last five index runs."""
    seeds = find(sources, spans, query).select(F.col("file").alias("filepath")).distinct()
    found = search_ranked(seeded_symbols(symbols, seeds), query, limit)
    return {"seeds": seeds, "symbols": found, "runs": runs.orderBy(F.desc("ts_unix")).limit(5)}


#: Words of traces that name nothing, fixed values.
NOISE = ("thread", "panicked", "at", "main")


def trace_tokens(texts: DataFrame, noise: Sequence[str] = NOISE) -> DataFrame:
    """TX7: (id, token): what a trace (id, text) names: tokens without position, their leaves, stems and paths without extension."""
    # runs are extracted, as splitting by the class's complement takes six times as long; a token that is under three letters gives no longer ones
    words = F.filter(F.transform(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9_:./\\]+"), F.lit(0)), lambda w: F.btrim(w, F.lit(":./\\"))), lambda w: F.length(w) >= 3)
    base = F.transform(F.array_distinct(words), lambda w: F.when(F.contains(w, F.lit(":")), F.regexp_replace(w, r"(?::[0-9]*){1,2}$", "")).otherwise(w))
    each = texts.select("id", F.explode(F.array_distinct(F.flatten(F.transform(base, _names)))).alias("token")).where(F.length("token") >= 3).where(~F.col("token").isin(*noise))
    # a row's tokens are distinct already; only those of ids with several rows are compared
    several = cut(texts.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("id").alias("again"), F.lit(True).alias("several")))
    if several.isEmpty():
        return each
    marked = each.join(_counted(several), F.equal_null("id", "again"), "left")
    return marked.where("several is null").select("id", "token").union(marked.where("several").select("id", "token").distinct())


def _names(token: Column) -> Column:
    """A token, its leaf, and for a path what stands before its extension and its stem; a plain word is all of them."""
    last = F.substring_index(F.translate(token, "\\", "/"), "/", -1)
    leaf_ = F.substring_index(F.translate(token, ":.\\", "///"), "/", -1)
    bare = F.regexp_extract(token, r"^(.+)\.[A-Za-z0-9]{0,4}$", 1)
    path = F.array(token, bare, leaf_, F.substring_index(last, ".", 1))
    return F.when(token.rlike(r"[/\\]"), path).when(token.rlike("[:.]"), F.array(token, leaf_)).otherwise(F.array(token))


def trace_summary(found: DataFrame) -> DataFrame:
    """(id, qualified_symbols, file_candidates, leaf_candidates, primary_kind) of trace tokens."""
    token = F.col("token")
    qualified, path = F.contains(token, F.lit("::")), token.rlike(r"[/\\]")
    file = F.coalesce(F.nullif(F.regexp_extract(token, r"^(.+)\.[A-Za-z0-9]{0,4}$", 1), F.lit("")), token)
    counts = found.groupBy("id").agg(
        F.count_distinct(F.when(qualified, token)).alias("qualified_symbols"), F.count_distinct(F.when(path, file)).alias("file_candidates"), F.count_distinct(F.when(~qualified & ~path, token)).alias("leaf_candidates")
    )
    kind = F.when(F.col("qualified_symbols") > 0, "qualified_symbol").when(F.col("file_candidates") > 0, "file").when(F.col("leaf_candidates") > 0, "leaf_symbol").otherwise("unknown")
    return counts.withColumn("primary_kind", kind)


#: First symbols of names that may be broadcast.
BROADCAST_NAMED = 100_000


def first_named(symbols: DataFrame, per_token: int) -> DataFrame:
    """(key, symbol): the first symbols of each lower-cased name. What a token meets depends on its name alone, so symbols are cut before they are joined, not for each token of each trace."""
    named = symbols.select(F.lower("name").alias("key"), F.col("id").alias("symbol")).where("key is not null")
    nth = F.row_number().over(Window.partitionBy("key").orderBy("symbol"))
    return named.withColumn("nth", nth).where(F.col("nth") <= per_token).drop("nth")


def _counted(few: DataFrame) -> DataFrame:
    """Rows that are computed once, and broadcast if they are counted to be few."""
    few = cut(few)
    return F.broadcast(few) if few.limit(BROADCAST_NAMED + 1).count() <= BROADCAST_NAMED else few


def _seeds(found: DataFrame, named: DataFrame, total: int) -> DataFrame:
    few = found.withColumn("key", F.lower(leaf(F.col("token"), r"[:./\\]"))).join(named, "key")
    first = few.groupBy("id", "symbol").agg(F.min("token").alias("token"))
    return first.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("token", "symbol"))).where(F.col("nth") <= total).select("id", "symbol")


def trace_seeds(found: DataFrame, symbols: DataFrame, per_token: int = 4, total: int = 6) -> DataFrame:
    """TX8: (id, symbol): up to four symbols named like each token of a trace, six in all, in order of token and symbol."""
    return _seeds(found, _counted(first_named(symbols, per_token)), total)


def trace_graph(found: DataFrame, symbols: DataFrame, edges: DataFrame, per_token: int = 4, total: int = 6) -> dict[str, DataFrame]:
    """TX8: seeds (id, symbol) of each trace, the edges (id and the edges' columns) one step from its seeds either way, each once, and the summary of its candidates. An edges' column id gives way to the trace's."""
    named = _counted(first_named(symbols, per_token))
    seeds = cut(_seeds(found, named, total))
    # a trace's seeds, at most total, go with each of them; only edges at symbols that may be seeds take part
    own = seeds.withColumn("own", F.collect_list("symbol").over(Window.partitionBy("id")))
    rows, may = edges.drop("id"), named.select("symbol").distinct()
    at = lambda end: _counted(rows.join(may.withColumnRenamed("symbol", end), end, "left_semi").select(*rows.columns))
    leaving = own.withColumnRenamed("symbol", "src").join(at("src"), "src").select("id", *rows.columns)
    known = F.coalesce(F.array_contains("own", F.col("src")), F.lit(False))
    entering = own.withColumnRenamed("symbol", "dst").join(at("dst"), "dst").where(~known).select("id", *rows.columns)
    return {"seeds": seeds, "edges": leaving.unionByName(entering), "summary": trace_summary(found)}


#: Classes of side effects by words of the source.
SIDE_EFFECTS = {"filesystem": ("fs::", "open(", "write(", "remove_"), "network": ("http", "socket", "request", "tcp"), "process": ("command", "spawn", "subprocess", "exec("), "state": ("lock(", "global ", "static mut", "insert("), "output": ("println", "print(", "console.log")}


def contracts(symbols: DataFrame) -> DataFrame:
    """TX9: (id, inputs, output, effects, may_fail) from a symbol's source text: its first line's parameters and result, and classes of side effects."""
    first = F.trim(F.substring_index("source_text", "\n", 1))
    low = F.lower("source_text")
    inputs = F.filter(F.transform(F.split(F.regexp_extract(first, r"\(([^)]*)\)", 1), ","), lambda x: F.trim(x)), lambda x: ~x.isin("", "self", "&self", "&mut self"))
    output = F.trim(F.regexp_extract(first, r"->\s*([^{:]+)", 1))
    effects = F.array_compact(F.array(*(F.when(_any(low, words), F.lit(name)) for name, words in SIDE_EFFECTS.items())))
    fails = F.contains("source_text", F.lit("Result<")) | _any(low, ("panic!", "unwrap(", "raise ", "throw "))
    return symbols.select("id", inputs.alias("inputs"), output.alias("output"), effects.alias("effects"), fails.alias("may_fail"))


def _any(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | F.contains(text, F.lit(word))
    return out


def symbol_search(symbols: DataFrame, query: str, total_files: int, kind: str | None = None, peers: DataFrame | None = None, limit: int = 100) -> DataFrame:
    """TX5: what search() finds, or what peers (the same columns) answered if that is nothing, with coverage, the index's quality and
    the provenance of each row: ``local`` or ``external``."""
    found = search(symbols, query, kind, limit)
    local = found.withColumn("provenance", F.lit("local"))
    if peers is not None and found.isEmpty():
        local = peers.select(*(F.col(c) if c in peers.columns else F.lit(None).alias(c) for c in found.columns)).withColumn("provenance", F.lit("external"))
    return with_coverage(local, symbols, total_files)


def with_coverage(found: DataFrame, symbols: DataFrame, total_files: int) -> DataFrame:
    """TX5, AG11: results with the share of files that have symbols and the state that tells."""
    indexed = symbols.agg(F.count_distinct("filepath").alias("indexed_files"))
    share = F.when(F.lit(total_files) == 0, F.lit(1.0)).otherwise(F.round(F.col("indexed_files") / F.lit(total_files), 4))
    state = F.when(F.col("coverage") >= 0.999, "full").when(F.col("coverage") > 0, "partial").otherwise("empty")
    return found.crossJoin(F.broadcast(indexed.withColumn("coverage", share).withColumn("coverage_state", state)))
