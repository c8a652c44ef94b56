"""Edges from symbols and source text: links, containment, calls, imports, bridges, realizations; and their upkeep.

Symbols have columns id, filepath, name, kind, role, link_name, start_byte, end_byte; sources have filepath and content."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.paths import clamp, extension, leaf, parent, tags
from ..schemas import CONTAINER_KINDS
from ..sources.bodies import in_spans
from .graph import strongest_edges
from .lineage import cut, shuffled, spread_join
from .ranges import smallest_container

COLUMNS = ("src", "dst", "kind", "tier", "confidence", "source", "evidence")
#: Words before an opening bracket that are no calls, fixed values.
KEYWORDS = ("if", "while", "for", "match", "return", "let", "fn", "impl", "mod", "use", "pub", "struct", "enum", "type", "switch", "catch", "with", "class", "def", "import", "from", "in", "not", "and", "or", "is", "assert", "del", "pass", "raise", "except", "try", "elif", "else")


def _edges(df: DataFrame, src: str, dst: str, kind: str, tier: str, confidence: Column, source: str, evidence: Column) -> DataFrame:
    return df.select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("kind"), F.lit(tier).alias("tier"), confidence.cast("double").alias("confidence"), F.lit(source).alias("source"), evidence.alias("evidence"))


def link_edges(symbols: DataFrame) -> DataFrame:
    """Stubs to definitions of the same link name; stubs that have no such definition, to definitions of the same name."""
    stubs = symbols.where("role = 'stub'").select(F.col("id").alias("stub"), F.col("link_name").alias("stub_link"), F.col("name").alias("stub_name"))
    defs = symbols.where("role = 'definition'").select(F.col("id").alias("def"), "link_name", "name")
    by_link = stubs.where("stub_link is not null").join(defs.where("link_name is not null"), F.col("stub_link") == F.col("link_name")).where("stub <> def").select("stub", "def")
    left = stubs.join(by_link.select("stub").distinct(), "stub", "left_anti")
    by_name = left.join(defs, F.col("stub_name") == F.col("name")).where("stub <> def").select("stub", "def")
    tagged = lambda *x: F.array(*map(F.lit, x))
    return _edges(by_link, "stub", "def", "universal_link", "structural", F.lit(0.98), "index:link", tagged("indexed", "link_name")).union(_edges(by_name, "stub", "def", "universal_name", "structural", F.lit(0.85), "index:name", tagged("indexed", "name_fallback")))


def containment(symbols: DataFrame) -> DataFrame:
    """J4 pairs with CS4 confidence and evidence: parent, child, their kinds."""
    defs = symbols.where("role = 'definition'").select(F.col("filepath").alias("file"), "id", "kind", F.col("start_byte").alias("start"), F.col("end_byte").alias("end"))
    pairs = smallest_container(defs, defs.where(F.col("kind").isin(*CONTAINER_KINDS)))
    module, callable_child = F.col("parent_kind") == "module", F.col("child_kind").isin("method", "function")
    score = F.lit(0.90) + F.when(module, 0.02).otherwise(0.0) + F.when(callable_child, 0.03).otherwise(0.0)
    always = F.lit(True)
    evidence = tags((always, "indexed"), (always, "nested_span"), (always, "same_file"), (always, F.concat(F.lit("parent_kind:"), "parent_kind")), (always, F.concat(F.lit("child_kind:"), "child_kind")), (module, "module_scope"))
    return pairs.withColumns({"confidence": F.round(clamp(score, 0.90, 0.98), 4), "evidence": evidence})


def containment_edges(symbols: DataFrame) -> DataFrame:
    """J4 ``contains``, J5 ``declares`` (module parents) and J6 ``owns_member`` (callables of classes, structs and interfaces)."""
    found = containment(symbols)
    contains = _edges(found, "parent", "child", "contains", "structural", F.col("confidence"), "index:containment", F.col("evidence"))
    declares = _edges(found.where("parent_kind = 'module'"), "parent", "child", "declares", "structural", clamp(F.col("confidence"), 0.93, 0.99), "index:declaration", F.array_append("evidence", F.lit("module_declaration")))
    members = found.where(F.col("parent_kind").isin("class", "struct", "interface") & F.col("child_kind").isin("method", "function"))
    owner = F.concat("evidence", F.array(F.lit("member_ownership"), F.concat(F.lit("owner_kind:"), "parent_kind")))
    return contains.union(declares).union(_edges(members, "parent", "child", "owns_member", "structural", clamp(F.col("confidence"), 0.94, 0.99), "index:member", owner))


def call_sites(symbols: DataFrame, sources: DataFrame, keywords: Sequence[str] = KEYWORDS) -> DataFrame:
    """(caller id, its filepath, called): distinct names before an opening bracket in a symbol's span of the text."""
    spans = symbols.where("end_byte > start_byte").select(F.col("id").alias("caller"), "filepath", "start_byte", "end_byte")
    found = in_spans(spans, sources, ("start_byte", "end_byte"), _called_names)
    return found.select("row.caller", "row.filepath", F.explode("found").alias("called")).where(~F.col("called").isin(*keywords))


_CALL = re.compile(rb"([A-Za-z0-9_:.]+)[ \t\r\n\f]*\(")


def _called_names(data: bytes | None, spans: list[tuple]) -> list[list[str]]:
    """Distinct names in each span that lies within the text."""
    size = -1 if data is None else len(data)
    return [[x.decode() for x in dict.fromkeys(_CALL.findall(data, start, end))] if end <= size else [] for start, end in spans]


#: How near a candidate is, the nearest first.
SAME_FILE, SAME_KIND_NEAR, SAME_DIR, SAME_EXTENSION, ANYWHERE = range(5)


def _places(path: Column) -> Column:
    """(level, place): what a file must share at each level of nearness."""
    places = {SAME_FILE: path, SAME_KIND_NEAR: F.concat_ws("\n", parent(path), extension(path)), SAME_DIR: parent(path), SAME_EXTENSION: extension(path), ANYWHERE: F.lit("")}
    return F.explode(F.array(*(F.struct(F.lit(level).alias("level"), place.alias("place")) for level, place in places.items())))


#: Lengths of what stands before a name, by which a qualified call is looked up in ids and paths.
BEFORE_LENGTHS = (1, 2, 4, 8)


def qualified_matches(sites: DataFrame, targets: DataFrame) -> DataFrame:
    """Pairs of sites and targets of the leaf whose id or path contains the whole called text.

    Where it does, the target's name stands there with the text before the leaf in front of it. So targets are filed by their name and
    the last characters before each place where it stands in their id or path, and a call looks its own up: it meets what ends alike, not all of the name."""
    text, name = F.col("text"), F.col("name")
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text) - F.length(name) + 1, F.lit(1))), lambda k: F.substring(text, k, F.length(name)) == name)
    before = lambda k, n: F.substring(text, F.greatest(k - n, F.lit(1)), F.least(k - 1, F.lit(n)))
    filed = targets.withColumn("text", F.explode(F.array("target", "target_path"))).where("name <> ''").withColumn("place", F.explode(places))
    keys = F.explode(F.array(*(before(F.col("place"), n) for n in BEFORE_LENGTHS))).alias("key")
    filed = filed.select("target", "target_path", "name", keys).where("key <> ''").distinct()
    prefix = F.substring("called", F.lit(1), F.length("called") - F.length("leaf"))
    size = F.lit(BEFORE_LENGTHS[0])
    for n in BEFORE_LENGTHS[1:]:
        size = F.when(F.length(prefix) >= n, F.lit(n)).otherwise(size)
    asked = sites.where("qualified").withColumn("asked", F.right(prefix, size))
    found = asked.join(shuffled(filed), (F.col("leaf") == F.col("name")) & (F.col("asked") == F.col("key")))
    return found.where(F.contains("target", F.col("called")) | F.contains("target_path", F.col("called"))).drop("asked", "key").distinct()


def near_candidates(sites: DataFrame, targets: DataFrame) -> DataFrame:
    """Sites (called, filepath, leaf, qualified and others) with those targets (target, target_path, name) of the leaf that may score best.

    A site's best level is told from the places where a name stands, so a name that stands everywhere isn't paired with all its calls.
    A target in the same file beats all others. Nearness alone ranks the others unless the call is qualified, as a match adds points:
    then what shares directory and extension is beaten at most by what shares the directory; what shares the directory only, also by
    matches elsewhere; and what is farther by any match. So beyond its directory a qualified call meets its matches, and what is merely near
    only where there are none: then all of that level tie and are results."""
    placed = targets.select("target", "target_path", "name", _places(F.col("target_path")).alias("at")).select("target", "target_path", "name", "at.level", "at.place")
    site = list(sites.columns)
    asked = sites.select(*site, _places(F.col("filepath")).alias("at")).select(*site, "at.level", "at.place")
    known = placed.select(F.col("name").alias("leaf"), "level", "place").distinct()
    nearest = asked.join(shuffled(known), ["leaf", "level", "place"], "left_semi").groupBy(*site).agg(F.min("level").alias("nearest"))
    matches = qualified_matches(nearest.where(F.col("nearest") >= SAME_DIR), targets)
    matched = matches.select(*site).distinct().withColumn("matched", F.lit(True))
    told = nearest.join(shuffled(matched), site, "left")
    told = told.where(F.col("matched").isNull() | (F.col("nearest") <= SAME_DIR))
    level = F.when(F.col("qualified") & (F.col("nearest") == SAME_KIND_NEAR), SAME_DIR).otherwise(F.col("nearest"))
    path = F.col("filepath")
    place = F.when(F.col("level") == SAME_FILE, path).when(F.col("level") == SAME_KIND_NEAR, F.concat_ws("\n", parent(path), extension(path))).when(F.col("level") == SAME_DIR, parent(path)).when(F.col("level") == SAME_EXTENSION, extension(path)).otherwise("")
    wanted = told.withColumn("level", level).withColumn("place", place).drop("nearest", "matched")
    near = wanted.join(shuffled(placed.withColumnRenamed("name", "leaf")), ["leaf", "level", "place"]).select(*site, "target", "target_path")
    return near.union(matches.select(*site, "target", "target_path")).distinct()


def call_candidates(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """J7, CS1, CS2, CS6: each site's best candidates by the called name's leaf, all those at the greatest score, with confidence and evidence.

    What is best depends on the called text and the caller's file alone, so it is told once for each pair of these and then joined to the
    callers that share them. A caller that stands in several files has the best of all of them."""
    targets = symbols.select(F.col("id").alias("target"), F.col("filepath").alias("target_path"), F.col("name"))
    qualified = F.contains("called", F.lit("::")) | F.contains("called", F.lit("."))
    # read several times, so the texts are scanned once
    sites = cut(sites.select("caller", "called", "filepath").where(leaf(F.col("called")) != "").distinct())
    asked = cut(sites.select("called", "filepath", leaf(F.col("called")).alias("leaf"), qualified.alias("qualified")).distinct())
    pairs = near_candidates(asked, targets)
    same_file = F.col("target_path") == F.col("filepath")
    same_dir = parent(F.col("target_path")) == parent(F.col("filepath"))
    same_ext = extension(F.col("target_path")) == extension(F.col("filepath"))
    qualified = F.col("qualified")
    match = qualified & (F.contains("target", F.col("called")) | F.contains("target_path", F.col("called")))
    points = lambda c, n: F.when(c, F.lit(n)).otherwise(F.lit(0))
    score = points(same_file, 100) + points(same_dir, 20) + points(same_ext, 10) + points(match, 15)
    alike = ["called", "filepath"]
    ranked = pairs.withColumn("score", score).withColumn("rank", F.rank().over(Window.partitionBy(*alike).orderBy(F.desc("score")))).where("rank = 1")
    best = cut(ranked.select("target", "score", *alike, same_file.alias("same_file"), same_dir.alias("same_dir"), same_ext.alias("same_ext"), "qualified", match.alias("match")))
    # of a caller's files those with the best score count, with all their candidates
    tops = best.groupBy(*alike).agg(F.max("score").alias("top"), F.count("*").alias("n"))
    by_site = Window.partitionBy("caller", "called")
    at_top = sites.join(shuffled(tops), alike).withColumn("most", F.max("top").over(by_site)).where("top = most")
    asking = cut(at_top.select("caller", *alike, (F.sum("n").over(by_site) == 1).alias("unique")))
    # callers of a kind have equal confidence and evidence, so both are told before the candidates go to each
    best = best.join(shuffled(asking.select(*alike, "unique").distinct()), alike)
    same_file, same_dir, same_ext, qualified, match, unique = (F.col(x) for x in ("same_file", "same_dir", "same_ext", "qualified", "match", "unique"))
    share = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    confidence = F.lit(0.58) + share(same_file, 0.18) + share(same_dir, 0.07) + share(same_ext, 0.04) + share(qualified, 0.08) + share(match, 0.05) + F.when(unique, 0.08).otherwise(-0.10)
    always = F.lit(True)
    evidence = tags((always, "indexed"), (always, "call_scan"), (same_file, "same_file"), (same_dir, "same_parent"), (same_ext, "same_extension"), (qualified, "qualified_call"), (match, "qualified_match"), (unique, "unique_best"), (~unique, "ambiguous_best"))
    told = best.select(*alike, "unique", "target", "score", F.round(clamp(confidence, 0.35, 0.92), 4).alias("confidence"), evidence.alias("evidence"))
    return spread_join(asking, told, [*alike, "unique"], "caller").select("caller", "called", "target", "score", "confidence", "evidence")


def call_edges(symbols: DataFrame, sources: DataFrame) -> DataFrame:
    return call_edges_of(call_sites(symbols, sources), symbols)


def call_edges_of(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    found = call_candidates(sites, symbols).where("target <> caller")
    return strongest_edges(_edges(found, "caller", "target", "calls", "semantic", F.col("confidence"), "index:call_scan", F.col("evidence"))).select(*COLUMNS)


def import_names(sources: DataFrame) -> DataFrame:
    """TX10: (filepath, imported): names from lines of use, import, from-import and #include."""
    lines = sources.select("filepath", F.explode(F.split("content", "\n", -1)).alias("line")).select("filepath", F.trim(F.regexp_replace("line", "\r", "")).alias("line"))
    line = F.col("line")
    first_word = lambda x: F.regexp_extract(x, r"^(\S+)", 1)
    use = F.trim(F.regexp_replace(F.regexp_extract(line, r"^(?:pub )?use (.*)$", 1), ";+$", ""))
    prefix = F.regexp_replace(F.regexp_extract(use, r"^([^{]*)\{", 1), "(::)+$", "")
    inside = F.split(F.regexp_extract(use, r"\{([^{}]*)", 1), ",")
    grouped = F.transform(F.filter(F.transform(inside, lambda x: F.trim(x)), lambda x: (x != "") & (x != "self")), lambda x: F.concat(prefix, F.lit("::"), first_word(x)))
    uses = F.when(use.contains("{") & use.contains("}"), grouped).otherwise(F.array(first_word(use)))
    bindings = F.regexp_replace(F.split(F.regexp_extract(line, r"^import (.*)$", 1), " from ", 2)[0], r"^[\s{]+|[\s;}]+$", "")
    imports = F.filter(F.transform(F.split(bindings, ","), lambda x: leaf(F.regexp_replace(first_word(F.trim(x)), "^[{}]+|[{}]+$", ""), "[.]")), lambda x: (x != "") & (x != "*"))
    module, names = F.trim(F.regexp_extract(line, r"^from (.*?) import (.*)$", 1)), F.regexp_extract(line, r"^from (.*?) import (.*)$", 2)
    listed = F.split(F.regexp_replace(names, r"^[\s(]+|[\s;)]+$", ""), ",")
    froms = F.transform(F.filter(F.transform(listed, lambda x: F.trim(x)), lambda x: (x != "") & (x != "*")), lambda x: F.concat(module, F.lit("."), first_word(x)))
    header = F.regexp_replace(F.regexp_extract(line, r"^#include(.*)$", 1), r"^[\s<\"]+|[\s>\"]+$", "")
    include = F.array(F.trim(F.substring_index(leaf(header, "[/]"), ".", 1)))
    found = (
        F.when(line.rlike(r"^(?:pub )?use "), uses).when(line.startswith("import "), imports).when(line.rlike(r"^from .* import "), froms).when(line.startswith("#include"), include)
    )
    return lines.where(line.rlike(r"^(use |pub use |import |from |#include)")).select("filepath", F.explode(found).alias("imported")).where("imported <> ''").distinct()


def import_candidates(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """J8, CS3, W4: (filepath, target, confidence, evidence): all symbols of an imported leaf name; of several names for one target the lowest confidence stays."""
    targets = symbols.select(F.col("id").alias("target"), F.col("filepath").alias("target_path"), "name")
    per_name = targets.groupBy("name").agg(F.count("*").alias("candidates"))
    pairs = imports.withColumn("leaf", leaf(F.col("imported"), "[.:/]")).join(shuffled(targets), F.col("leaf") == F.col("name")).join(shuffled(per_name), "name")
    same_dir = parent(F.col("target_path")) == parent(F.col("filepath"))
    same_ext = extension(F.col("target_path")) == extension(F.col("filepath"))
    qualified = F.contains("imported", F.lit("::")) | F.contains("imported", F.lit(".")) | F.contains("imported", F.lit("/"))
    match = qualified & (F.contains("target", F.col("imported")) | F.contains("target_path", F.col("imported")))
    unique = F.col("candidates") == 1
    share = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    confidence = F.lit(0.60) + share(same_dir, 0.10) + share(same_ext, 0.06) + share(qualified, 0.10) + share(match, 0.08) + F.when(unique, 0.08).otherwise(-0.08)
    always = F.lit(True)
    evidence = tags((always, "indexed"), (always, "import_scan"), (same_dir, "same_parent"), (same_ext, "same_extension"), (qualified, "qualified_import"), (match, "qualified_match"), (unique, "unique_best"), (~unique, "ambiguous_best"))
    scored = pairs.select("filepath", "target", "imported", F.round(clamp(confidence, 0.35, 0.94), 4).alias("confidence"), evidence.alias("evidence"))
    lowest = F.min_by(F.struct("confidence", "evidence"), F.struct("confidence", "imported")).alias("x")
    return scored.groupBy("filepath", "target").agg(lowest).select("filepath", "target", "x.*")


def import_edges(symbols: DataFrame, sources: DataFrame) -> DataFrame:
    """Every definition of a file imports what the file imports."""
    return import_edges_of(import_names(sources), symbols)


def import_edges_of(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    owners = symbols.where("role = 'definition'").select(F.col("id").alias("owner"), "filepath")
    found = import_candidates(imports, symbols).join(shuffled(owners), "filepath").where("owner <> target")
    return _edges(found, "owner", "target", "imports", "structural", F.col("confidence"), "index:import_scan", F.col("evidence"))


def bridge_edges(symbols: DataFrame, wrapper_dirs: Sequence[str], core_dirs: Sequence[str]) -> DataFrame:
    """Symbols in wrapper directories to symbols of the same name in core directories."""
    named = lambda c, dirs: F.coalesce(*[F.when(F.contains(c, F.lit(d)), True) for d in dirs], F.lit(False))
    wrappers = symbols.where(named(F.col("filepath"), wrapper_dirs)).select(F.col("id").alias("wrapper"), "name")
    core = symbols.where(named(F.col("id"), core_dirs)).select(F.col("id").alias("core"), "name")
    found = wrappers.join(core, "name").where("wrapper <> core")
    return _edges(found, "wrapper", "core", "bridge", "structural", F.lit(0.92), "index:bridge", F.array(F.lit("indexed"), F.lit("cross_language_bridge")))


def realization_edges(symbols: DataFrame) -> DataFrame:
    """A symbol named ``X for Y`` realizes interfaces named X, and belongs to structs and classes named Y."""
    impls = symbols.where(F.contains("name", F.lit(" for "))).select(F.col("id").alias("impl"), F.trim(F.split("name", " for ", 2)[0]).alias("x"), F.trim(F.split("name", " for ", 2)[1]).alias("y"))
    interfaces = symbols.where("kind = 'interface'").select(F.col("id").alias("target"), "name")
    types = symbols.where("kind in ('struct', 'class')").select(F.col("id").alias("target"), "name")
    realized = spread_join(impls.select("impl", F.col("x").alias("name")), interfaces, ["name"], "impl").select("impl", "target")
    owned = spread_join(impls.select("impl", F.col("y").alias("name")), types, ["name"], "impl").select(F.col("target").alias("impl"), F.col("impl").alias("target"))
    found = realized.union(owned)
    return _edges(found.where("impl <> target"), "impl", "target", "realizes", "structural", F.lit(0.95), "index:realization", F.array(F.lit("indexed"), F.lit("trait_realization")))


def build_edges(symbols: DataFrame, sources: DataFrame, wrapper_dirs: Sequence[str] = (), core_dirs: Sequence[str] = (), sites: DataFrame | None = None, imports: DataFrame | None = None) -> DataFrame:
    """All edges of the symbols; of equal (src, dst, kind) the most confident. With tables of call_sites() and import_names() no text is read."""
    calls = call_edges_of(call_sites(symbols, sources) if sites is None else sites, symbols)
    used = import_edges_of(import_names(sources) if imports is None else imports, symbols)
    found = link_edges(symbols).union(containment_edges(symbols)).union(calls).union(used).union(realization_edges(symbols))
    if wrapper_dirs and core_dirs:
        found = found.union(bridge_edges(symbols, wrapper_dirs, core_dirs))
    return strongest_edges(found).select(*COLUMNS)


def impacted_ids(symbols: DataFrame, touched: DataFrame) -> DataFrame:
    """Ids of symbols in touched files (column filepath), and of those that share a name or link name with one."""
    own = symbols.join(touched.select("filepath").distinct(), "filepath", "left_semi")
    names, links = own.select("name").distinct(), own.where("link_name is not null").select("link_name").distinct()
    return own.select("id").union(symbols.join(names, "name", "left_semi").select("id")).union(symbols.join(links, "link_name", "left_semi").select("id")).distinct()


def refresh_edges(edges: DataFrame, symbols: DataFrame, sources: DataFrame, touched: DataFrame, removed: DataFrame | None = None, sites: DataFrame | None = None, imports: DataFrame | None = None, wrapper_dirs: Sequence[str] = (), core_dirs: Sequence[str] = ()) -> DataFrame:
    """G10, SK1: edges after files changed. symbols and sources are those after the change; touched names the changed files, removed (filepath, id, name, link_name) the symbols that are gone.

    What the names of touched files resolve to may change anywhere, so edges at impacted symbols, and at callers and importers of
    their names, are built anew, from these symbols, their files and the symbols of the names they use; the others stay. With the
    tables of call_sites() and import_names() from before, only touched files' text is read. Symbols are read several times, so they
    should come from a table or be cut."""
    # what is read several times is computed once
    changed, edges = cut(touched.select("filepath").distinct()), cut(edges.select(*COLUMNS))
    known = symbols.select("filepath", "id", "name", "link_name")
    gone = removed.select("filepath", "id", "name", "link_name") if removed is not None else known.limit(0)
    impacted = cut(impacted_ids(known.union(gone), touched))
    near = edges.join(impacted.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
    names = known.union(gone).join(impacted, "id", "left_semi").select("name").distinct()
    here = sources.join(changed, "filepath", "left_semi")
    sites = cut(call_sites(symbols, sources) if sites is None else sites.join(changed, "filepath", "left_anti").unionByName(call_sites(symbols.join(changed, "filepath", "left_semi"), here)))
    imports = cut(import_names(sources) if imports is None else imports.join(changed, "filepath", "left_anti").unionByName(import_names(here)))
    callers = sites.withColumn("name", leaf(F.col("called"))).join(names, "name", "left_semi").select(F.col("caller").alias("id"))
    importers = imports.withColumn("name", leaf(F.col("imported"), "[.:/]")).join(names, "name", "left_semi").select("filepath").distinct()
    again = cut(impacted.union(near).union(callers).union(symbols.join(importers, "filepath", "left_semi").select("id")).distinct())
    at = lambda df, column, ids=again: df.join(ids.withColumnRenamed("id", column), column, "left_semi").select(*df.columns)
    kept = edges.join(again.withColumnRenamed("id", "src"), "src", "left_anti").join(impacted.withColumnRenamed("id", "dst"), "dst", "left_anti").select(*COLUMNS)
    files = cut(at(symbols, "id").select("filepath").distinct())
    inside = symbols.join(files, "filepath", "left_semi").select(*symbols.columns)
    # candidates are told from all symbols of a name, and links from all definitions
    own_sites, own_imports = at(sites, "caller"), imports.join(files, "filepath", "left_semi")
    used = own_sites.select(leaf(F.col("called")).alias("name")).union(own_imports.select(leaf(F.col("imported"), "[.:/]").alias("name"))).distinct()
    named = symbols.join(used, "name", "left_semi").select(*symbols.columns)
    imported = import_candidates(own_imports, named).join(inside.where("role = 'definition'").select(F.col("id").alias("owner"), "filepath"), "filepath").where("owner <> target")
    fresh = [
        link_edges(at(symbols.where("role = 'stub'"), "id").unionByName(symbols.where("role = 'definition'"))),
        containment_edges(inside),
        call_edges_of(own_sites, named),
        _edges(imported, "owner", "target", "imports", "structural", F.col("confidence"), "index:import_scan", F.col("evidence")),
        realization_edges(symbols),  # few symbols are named so
    ]
    if wrapper_dirs and core_dirs:
        shared = at(symbols, "id").select("name").distinct()
        fresh.append(bridge_edges(symbols.join(shared, "name", "left_semi").select(*symbols.columns), wrapper_dirs, core_dirs))
    built = fresh[0]
    for more in fresh[1:]:
        built = built.union(more)
    # an edge is new if it begins at what is built anew, or ends at an impacted symbol
    built = strongest_edges(built).select(*COLUMNS)
    new = at(built, "src").union(at(built, "dst", impacted).join(again.withColumnRenamed("id", "src"), "src", "left_anti").select(*COLUMNS))
    return kept.union(new)
