"""Symbols and calls from source text, by patterns, brackets and Python's own grammar."""

from __future__ import annotations

import ast
import hashlib
import re
import warnings
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.paths import extension
from ..operators.ranges import next_offsets
from . import scopes
from .bodies import in_spans

#: Comments and texts of languages like C: what declarations aren't looked for in.
_COMMENTS, _TEXT = r"//[^\n]*|/\*[^*]*+(?:\*(?!/)[^*]*+)*+(?:\*/|\Z)", r'"(?:\\.|[^"\\\n])*"'
_LETTER = r"'(?:\\(?:u\{[0-9A-Fa-f]+\}|u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}|[0-7]{1,3}|.)|[^'\\\n])'"
_C_LIKE = f"{_COMMENTS}|{_TEXT}|{_LETTER}"
_JS_LIKE = rf"{_COMMENTS}|{_TEXT}|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`|(?<=[=(,:;!&|?])[ ]*/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/"
_ANYWHERE, _LINE_START = r"(?:^|(?<=[{};]))[^\S\n]*", "^"
#: The same for patterns that begin with no white space: what a long comment leaves is passed once, not tried at each place.
_ANYWHERE_PAST_WHITE = _ANYWHERE + "+"


@dataclass(frozen=True)
class Language:
    """A language's extensions and declarations: kind, a pattern with groups ``name`` and, where a declaration begins behind the match's
    beginning, ``at``, and what a head without a body is: a definition, a stub or nothing (skip). ``blank`` matches comments and texts."""

    name: str
    extensions: tuple[str, ...]
    declarations: tuple[tuple[str, str, str], ...]
    blank: str = _C_LIKE
    anchor: str = _ANYWHERE


_PUB = r"(?:pub(?:\([^)]*\))?\s+)?"
_EXPORT = r"(?:export\s+)?(?:default\s+)?(?P<at>)"
_JS = (
    ("function", _EXPORT + r"(?:async\s+)?function\s*\*?\s*(?P<name>\w+)", "skip"),
    ("class", _EXPORT + r"(?:abstract\s+)?class\s+(?P<name>\w+)", "skip"),
    ("function", r"(?:export\s+)?(?P<at>)(?:const|let|var)\s+(?P<name>\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>", "skip"),
)
_C = (
    ("function", r"(?!return\b|else\b|typedef\b|case\b|goto\b)[A-Za-z_][\w* \t:<>,&]*?[\s*&](?P<name>\w+)\s*(?=\()", "stub"),
    ("struct", r"(?:typedef\s+)?(?P<at>)struct\s+(?P<name>\w+)\s*(?=\{)", "skip"),
)
BUILT_IN = (
    Language("rust", ("rs",), (
        ("function", _PUB + r"(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+\S+\s+)?fn\s+(?P<name>\w+)", "skip"), ("struct", _PUB + r"(?:struct|enum)\s+(?P<name>\w+)", "definition"),
        ("interface", _PUB + r"(?:unsafe\s+)?trait\s+(?P<name>\w+)", "skip"), ("module", _PUB + r"mod\s+(?P<name>\w+)", "definition"),
    ), rf'{_COMMENTS}|\bb?r(?P<h>#*)".*?"(?P=h)|"(?:\\.|[^"\\])*"|{_LETTER}', _ANYWHERE_PAST_WHITE),
    Language("python", ("py",), (("function", r"(?:async\s+)?def\s+(?P<name>\w+)", "skip"), ("class", r"class\s+(?P<name>\w+)", "skip"))),
    Language("javascript", ("js", "jsx", "mjs"), _JS, _JS_LIKE),
    Language("typescript", ("ts", "tsx"), (("function", r"(?:export\s+)?(?P<at>)declare\s+function\s+(?P<name>\w+)", "stub"), *_JS, ("interface", _EXPORT + r"interface\s+(?P<name>\w+)", "skip"), ("interface", _EXPORT + r"type\s+(?P<name>\w+)\s*=", "definition")), _JS_LIKE),
    Language("go", ("go",), (
        ("function", r"func\s+(?:\([^)]*\)\s*)?(?P<name>\w+)", "skip"), ("struct", r"type\s+(?P<at>)(?P<name>\w+)\s+struct\b", "skip"), ("interface", r"type\s+(?P<at>)(?P<name>\w+)\s+interface\b", "skip"),
    ), f"{_C_LIKE}|`[^`]*`", _LINE_START),
    Language("c", ("c", "h"), _C, anchor=_LINE_START),
    Language("cpp", ("cpp", "cc", "cxx", "hpp"), (*_C, ("class", r"[^\S\n]*(?:template\s*<[^>]*>\s*)?(?P<at>)class\s+(?P<name>\w+)", "skip"), ("module", r"[^\S\n]*(?P<at>)namespace\s+(?P<name>\w+)", "skip")), anchor=_LINE_START),
    Language("java", ("java",), (
        ("class", r"(?:(?:public|private|protected|abstract|final|static)\s+)*(?:class|enum)\s+(?P<name>\w+)", "skip"), ("interface", r"(?:(?:public|private|protected)\s+)*interface\s+(?P<name>\w+)", "skip"),
        ("function", r"(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+[\w<>\[\], ]+\s+(?P<name>\w+)\s*(?=\()", "definition"),
    ), rf'""".*?"""|{_C_LIKE}'),
)
#: Extensions by language.
LANGUAGES = {x.name: x.extensions for x in BUILT_IN}
#: Languages that a table of packages may add.
MOST_LANGUAGES = 1000


def language_packages(rows: DataFrame) -> tuple[Language, ...]:
    """Languages from a table (name, extensions, kind, pattern, bodiless), a row for each declaration; MOST_LANGUAGES rows at most."""
    found: dict[str, tuple] = {}
    own = rows.select("name", "extensions", "kind", "pattern", "bodiless").orderBy("name", "kind", "pattern").limit(MOST_LANGUAGES + 1).collect()
    if len(own) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} declarations")
    for r in own:
        extensions, declarations = found.get(r["name"], ((), ()))
        found[r["name"]] = (extensions + tuple(r["extensions"]), (*declarations, (r["kind"], r["pattern"], r["bodiless"] or "skip")))
    return tuple(Language(name, tuple(dict.fromkeys(x)), y) for name, (x, y) in found.items())


def language_of(path: Column) -> Column:
    own, out = extension(path), F.lit(None).cast("string")
    for name, extensions in LANGUAGES.items():
        out = F.when(own.isin(*extensions), F.lit(name)).otherwise(out)
    return out


def lines_of(sources: DataFrame) -> DataFrame:
    """(filepath, line_no from 1, offset in bytes, line, size of the text) of each line."""
    parts = F.split("content", "\n", -1)
    lines = sources.select("filepath", F.octet_length("content").cast("long").alias("size"), F.posexplode(parts).alias("pos", "line"))
    before = Window.partitionBy("filepath").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return lines.select("filepath", (F.col("pos") + 1).cast("long").alias("line_no"), F.coalesce(F.sum(F.octet_length("line") + 1).over(before), F.lit(0)).cast("long").alias("offset"), "line", "size")


def symbol_ids(symbols: DataFrame, order: str = "start_byte") -> DataFrame:
    """Id is path::name, and from the second of a name in its file on ::#1, ::#2 ... in order."""
    nth = F.row_number().over(Window.partitionBy("filepath", "name").orderBy(order)) - 1
    return symbols.withColumn("nth", nth).withColumn("id", F.concat("filepath", F.lit("::"), "name", F.when(F.col("nth") > 0, F.concat(F.lit("::#"), F.col("nth").cast("string"))).otherwise(""))).drop("nth")


@lru_cache(maxsize=64)
def _patterns(language: Language) -> tuple[tuple[str, str, re.Pattern], ...]:
    return tuple((kind, bodiless, re.compile(language.anchor + pattern, re.M)) for kind, pattern, bodiless in language.declarations)


@lru_cache(maxsize=64)
def _blanks(blank: str) -> re.Pattern:
    return re.compile(blank, re.S)


_BEFORE_ANCHOR = re.compile(r"[{};\n]")
_MARKS, _BODY = re.compile(r"[(){}\[\];]"), re.compile(r"\s*\{")
_CLOSES = {")": "(", "]": "[", "}": "{"}


def _masked(content: str, language: Language) -> str:
    """The text with spaces for comments and texts."""
    return _blanks(language.blank).sub(lambda m: "\n".join([" " * len(line) for line in m[0].split("\n")]), content)


class Brackets:
    """Which brackets of a masked text belong together; those that belong to none are ``wrong``."""

    def __init__(self, masked: str):
        self.masked, self.places, self.close, open_ones = masked, [m.start() for m in _MARKS.finditer(masked)], {}, []
        self.wrong = 0
        for at in self.places:
            mark = masked[at]
            if mark in "([{":
                open_ones.append(at)
            elif mark != ";":
                if open_ones and masked[open_ones[-1]] == _CLOSES[mark]:
                    self.close[open_ones.pop()] = at
                else:
                    self.wrong += 1
        self.wrong += len(open_ones)

    def end(self, at: int) -> tuple[int, bool]:
        """Where a declaration ends whose head goes on at a place, and whether it has a body; (-1, False) if its surroundings end before."""
        k = bisect_left(self.places, at)
        while k < len(self.places):
            here = self.places[k]
            mark = self.masked[here]
            if mark == "{":
                return self.close.get(here, len(self.masked) - 1) + 1, True
            if mark == ";":
                return here + 1, False
            if mark not in "([" or here not in self.close:
                break
            k = bisect_left(self.places, self.close[here]) + 1
        return -1, False


def _matches(pattern: re.Pattern, masked: str, places: list[int] | None) -> Iterator[re.Match]:
    """What finditer gives; where a language's anchor holds only at known places, the pattern is tried at those alone."""
    if places is None:
        yield from pattern.finditer(masked)
        return
    end = 0
    for at in places:
        if at >= end and (m := pattern.match(masked, at)):
            yield m
            end = m.end()


def _declared(content: str, language: Language) -> list[tuple[str, str, str, int, int]]:
    """(name, kind, role, start, end) in characters."""
    masked = _masked(content, language)
    brackets, out = Brackets(masked), {}
    places = [0, *(m.end() for m in _BEFORE_ANCHOR.finditer(masked))] if language.anchor in (_ANYWHERE, _ANYWHERE_PAST_WHITE) else None
    for kind, bodiless, pattern in _patterns(language):
        for m in _matches(pattern, masked, places):
            first = m.start("at") if "at" in pattern.groupindex else m.start()
            start = first + len(masked[first : m.end()]) - len(masked[first : m.end()].lstrip())
            if masked.startswith("=>", m.end() - 2) and not _BODY.match(masked, m.end()):
                stop = masked.find("\n", m.end())  # an arrow to an expression takes its line
                end, full = m.end() + len(masked[m.end() : stop if stop >= 0 else len(masked)].rstrip()), True
            else:
                end, full = brackets.end(m.end())
            if full or (bodiless != "skip" and end >= 0):
                out.setdefault(start, (m["name"], kind, "stub" if not full and bodiless == "stub" else "definition", start, end))
    return list(out.values())


def _python(content: str) -> list[tuple[str, str, int, int]] | None:
    """(name, kind, start, end) in bytes by Python's own grammar; None where it doesn't parse."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    starts = [0, *(m.end() for m in re.finditer(rb"\r\n|\r|\n", content.encode("utf-8", "surrogatepass")))]
    kinds = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class"}
    return [(x.name, kinds[type(x)], starts[x.lineno - 1] + x.col_offset, starts[x.end_lineno - 1] + x.end_col_offset) for x in ast.walk(tree) if type(x) in kinds]


def _by_indent(content: str, language: Language) -> list[tuple[str, str, int, int]]:
    """(name, kind, start, end) in characters: a declaration ends with the last line that isn't empty before one that is indented no deeper."""
    out: list[tuple] = []
    open_ones: list[tuple] = []  # (indent, name, kind, start) of declarations that haven't ended
    offset = full = 0
    for line in content.split("\n"):
        text = line.strip()
        if text:
            indent = len(line) - len(line.lstrip())
            while open_ones and open_ones[-1][0] >= indent:
                out.append((*open_ones.pop()[1:], full))
            for kind, _, pattern in _patterns(language):
                if m := pattern.match(line):
                    open_ones.append((indent, m["name"], kind, offset + indent))
                    break
            full = offset + len(line.rstrip())
        offset += len(line) + 1
    return out + [(*x[1:], full) for x in open_ones]


def _in_bytes(content: str, places: Iterable[int]) -> dict[int, int]:
    """Byte offsets of places in characters, in one pass."""
    if content.isascii():
        return {x: x for x in places}
    out, before, size = {}, 0, 0
    for x in sorted(set(places)):
        size += len(content[before:x].encode("utf-8", "surrogatepass"))
        out[x], before = size, x
    return out


def _language(filepath: str, languages: Sequence[Language]) -> Language | None:
    """The last of the languages that has the file's extension, so packages come after the built-in ones."""
    extension_ = filepath.rpartition(".")[2]
    return next((x for x in reversed(languages) if extension_ in x.extensions), None)


def extract_symbols(filepath: str, content: str, languages: Sequence[Language] = BUILT_IN) -> list[tuple]:
    """(filepath, name, kind, start_byte, end_byte, start_line, end_line, hash, role) of a file's declarations, from their first word to the
    end of their body. Python's are read by its grammar, and by indentation where a file doesn't parse; other languages' by patterns and
    matching brackets outside of comments and texts."""
    language = _language(filepath, languages)
    if language is None:
        return []
    data = content.encode("utf-8", "surrogatepass")
    if language.name == "python" and (parsed := _python(content)) is not None:
        found = [(name, kind, "definition", start, end) for name, kind, start, end in parsed]
    else:
        if language.name == "python":
            found = [(n, k, "definition", s, e) for n, k, s, e in _by_indent(content, language)]
        else:
            found = scopes.declarations(content, language.name) if language in BUILT_IN and language.name in scopes.SCANS else _declared(content, language)
        at = _in_bytes(content, (x for row in found for x in row[3:]))
        found = [(*row[:3], at[row[3]], at[row[4]]) for row in found]
    lines = [m.start() for m in re.finditer(b"\n", data)]
    out = [(filepath, name, kind, start, end, bisect_left(lines, start) + 1, bisect_left(lines, end) + 1, hashlib.sha256(data[start:end]).hexdigest(), role) for name, kind, role, start, end in found]
    return sorted(out, key=lambda x: (x[3], x[1]))


_SYMBOLS = pa.schema([("filepath", pa.string()), ("name", pa.string()), ("kind", pa.string()), *((n, pa.int64()) for n in ("start_byte", "end_byte", "start_line", "end_line")), ("semantic_hash", pa.string()), ("role", pa.string())])


def symbols(sources: DataFrame, max_size: int | None = 512 * 1024, packages: Sequence[Language] = ()) -> DataFrame:
    """SC10, SC11, U3: symbols of the files (filepath, content), which are skipped beyond max_size bytes, in the built-in languages and those of packages."""
    files = sources.where("content is not null") if max_size is None else sources.where(F.octet_length("content") <= max_size)
    languages = (*BUILT_IN, *packages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row for path, content in zip(*(c.to_pylist() for c in batch.columns)) for row in extract_symbols(path, content, languages)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SYMBOLS)], schema=_SYMBOLS)

    found = files.select("filepath", "content").mapInArrow(run, "filepath string, name string, kind string, start_byte long, end_byte long, start_line long, end_line long, semantic_hash string, role string")
    return symbol_ids(found).withColumns({"link_name": F.lit(None).cast("string"), "fault_id": F.lit(None).cast("string")})


def count_syntax_errors(filepath: str, content: str | None, languages: Sequence[Language] = BUILT_IN) -> int:
    """Python files that don't parse count 1; in other languages brackets that don't match count, outside of comments and texts."""
    language = _language(filepath, languages)
    if language is None or not content:
        return 0
    if language.name == "python":
        return int(_python(content) is None)
    return scopes.wrong_brackets(content, language.name) if language in BUILT_IN and language.name in scopes.SCANS else Brackets(_masked(content, language)).wrong


def syntax_errors(sources: DataFrame, packages: Sequence[Language] = ()) -> DataFrame:
    """(file, errors) of the files (filepath, content) that have any."""
    languages = (*BUILT_IN, *packages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [count_syntax_errors(path, text, languages) for path, text in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["file", "errors"])

    return sources.select("filepath", "content").mapInArrow(run, "file string, errors long").where("errors > 0")


#: Words before an opening bracket that are no calls, fixed values.
NO_CALLS = ("if", "while", "for", "match", "return", "let", "fn", "impl", "mod", "use", "pub", "struct", "enum", "type", "with", "class", "def", "import", "from", "in", "not", "and", "or", "is", "assert", "del", "pass", "raise", "except", "try", "elif", "else")


def audit_names(sources: DataFrame) -> DataFrame:
    """SC12: (filepath, what, name): distinct function names of Rust, Python and Go files, and names called in any file."""
    lang = language_of(F.col("filepath"))
    line = F.trim("line")
    name = (
        F.when(lang == "rust", F.regexp_extract(line, r"^(?:pub |pub\(crate\) |async )?fn (\w+)", 1))
        .when(lang == "python", F.regexp_extract(line, r"^(?:async )?def (\w+)", 1))
        .when(lang == "go", F.regexp_extract(line, r"^func (?:\([^)]*\)\s*)?(\w+)", 1))
    )
    defs = sources.select("filepath", F.explode(F.split("content", "\n", -1)).alias("line")).select("filepath", F.lit("def").alias("what"), name.alias("name"))
    calls = sources.select("filepath", F.lit("call").alias("what"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"([\p{L}\p{N}_:.]+)\("), 1))).alias("name"))
    return defs.where("name <> ''").distinct().union(calls.where(~F.col("name").isin(*NO_CALLS)))


def text_graph(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SC13, W8: (nodes, edges) of a text scan: a definition's body reaches to the next one; it calls what of the same file stands there before an opening bracket."""
    name = F.regexp_extract("line", r"^\s*(?:pub async fn |pub\(crate\) async fn |async fn |pub\(crate\) fn |pub fn |fn |def |function )([A-Za-z0-9_]+)", 1)
    defs = lines_of(sources).select(F.col("filepath").alias("file"), name.alias("name"), "offset", "size").where("name <> ''")
    spans = next_offsets(defs, "size")
    found = in_spans(spans.withColumnRenamed("file", "filepath"), sources, ("name", "offset", "body_end"), _local_calls)
    calls = found.select(F.col("row.filepath").alias("file"), F.col("row.name").alias("caller"), F.explode("found").alias("target"))
    ident = lambda c: F.concat("file", F.lit("::"), c)
    edges = calls.select(ident("caller").alias("src"), ident("target").alias("dst"), F.lit("calls").alias("kind"), F.lit("heuristic").alias("tier"), F.lit(0.55).alias("confidence"), F.lit("text_scan").alias("source"), F.array(F.lit("text_scan")).alias("evidence")).distinct()
    return defs.select(ident("name").alias("id")).distinct(), edges


_WORD_CALL = re.compile(rb"([A-Za-z0-9_]+)\(")


def _local_calls(data: bytes | None, spans: list[tuple]) -> list[list[str]]:
    """Names of the file's own definitions that stand before a bracket in each (name, start, end), also as the end of a longer word, as the scan looks for a name anywhere."""
    names = {name for name, *_ in spans}
    longest = max(map(len, names))

    def one(name: str, start: int, end: int) -> list[str]:
        words = {x.decode() for x in _WORD_CALL.findall(data or b"", start, end)}
        return sorted({w[k:] for w in words for k in range(max(0, len(w) - longest), len(w))} & names - {name})

    return [one(*span) for span in spans]
