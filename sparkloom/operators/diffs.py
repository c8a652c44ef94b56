"""Line diffs between versions of texts, and what a review finds in them."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .lineage import cut
from .policy import is_source_file, is_test_file

#: Rows of a longest-common-subsequence table held at once, at each level of its parts; bytes of masks of lines that are kept; lines that a bounded diff looks ahead.
ROWS_HELD, MASK_BYTES, LOOK_AHEAD = 64, 16_000_000, 24


def split_lines(text: str | None) -> list[str]:
    return text.split("\n") if text else []


def matched_lines(old: list[str], new: list[str], most_cells: int | None = None) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, whatever the texts' length; common ends are matched first. Only where a bound is
    given, nothing is matched between the ends of texts whose table would have more cells."""
    head = 0
    while head < min(len(old), len(new)) and old[head] == new[head]:
        head += 1
    tail = 0
    while tail < min(len(old), len(new)) - head and old[-1 - tail] == new[-1 - tail]:
        tail += 1
    a, b = old[head : len(old) - tail], new[head : len(new) - tail]
    pairs = [(k, k) for k in range(head)]
    if a and b and (most_cells is None or len(a) * len(b) <= most_cells):
        pairs += [(head + i, head + j) for i, j in common_lines(a, b)]
    return pairs + [(len(old) - tail + k, len(new) - tail + k) for k in range(tail)]


def common_lines(a: list[str], b: list[str]) -> Iterator[tuple[int, int]]:
    """Index pairs of a longest common subsequence: of several, the one that passes lines of a before lines of b.

    A row of the table is a number with a bit for each line of b, the last line's lowest: zero where one more line is common to the rest
    of both from there on. Rows are told from the last to the first; some are held, and those between them are told again when they are walked."""
    size, places = len(b), {}
    for j, line in enumerate(b):
        places.setdefault(line, []).append(j)
    often, whole = sorted((line for line in set(a) if line in places), key=lambda line: -len(places[line])), (1 << size) - 1

    def mask(line: str) -> int:
        at = places[line]
        if len(at) <= 8:
            return sum(1 << (size - 1 - j) for j in at)
        bits = np.zeros(size, np.uint8)
        bits[size - 1 - np.array(at)] = 1
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    kept = {line: mask(line) for line in often[: MASK_BYTES * 8 // max(size, 1)]}

    def above(row: int, i: int) -> int:
        """Row i from the one after it."""
        line = a[i]
        if line not in places:
            return row
        same = row & (kept[line] if line in kept else mask(line))
        return ((row + same) | (row - same)) & whole

    def rows(first: int, last: int, below: int) -> Iterator[tuple[int, int, int]]:
        """(i, row i, row i + 1) from the first to before the last, after which is the row below."""
        step = max(1, -(-(last - first) // ROWS_HELD))
        ends, held = list(range(first, last, step))[::-1], []
        for start, end in zip(ends, [last, *ends]):
            held.append((start, end, below))
            if start > first or step == 1:
                for i in range(end - 1, start - 1, -1):
                    below = above(below, i)
        while held:
            start, end, row = held.pop()
            if step == 1:
                yield start, below, row
                below = row
            else:
                yield from rows(start, end, row)

    j = 0
    for i, row, after in rows(0, len(a), whole):
        if j == size:
            return
        if a[i] != b[j]:
            # line i is needed from here if rows differ in an odd number of places; then it is the next line that equals it
            if not ((row ^ after) & ((1 << (size - j)) - 1)).bit_count() & 1:
                continue
            j = places[a[i]][bisect_left(places[a[i]], j)]
        yield i, j
        j += 1


def realigned_lines(old: list[str], new: list[str], ahead: int = LOOK_AHEAD) -> list[tuple[int, int]]:
    """Index pairs of equal lines for texts beyond a bound: where lines differ, the nearest old line within reach that equals
    the new one is gone on with, else the nearest new line that equals the old one, else both lines are passed."""
    pairs, i, j = [], 0, 0
    while i < len(old) and j < len(new):
        if old[i] == new[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif (k := next((k for k in range(i + 1, min(i + ahead, len(old))) if old[k] == new[j]), None)) is not None:
            i = k
        elif (k := next((k for k in range(j + 1, min(j + ahead, len(new))) if new[k] == old[i]), None)) is not None:
            j = k
        else:
            i, j = i + 1, j + 1
    return pairs


def _added(a: list[str], b: list[str], pairs: list[tuple[int, int]]) -> tuple[list[tuple[int, str]], int]:
    stay = {j for _, j in pairs}
    return [(j + 1, line) for j, line in enumerate(b) if j not in stay], len(a) - len(pairs)


def added_removed(old: str | None, new: str | None) -> tuple[list[tuple[int, str]], int]:
    """DF2: (line number from 1, line) of added lines, and the number of removed ones."""
    a, b = split_lines(old), split_lines(new)
    return _added(a, b, matched_lines(a, b))


def _shown(a: list[str], b: list[str], pairs: list[tuple[int, int]]) -> str:
    out, i, j = [], 0, 0
    for x, y in [*pairs, (len(a), len(b))]:
        out += [f"-{line}" for line in a[i:x]] + [f"+{line}" for line in b[j:y]]
        if x < len(a):
            out.append(f" {a[x]}")
        i, j = x + 1, y + 1
    return "\n".join(out)


def unified(old: str | None, new: str | None, most_cells: int | None = None) -> str:
    """DF1: all lines with a space, minus or plus before them; removed ones stand before added ones. Only where a bound is given, texts beyond it are looked ahead in."""
    a, b = split_lines(old), split_lines(new)
    return _shown(a, b, matched_lines(a, b) if most_cells is None or len(a) * len(b) <= most_cells else realigned_lines(a, b))


#: Files whose texts and diffs a task holds as Python objects at once.
ROWS = 200


def change_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Changes of batches (path, change, old, new), of some files at a time; what was freed goes back to the system after each batch."""
    for whole in batches:
        for k in range(0, len(whole), ROWS):
            batch = whole.slice(k, ROWS)
            old, new = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            found, shown = [], []
            for x, y in zip(map(split_lines, old), map(split_lines, new)):
                pairs = matched_lines(x, y)
                found.append(_added(x, y, pairs))
                shown.append(_shown(x, y, pairs))
            lines = pa.array([[{"line_no": n, "line": line} for n, line in added] for added, _ in found], pa.list_(pa.struct([("line_no", pa.int64()), ("line", pa.string())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lines, pa.array([r for _, r in found], pa.int64()), pa.array(shown, pa.string())], names=["path", "change", "added_lines", "removed", "diff"])
        pa.default_memory_pool().release_unused()


def raw_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """J17, DF1, DF2: (path, change, added_lines, removed, changed_lines, diff) of files (path, content) that differ between two versions."""
    a, b = before.select("path", F.struct(F.col("content").alias("text")).alias("old")), after.select("path", F.struct(F.col("content").alias("text")).alias("new"))
    change = F.when(F.col("old").isNull(), "created").when(F.col("new").isNull(), "deleted").otherwise("modified")
    joined = a.join(b, "path", "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).select("path", change.alias("change"), F.col("old.text").alias("old"), F.col("new.text").alias("new"))

    out = joined.mapInArrow(change_batches, "path string, change string, added_lines array<struct<line_no:bigint,line:string>>, removed long, diff string")
    return out.withColumn("changed_lines", F.size("added_lines") + F.col("removed"))


def largest_changes(changes: DataFrame, limit: int) -> DataFrame:
    """T5."""
    return changes.orderBy(F.desc("changed_lines"), "path").limit(limit)


#: Lines of a file from which its change is large.
LARGE_CHANGE = 300


def review_findings(changes: DataFrame, syntax: DataFrame | None = None) -> DataFrame:
    """DF3, T6: (severity, code, file, line): risky calls and markers in added lines, large changes, changed files with errors of syntax (file), and source changes without any test's, the gravest first."""
    # read several times, so texts are compared once; whole diffs aren't needed
    changes = cut(changes.select("path", "added_lines", "changed_lines"))
    lines = changes.select("path", F.explode("added_lines").alias("x")).select("path", "x.line_no", "x.line")
    risky = lines.where(F.col("line").rlike(r"unwrap\(|expect\(|panic!")).select(F.lit("medium").alias("severity"), F.lit("risky_api").alias("code"), F.col("path").alias("file"), F.col("line_no").alias("line"))
    marked = lines.where(F.col("line").rlike("TODO|FIXME|XXX")).select(F.lit("low"), F.lit("todo_marker"), "path", "line_no")
    none = F.lit(None).cast("long")
    large = changes.where(F.col("changed_lines") > LARGE_CHANGE).select(F.lit("medium"), F.lit("large_change"), "path", none)
    touched = changes.agg(F.bool_or(is_source_file(F.col("path"))).alias("source"), F.bool_or(is_test_file(F.col("path"))).alias("test"))
    untested = touched.where("source and not test").select(F.lit("medium"), F.lit("missing_tests"), F.lit(None).cast("string"), none)
    found = risky.union(marked).union(large).union(untested)
    if syntax is not None:
        broken = changes.join(syntax.select(F.col("file").alias("path")), "path", "left_semi")
        found = found.union(broken.select(F.lit("high"), F.lit("syntax_error"), "path", none))
    return found.orderBy(severity_rank(), "code", "file", "line")


def severity_rank(column: str = "severity") -> F.Column:
    return F.when(F.col(column) == "high", 0).when(F.col(column) == "medium", 1).when(F.col(column) == "low", 2).otherwise(3)
