"""Source trees as tables: scans, filters and deltas."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.paths import extension

#: Extensions of the files that are kept, fixed values.
EXTENSIONS = ("rs", "py", "js", "ts", "tsx", "jsx", "go", "c", "h", "cpp", "hpp", "java")
#: Directories that a manifest in the tree's root excludes, fixed values.
EXCLUDED_BY_MANIFEST = {"Cargo.toml": ("target",), "package.json": ("node_modules", "dist", "build"), "pyproject.toml": (".venv", "venv", "__pycache__", "dist"), "pixi.toml": (".pixi",), "CMakeLists.txt": ("build",), "go.mod": ("vendor",), "DEPS": ("out",)}


def scan(spark: SparkSession, root: str, extensions: Sequence[str] = EXTENSIONS, ignored: Sequence[str] = ()) -> DataFrame:
    """SC1: files (filepath, mtime, file_size, content) below root: none hidden, none in excluded directories, none that an ignore pattern matches; of the extensions named, or all if none are. Spark's file sources leave out files of no bytes."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.lit(root.rstrip("/").split("://")[-1].removeprefix("file:"))
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:(//[^/]*)?", ""), "^/+", "/")
    files = raw.select(F.ltrim(F.substr(path, F.length(base) + 1), F.lit("/")).alias("filepath"), F.col("modificationTime").alias("mtime"), F.col("length").alias("file_size"), F.decode("content", "UTF-8").alias("content"))
    kept = files.where(~F.col("filepath").rlike(r"(^|/)\."))
    if ignored:
        kept = kept.where(~ignore(F.col("filepath"), ignored))
    excluded = excluded_dirs(files)
    out = kept.join(excluded, F.contains(F.concat(F.lit("/"), "filepath"), F.concat(F.lit("/"), "dir", F.lit("/"))), "left_anti")
    return out.where(extension(F.col("filepath")).isin(*extensions)) if extensions else out


def excluded_dirs(files: DataFrame) -> DataFrame:
    """SC3: (dir) that the manifests in the root exclude; the list of manifests is fixed, so it is small."""
    rows = [(m, d) for m, dirs in EXCLUDED_BY_MANIFEST.items() for d in dirs]
    known = F.broadcast(files.sparkSession.createDataFrame(rows, "manifest string, dir string"))
    return files.select("filepath").join(known, F.col("filepath") == F.col("manifest")).select("dir").distinct()


def ignore(path: Column, patterns: Sequence[str]) -> Column:
    """Whether ignore patterns, the last that matches counting, leave a path out: ``*`` within a segment, ``**`` across, a slash at the start or within anchors, one at the end means a directory, ``!`` takes back."""
    out = F.lit(False)
    for p in patterns:
        p = p.strip()
        if not p or p.startswith("#"):
            continue
        back, p = p.startswith("!"), p.lstrip("!")
        folder, p = p.endswith("/"), p.rstrip("/")
        anchored, p = "/" in p, p.lstrip("/")
        parts = re.split(r"(\*\*/?|\*|\?)", p)
        body = "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(x, re.escape(x)) for x in parts)
        hit = path.rlike(("^" if anchored else "(^|/)") + body + ("/" if folder else "(/|$)"))
        out = F.when(hit, F.lit(not back)).otherwise(out)
    return out


def listing(files: DataFrame, prefix: str = "") -> DataFrame:
    """SC2: paths under a prefix in order."""
    return files.where(F.col("filepath").startswith(prefix)).select("filepath").orderBy("filepath")


def scoped(files: DataFrame, prefixes: Sequence[str]) -> DataFrame:
    """SC8."""
    return files.where(reduce(lambda a, b: a | b, (F.col("filepath").startswith(p) for p in prefixes), F.lit(False)))


def containing(files: DataFrame, query: str) -> DataFrame:
    """SC9: files whose content holds the query, whatever the case."""
    return files.where(F.contains(F.lower("content"), F.lit(query.lower())))


def size_guard(files: DataFrame, max_size: int = 512 * 1024, policy: str = "skip") -> DataFrame:
    """SC10: large files are left out, kept without content (skeleton), or kept in full."""
    large = F.col("file_size") > max_size
    if policy == "skip":
        return files.where(~large)
    if policy == "skeleton":
        return files.withColumn("content", F.when(~large, F.col("content")))
    if policy == "full":
        return files
    raise ValueError(f"no policy {policy}")


def delta(current: DataFrame, stored: DataFrame) -> DataFrame:
    """SC7: files (filepath, mtime, file_size, ...) that are new, or whose size or time isn't what is stored."""
    old = stored.select("filepath", F.col("mtime").alias("old_mtime"), F.col("file_size").alias("old_size"))
    joined = current.join(old, "filepath", "left")
    same = F.col("mtime").eqNullSafe(F.col("old_mtime")) & F.col("file_size").eqNullSafe(F.col("old_size"))
    return joined.where(~same).drop("old_mtime", "old_size")


def removed(current: DataFrame, stored: DataFrame) -> DataFrame:
    return stored.join(current.select("filepath"), "filepath", "left_anti")


def by_ids(rows: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    """SC6: rows of the ids in a table."""
    return rows.join(ids.select(column).distinct(), column, "left_semi")
