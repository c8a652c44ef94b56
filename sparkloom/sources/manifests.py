"""Dependencies that package manifests declare."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Manifests by file name: the manager and its rank; the lowest rank of a tree counts.
MANIFESTS = {"Cargo.toml": ("cargo", 0), "pixi.toml": ("pixi", 1), "pyproject.toml": ("python", 2), "package.json": ("npm", 3), "DEPS": ("gn", 4), ".gn": ("gn", 4), "CMakeLists.txt": ("cmake", 5), "Makefile": ("make", 6), "go.mod": ("go", 7)}
_REQUIREMENT = re.compile(r"^\s*([A-Za-z0-9][\w.-]*)(?:\[[^\]]*\])?\s*(.*?)\s*(?:;.*)?$")

Row = tuple[str, str | None, str]


def _version(value: object) -> str | None:
    if isinstance(value, dict):
        for key in ("version", "git", "path"):
            if key in value:
                return str(value[key])
        return None
    return str(value)


def _table(found: object, kind: str) -> Iterator[Row]:
    if isinstance(found, dict):
        for name, value in found.items():
            yield name, _version(value), kind


def _requirements(found: Iterable[str], kind: str) -> Iterator[Row]:
    for text in found:
        if m := _REQUIREMENT.match(text):
            yield m[1], m[2] or None, kind


def parse(name: str, content: str) -> list[Row]:
    """(dependency, version, kind) of a manifest; what doesn't parse declares nothing."""
    try:
        if name == "Cargo.toml":
            data = tomllib.loads(content)
            tables = [data, data.get("workspace", {}), *data.get("target", {}).values()]
            return [row for t in tables for key, kind in (("dependencies", "runtime"), ("dev-dependencies", "dev"), ("build-dependencies", "build")) for row in _table(t.get(key), kind)]
        if name == "pixi.toml":
            data = tomllib.loads(content)
            features = [row for feature in data.get("feature", {}).values() for row in _table(feature.get("dependencies"), "optional")]
            return [*_table(data.get("dependencies"), "runtime"), *_table(data.get("pypi-dependencies"), "runtime"), *features]
        if name == "pyproject.toml":
            data = tomllib.loads(content)
            project, tool = data.get("project", {}), data.get("tool", {})
            out = list(_requirements(project.get("dependencies", ()), "runtime"))
            for group in project.get("optional-dependencies", {}).values():
                out += _requirements(group, "optional")
            for group in data.get("dependency-groups", {}).values():
                out += _requirements((x for x in group if isinstance(x, str)), "dev")
            out += _requirements(tool.get("uv", {}).get("dev-dependencies", ()), "dev")
            poetry = tool.get("poetry", {})
            out += (row for row in _table(poetry.get("dependencies"), "runtime") if row[0] != "python")
            for group in poetry.get("group", {}).values():
                out += _table(group.get("dependencies"), "dev")
            return out
        if name == "package.json":
            data = json.loads(content)
            return [row for key, kind in (("dependencies", "runtime"), ("devDependencies", "dev"), ("peerDependencies", "peer"), ("optionalDependencies", "optional")) for row in _table(data.get(key), kind)]
        if name == "go.mod":
            return [(m[1], m[2], "runtime") for m in re.finditer(r"^\s*(?:require\s+)?([\w.-]+\.[\w./-]+)\s+(v\S+)", content, re.M)]
        if name == "CMakeLists.txt":
            return [(m[1], m[2], "runtime") for m in re.finditer(r"(?i)\bfind_package\s*\(\s*(\w+)(?:\s+([\d.]+))?", content)]
        if name == "DEPS":
            return [(m[1], m[2], "runtime") for m in re.finditer(r"['\"]([\w./-]+)['\"]\s*:\s*['\"][^'\"@]*@([\w.]+)['\"]", content)]
    except (tomllib.TOMLDecodeError, ValueError, AttributeError, TypeError):
        return []
    return []


def dependencies(files: DataFrame) -> DataFrame:
    """SC4: (name, version, kind, manager, manifest) that the first manifest by rank in the root of a tree (filepath, content) declares."""
    own = files.where(F.col("filepath").isin(*MANIFESTS)).select("filepath", "content")
    out = pa.schema([("name", pa.string()), ("version", pa.string()), ("kind", pa.string()), ("manager", pa.string()), ("manifest", pa.string()), ("rank", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(*row, *MANIFESTS[path][:1], path, MANIFESTS[path][1]) for path, content in zip(*(c.to_pylist() for c in batch.columns)) for row in parse(path, content or "")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    found = own.mapInArrow(run, "name string, version string, kind string, manager string, manifest string, rank int")
    ranks = F.create_map(*(F.lit(x) for name, (_, rank) in MANIFESTS.items() for x in (name, rank)))
    first = own.agg(F.min(ranks[F.col("filepath")]).alias("first"))  # the manifest that is there, whether or not it declares anything
    return found.join(F.broadcast(first), F.col("rank") == F.col("first")).drop("rank", "first")
