"""Plans: named steps over DataFrames, validated, ordered and run with retries; and the gates of change proposals."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.policy import OPERATION_OF_TOOL

#: Limits of plans, fixed values.
MOST_NODES, MOST_DEPENDENCIES, MOST_RETRIES, MOST_OUTPUT = 128, 32, 3, 1 << 20
#: Depth and nodes of nested programs.
MOST_DEPTH, MOST_PROGRAM_NODES = 8, 256
INTERNAL_COMMANDS = ("checkpoint", "clear_cache", "set")


@dataclass
class Node:
    id: str
    tool: str
    args: dict[str, Any] = field(default_factory=dict)
    depends_on: tuple[str, ...] = ()
    retry_limit: int = 0
    output_limit: int = MOST_OUTPUT
    internal: bool = False


class Tools:
    """Functions by name, each from keyword arguments to a result, mostly a lazy DataFrame."""

    def __init__(self) -> None:
        self._tools: dict[str, Callable[..., Any]] = {}

    def register(self, name: str) -> Callable[[Callable], Callable]:
        def put(function: Callable) -> Callable:
            self._tools[name] = function
            return function

        return put

    def names(self) -> list[str]:
        return sorted(self._tools)

    def __contains__(self, name: str) -> bool:
        return name in self._tools

    def call(self, name: str, **args: Any) -> Any:
        if name not in self._tools:
            raise KeyError(f"no tool {name}")
        return self._tools[name](**args)


def limited(function: type, seconds: float | None, most_bytes: int | None) -> type:
    """A table function that raises once a call takes longer, or gives more bytes as text, than allowed; told from row to row."""

    class Limited(function):
        def eval(self, *args: Any):
            began, size = time.monotonic(), 0
            for row in super().eval(*args) or ():
                size += sum(len(str(x).encode("utf-8", "replace")) for x in (row if isinstance(row, (tuple, list)) else (row,)))
                if most_bytes is not None and size > most_bytes:
                    raise RuntimeError(f"over {most_bytes} bytes of output")
                if seconds is not None and time.monotonic() - began > seconds:
                    raise RuntimeError(f"over {seconds} seconds")
                yield row

    return Limited


def register_table_function(spark: SparkSession, name: str, function: type, returns: str, seconds: float | None = None, most_bytes: int | None = None) -> None:
    """Makes a Python table function callable from SQL, within limits on a call's time and output."""
    from pyspark.sql.functions import udtf

    spark.udtf.register(name, udtf(limited(function, seconds, most_bytes), returnType=returns))


# ---------------------------------------------------------------- variables

_PATH = re.compile(r"\$([A-Za-z_]\w*)((?:\.\w+|\[\d+\])*)")


def lookup(path: str, variables: Mapping[str, Any]) -> Any:
    """the value of ``$a.b[0].c``; a step that leads nowhere leaves the value before it; KeyError if there is no variable."""
    m = _PATH.fullmatch(path)
    if not m or m[1] not in variables:
        raise KeyError(path)
    value = variables[m[1]]
    for name, index in re.findall(r"\.(\w+)|\[(\d+)\]", m[2]):
        try:
            value = value[int(index)] if index else value[name]
        except (KeyError, IndexError, TypeError):
            continue
    return value


def resolve(value: Any, variables: Mapping[str, Any]) -> Any:
    """Values with variables put in: a whole ``$path`` gives the value itself, within a text its text."""
    if isinstance(value, str):
        if _PATH.fullmatch(value):
            try:
                return lookup(value, variables)
            except KeyError:
                return value
        return _PATH.sub(lambda m: str(lookup(m[0], variables)) if m[1] in variables else m[0], value)
    if isinstance(value, dict):
        return {k: resolve(v, variables) for k, v in value.items()}
    return [resolve(v, variables) for v in value] if isinstance(value, (list, tuple)) else value


def substitute(value: Any, variables: Mapping[str, Any]) -> Any:
    """``${name}`` in texts at any depth."""
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)\}", lambda m: str(variables[m[1]]) if m[1] in variables else m[0], value)
    if isinstance(value, dict):
        return {k: substitute(v, variables) for k, v in value.items()}
    return [substitute(v, variables) for v in value] if isinstance(value, (list, tuple)) else value


# ---------------------------------------------------------------- validation and order


def validate(nodes: Sequence[Node], tools: Tools | None = None, is_human: bool = False) -> list[str]:
    """PL3: what is wrong with a plan; empty if nothing is."""
    out = [f"over {MOST_NODES} nodes"] if len(nodes) > MOST_NODES else []
    ids = [n.id for n in nodes]
    out += [f"duplicate id {i}" for i in sorted({i for i in ids if ids.count(i) > 1})]
    for n in nodes:
        if len(n.depends_on) > MOST_DEPENDENCIES:
            out.append(f"{n.id}: over {MOST_DEPENDENCIES} dependencies")
        if n.retry_limit > MOST_RETRIES:
            out.append(f"{n.id}: over {MOST_RETRIES} retries")
        if not 0 < n.output_limit <= MOST_OUTPUT:
            out.append(f"{n.id}: output limit not in 1 to {MOST_OUTPUT}")
        if n.internal and n.tool not in INTERNAL_COMMANDS:
            out.append(f"{n.id}: no internal command {n.tool}")
        if n.internal and n.tool == "clear_cache" and not is_human:
            out.append(f"{n.id}: {n.tool} is for people only")
        if tools and not n.internal and n.tool not in tools:
            out.append(f"{n.id}: no tool {n.tool}")
    try:
        order(nodes)
    except ValueError as e:
        out.append(str(e))
    return out


def validate_table(nodes: DataFrame) -> DataFrame:
    """PL3 on a table (id, depends_on, retry_limit, output_limit): (id, problem)."""
    problems = F.array_compact(F.array(
        F.when(F.size("depends_on") > MOST_DEPENDENCIES, F.lit("dependencies")), F.when(F.col("retry_limit") > MOST_RETRIES, F.lit("retries")),
        F.when((F.col("output_limit") < 1) | (F.col("output_limit") > MOST_OUTPUT), F.lit("output_limit")),
    ))
    own = nodes.select("id", F.explode(problems).alias("problem"))
    return own.union(nodes.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate").alias("problem")))


def order(nodes: Sequence[Node]) -> list[Node]:
    """PL1: nodes after what they depend on, otherwise as given; dependencies that don't exist are ignored; a cycle raises ValueError."""
    place = {n.id: k for k, n in enumerate(nodes)}
    sorter = TopologicalSorter({n.id: [d for d in n.depends_on if d in place] for n in nodes})
    try:
        sorter.prepare()
    except CycleError as e:
        raise ValueError(f"the plan has a cycle: {' '.join(e.args[1])}") from None
    out = []
    while sorter.is_active():
        ready = sorted(sorter.get_ready(), key=place.__getitem__)
        out += ready
        sorter.done(*ready)
    by_id = {n.id: n for n in nodes}
    return [by_id[i] for i in out]


def simulate(nodes: Sequence[Node], tools: Tools | None = None) -> dict[str, Any]:
    """PL6: findings of a dry run: what is invalid, what changes things, what depends on nothing there is."""
    ids = {n.id for n in nodes}
    warnings = [f"{n.id}: unknown dependency {d}" for n in nodes for d in n.depends_on if d not in ids]
    warnings += [f"{n.id}: {n.tool} changes or runs something" for n in nodes if OPERATION_OF_TOOL.get(n.tool) in ("change", "exec")]
    findings = validate(nodes, tools)
    return {"status": "blocked" if findings else "ok", "findings": findings, "warnings": warnings, "steps": len(nodes)}


# ---------------------------------------------------------------- execution


@dataclass
class Run:
    results: dict[str, Any] = field(default_factory=dict)
    log: list[dict[str, Any]] = field(default_factory=list)
    status: str = "ok"

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(x[k] for k in ("seq", "node", "tool", "status", "attempt", "ms", "error")) for x in self.log], "seq long, node string, tool string, status string, attempt int, ms long, error string")


def execute(nodes: Sequence[Node], tools: Tools, stop_on_failure: bool = True, on_checkpoint: Callable[[Run], None] | None = None) -> Run:
    """PL1, PL2: runs a valid plan in order. A node's arguments may name results as ``$id``; a failing node is tried again up to its limit; after a failure what depends on it is skipped, and everything else too if stop_on_failure."""
    if problems := validate(nodes, tools):
        raise ValueError("; ".join(problems))
    run, failed = Run(), set()
    for node in order(nodes):
        if (run.status == "failed" and stop_on_failure) or failed & set(node.depends_on):
            failed.add(node.id)
            run.log.append({"seq": len(run.log), "node": node.id, "tool": node.tool, "status": "skipped", "attempt": 0, "ms": 0, "error": None})
            continue
        for attempt in range(node.retry_limit + 1):
            began, error = time.monotonic(), None
            try:
                run.results[node.id] = None if node.internal else tools.call(node.tool, **resolve(node.args, run.results))
            except Exception as e:  # a tool may fail in any way; the log keeps how
                error = f"{type(e).__name__}: {e}"
            run.log.append({"seq": len(run.log), "node": node.id, "tool": node.tool, "status": "failed" if error else "ok", "attempt": attempt, "ms": int(1000 * (time.monotonic() - began)), "error": error})
            if not error:
                break
        else:
            run.status = "failed"
            failed.add(node.id)
        if on_checkpoint:
            on_checkpoint(run)
    return run


# ---------------------------------------------------------------- gates


def can_approve(simulate_status: str | None, crawl_status: str | None, gated_snapshot: str | None, current_snapshot: str) -> tuple[bool, str]:
    """PL7: whether a proposal may be approved, or why not."""
    if simulate_status != "ok":
        return False, "simulate is not ok"
    if crawl_status != "ok":
        return False, "crawl is not ok"
    if gated_snapshot is None:
        return False, "no gate was run"
    if gated_snapshot != current_snapshot:
        return False, "the workspace changed since the gate"
    return True, ""


def commit_gate(report: DataFrame, most_high: int = 0, least_cohesion: float = 0.0) -> DataFrame:
    """PL7: reports (proposal, high, cohesion_ratio, simulate, crawl, gated, current) with ``approved`` and the first reason against."""
    reason = (
        F.when(~F.col("simulate").eqNullSafe(F.lit("ok")), "simulate").when(~F.col("crawl").eqNullSafe(F.lit("ok")), "crawl").when(F.col("gated").isNull(), "gate").when(F.col("gated") != F.col("current"), "drift")
        .when(F.col("high") > most_high, "findings").when(F.col("cohesion_ratio") < least_cohesion, "cohesion")
    )
    return report.withColumn("reason", reason).withColumn("approved", F.col("reason").isNull())
