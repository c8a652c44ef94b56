"""Predicates that allow, deny or audit requests, over tables of requests."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

# ---------------------------------------------------------------- fixed values: operations, capabilities and roles

OPERATION_OF_TOOL = {
    "search": "lookup", "find": "lookup", "contract": "lookup",
    "graph": "traverse", "crawl": "traverse", "frontier": "traverse", "diagram": "traverse",
    "read": "read", "doc": "read", "lsp": "read", "doctor": "read", "profile": "read", "debug": "read",
    "edit": "change", "manage_file": "change", "mutate": "change", "proposal": "change", "refactor": "change",
    "workspace": "session", "session": "session", "review_cycle": "session", "verify_impact": "session",
    "shell": "exec", "shell_status": "exec", "terminate": "exec", "build": "exec",
    "register_plan": "plan", "propose_plan": "plan", "execute_plan": "plan", "execute_active_plan": "plan", "delegate": "plan", "checkpoint": "plan",
    "context": "context",
}
CAPABILITY_OF_TOOL = {
    **{tool: op for tool, op in OPERATION_OF_TOOL.items() if op in ("lookup", "traverse", "read", "context")},
    "edit": "change.apply", "manage_file": "change.apply", "mutate": "change.apply", "proposal": "change.apply", "refactor": "change.apply",
    "workspace": "session.begin", "session": "session.verify", "review_cycle": "session.verify", "verify_impact": "session.verify",
    "shell": "exec.task", "shell_status": "exec.task", "terminate": "exec.task", "build": "exec.task",
    "register_plan": "plan.create", "propose_plan": "plan.create", "execute_plan": "plan.execute", "execute_active_plan": "plan.execute", "delegate": "plan.parallel", "checkpoint": "plan.parallel",
    "plugin_tool": "plugin.manage", "plugin_language": "plugin.manage", "plugin_trust": "plugin.trust",
}
_READING = ("read", "search", "graph", "doc")
ROLE_CAPABILITIES = {
    "planner": (*_READING, "plan_create", "plan_simulate", "plan_compare"),
    "reviewer": (*_READING, "plan_compare", "plan_review"),
    "observer": _READING,
}
#: What a light runtime may do.
LITE_OPERATIONS = ("lookup", "traverse", "read", "session")
REDACTED_KEYS = ("code", "snippet", "signature_hex", "nonce", "session_token", "original_code", "mutated_code")
SHELL_METACHARACTERS = (";", "&", "|", "`", "$(")


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for x in chain.from_iterable(sorted(values.items()))))


def operation_of(tool: Column) -> Column:
    """PF8."""
    return F.coalesce(F.try_element_at(_map(OPERATION_OF_TOOL), tool), F.lit("other"))


def capability_of(tool: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(CAPABILITY_OF_TOOL), tool), operation_of(tool))


def role_allows(role: Column, capability: Column) -> Column:
    """PF7: owners may do all, editors all but bind roles, others what their role lists."""
    out = F.lit(False)
    for name, allowed in ROLE_CAPABILITIES.items():
        out = F.when(role == name, capability.isin(*allowed)).otherwise(out)
    return F.when(role == "owner", F.lit(True)).when(role == "editor", capability != "role_bind").otherwise(out)


def glob(path: Column, patterns: Sequence[str]) -> Column:
    """Whether a path matches one of the patterns: * and ? within or across segments, [..] as a class."""
    out = F.lit(False)
    for p in patterns:
        body = "".join(".*" if c == "*" else "." if c == "?" else c if c in "[]" else re.escape(c) for c in p)
        out = out | path.rlike(f"^(?s:{body})$")
    return out


def normal_path(path: Column) -> Column:
    """A relative path without ``./`` and doubled slashes; ``..`` takes away the segment before it, and stays at the start."""
    step = F.aggregate(
        F.filter(F.split(path, "/+"), lambda x: ~x.isin("", ".")),
        F.array().cast("array<string>"),
        lambda acc, x: F.when((x == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != ".."), F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.array_append(acc, x)),
    )
    return F.concat(F.when(path.startswith("/"), F.lit("/")).otherwise(""), F.array_join(step, "/"))


def evaluate(requests: DataFrame, mode: str = "permissive", allow: Sequence[str] = (), block: Sequence[str] = (), protected: Sequence[str] = (), state_dirs: Sequence[str] = (), binaries: Sequence[str] = ()) -> DataFrame:
    """PF5: requests (tool, path, uri, command, is_human) with decision (allow, deny, audit) and rule. Rules hold in order: what only
    people may touch, the sandbox, shell commands, the blocklist, the allowlist, protected symbols, then the mode."""
    path = normal_path(F.col("path"))
    has_path = F.col("path").isNotNull()
    agent = ~F.coalesce("is_human", F.lit(False))
    state = F.lit(False)
    for name in state_dirs:
        state = state | (path == name) | path.startswith(f"{name}/")
    shell = agent & (F.col("tool") == "shell") & F.col("command").isNotNull()
    chained = F.lit(False)
    for c in SHELL_METACHARACTERS:
        chained = chained | F.contains("command", F.lit(c))
    program = F.regexp_extract("command", r"^\s*(\S*)", 1)
    unlisted = ~program.isin(*binaries) if binaries else F.lit(False)
    fallback = {
        "strict": F.when(has_path, F.lit("deny:strict_path")).when(~F.col("tool").isin("search", "graph", "workspace"), "deny:strict_tool").otherwise("allow:strict"),
        "audit": F.lit("audit:audit"),
    }.get(mode, F.lit("allow:permissive"))
    rule = (
        F.when(agent & has_path & state, "deny:state")
        .when(agent & has_path & (path.startswith("..") | path.startswith("/")), "deny:sandbox")
        .when(shell & chained, "deny:chaining")
        .when(shell & unlisted, "deny:binary")
        .when(has_path & glob(path, block), "deny:blocklist")
        .when(has_path & glob(path, allow), "allow:allowlist")
        .when((F.col("tool") == "edit") & F.col("uri").isin(*protected) if protected else F.lit(False), "deny:protected")
        .otherwise(fallback)
    )
    return requests.withColumn("rule", rule).withColumns({"decision": F.substring_index("rule", ":", 1), "rule": F.substring_index("rule", ":", -1)})


def evaluate_operations(requests: DataFrame, ceiling: str = "full", capabilities: Sequence[str] = (), session_required: bool = False, raw_commands: bool = True) -> DataFrame:
    """PF6: requests (tool, action, is_human, session_open) with decision and rule: the runtime's ceiling, what only people may do, the profile's capabilities, sessions."""
    tool, agent = F.col("tool"), ~F.coalesce("is_human", F.lit(False))
    op = operation_of(tool)
    human_only = agent & ((tool.isin("plugin_tool", "plugin_language") & F.col("action").isin("add", "remove")) | ((tool == "plugin_trust") & F.col("action").isin("add", "remove", "enable", "disable")))
    rule = (
        F.when(F.lit(ceiling == "lite") & ~op.isin(*LITE_OPERATIONS), "deny:ceiling")
        .when(human_only, "deny:human_only")
        .when(~capability_of(tool).isin(*capabilities) if capabilities else F.lit(False), "deny:capability")
        .when(F.lit(session_required) & op.isin("change", "exec") & ~F.coalesce("session_open", F.lit(False)), "deny:session")
        .when(F.lit(not raw_commands) & (tool == "shell"), "deny:raw_command")
        .otherwise("allow:operation")
    )
    return requests.withColumn("rule", rule).withColumns({"decision": F.substring_index("rule", ":", 1), "rule": F.substring_index("rule", ":", -1)})


def unexpired(locks: DataFrame, now: Column) -> DataFrame:
    """PF9."""
    return locks.where(F.col("expires_at") > now)


def tool_allowed(tool: Column, allow: Sequence[str] = (), deny: Sequence[str] = ()) -> Column:
    """PF10: a denied tool is out; an empty allowlist lets all others in."""
    return ~tool.isin(*deny) & (tool.isin(*allow) if allow else F.lit(True))


def safe_path(path: Column) -> Column:
    """PF12: relative, not out of its root, no environment file, no control characters."""
    own = normal_path(path)
    return F.coalesce(~own.startswith("/") & ~own.startswith("..") & ~own.rlike(r"(^|/)\.env($|[./])") & ~path.rlike(r"[\x00-\x1f]"), F.lit(False))


#: Extensions of source files, and endings of test files.
SOURCE_EXTENSIONS = ("rs", "py", "js", "ts", "tsx", "go", "c", "cpp", "cc", "cxx", "java", "kt", "swift")
TEST_ENDINGS = ("_test.rs", "_test.py", ".spec.js", ".test.js", ".spec.ts", ".test.ts", ".spec.tsx", ".test.tsx")


def is_source_file(path: Column) -> Column:
    """PF13."""
    own = F.replace(path, F.lit("\\"), F.lit("/"))
    return ~own.rlike("/tests?/") & F.substring_index(own, ".", -1).isin(*SOURCE_EXTENSIONS) & own.contains(".")


def is_test_file(path: Column) -> Column:
    own = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return own.rlike("/tests?/|(" + "|".join(map(re.escape, TEST_ENDINGS)) + ")$")


def redact(value: object, keys: Sequence[str] = REDACTED_KEYS) -> object:
    """A parsed JSON value with the keys' values replaced, at any depth."""
    if isinstance(value, dict):
        return {k: "[REDACTED]" if k in keys else redact(v, keys) for k, v in value.items()}
    return [redact(v, keys) for v in value] if isinstance(value, list) else value


def redacted(rows: DataFrame, column: str, keys: Sequence[str] = REDACTED_KEYS) -> DataFrame:
    """PF11: rows with a column of JSON texts redacted; null and what is no JSON stay."""
    names = rows.columns
    at = names.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [_redact_text(x, keys) for x in batch.column(at).to_pylist()]
            yield batch.set_column(at, column, pa.array(own, pa.string()))

    return rows.mapInArrow(run, rows.schema)


def _redact_text(text: str | None, keys: Sequence[str]) -> str | None:
    if text is None or not any(k in text for k in keys):
        return text
    try:
        return json.dumps(redact(json.loads(text), keys), ensure_ascii=False, separators=(",", ":"))
    except ValueError:
        return text
