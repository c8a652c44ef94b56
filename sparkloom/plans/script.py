"""A small script language: lexer, parser, compiler to plans, interpreter.

    use profile careful
    arg limit: int = 10
    let words = ["a", "b"]
    search query="main" limit=$limit
    sequence prepare { read "a.rs::main" }
    atomic { edit uri="x" }
    abort "reason"

A line is a statement; ``#`` and ``//`` begin comments, but ``#@name text`` annotates."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from .dag import MOST_DEPTH, MOST_PROGRAM_NODES, Node, Tools, resolve

_TOKEN = re.compile(r'''(?P<space>[ \t\r]+)|(?P<note>\#@[^\n]*)|(?P<comment>(?:\#|//)[^\n]*)|(?P<newline>[\n;]+)|(?P<long>"""(?:.|\n)*?""")|(?P<string>"(?:\\.|[^"\\\n])*")|(?P<number>-?\d+(?:\.\d+)?)|(?P<var>\$[A-Za-z_]\w*(?:\.\w+|\[\d+\])*)|(?P<word>[A-Za-z_][\w.:/@-]*)|(?P<mark>[{}\[\]=,:])''')
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
ANNOTATIONS = ("explain", "why", "risk", "review", "tag")


class ScriptError(ValueError):
    pass


def lex(source: str) -> list[tuple[str, Any, int]]:
    """(kind, value, line) of the source's tokens, with an ``end``."""
    out, at, line = [], 0, 1
    while at < len(source):
        m = _TOKEN.match(source, at)
        if not m:
            raise ScriptError(f"line {line}: unexpected {source[at]!r}")
        kind, text = m.lastgroup, m[0]
        if kind == "string":
            out.append(("value", re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), text[1:-1]), line))
        elif kind == "long":
            out.append(("value", text[3:-3], line))
        elif kind == "number":
            out.append(("value", float(text) if "." in text else int(text), line))
        elif kind == "word" and text.endswith(":"):  # a key or a typed name before its colon
            out += [("word", text.rstrip(":"), line), ("mark", ":", line)]
        elif kind not in ("space", "comment"):
            out.append((kind, text, line))
        line += text.count("\n")
        at = m.end()
    return [*out, ("end", None, line)]


@dataclass
class Script:
    metadata: dict[str, str] = field(default_factory=dict)
    notes: dict[str, list[str]] = field(default_factory=dict)
    args: list[dict[str, Any]] = field(default_factory=list)
    body: list[dict[str, Any]] = field(default_factory=list)


class Parser:
    def __init__(self, source: str):
        self.tokens, self.at = lex(source), 0

    def peek(self, ahead: int = 0) -> tuple[str, Any, int]:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)]

    def take(self, kind: str | None = None, value: Any = None) -> Any:
        found = self.peek()
        if kind and found[0] != kind or value is not None and found[1] != value:
            raise ScriptError(f"line {found[2]}: expected {value or kind}, found {found[1]!r}")
        self.at += 1
        return found[1]

    def is_mark(self, value: str, ahead: int = 0) -> bool:
        return self.peek(ahead)[:2] == ("mark", value)

    def skip_lines(self) -> None:
        while self.peek()[0] == "newline":
            self.at += 1

    def parse(self) -> Script:
        out = Script()
        self.skip_lines()
        while self.peek()[0] != "end":
            kind, value, line = self.peek()
            if kind == "note":
                name, _, text = self.take()[2:].partition(" ")
                if name not in ANNOTATIONS:
                    raise ScriptError(f"line {line}: no annotation {name}")
                out.notes.setdefault(name, []).append(text.strip())
            elif (kind, value) == ("word", "use"):
                self.take()
                directive = self.take("word")
                if directive not in ("profile", "session"):
                    raise ScriptError(f"line {line}: use profile or session, not {directive}")
                out.metadata[directive] = self.take("word")
            elif (kind, value) == ("word", "arg"):
                self.take()
                own: dict[str, Any] = {"name": self.take("word"), "type": None}
                if self.is_mark(":"):
                    self.take()
                    own["type"] = self.take("word")
                if self.is_mark("="):
                    self.take()
                    own["default"] = self.value()
                out.args.append(own)
            else:
                out.body.append(self.statement())
            if self.peek()[0] != "end":
                self.take("newline")
            self.skip_lines()
        return out

    def statement(self) -> dict[str, Any]:
        word = self.take("word")
        if word == "let":
            name = self.take("word")
            self.take("mark", "=")
            return {"op": "let", "name": name, "value": self.value()}
        if word == "abort":
            return {"op": "abort", "reason": str(self.value())}
        if word in ("sequence", "parallel", "atomic"):
            name = None if self.is_mark("{") else self.take("word")
            self.take("mark", "{")
            self.skip_lines()
            body = []
            while not self.is_mark("}"):
                body.append(self.statement())
                self.skip_lines()
            self.take()
            return {"op": word, "name": name, "body": body}
        named, positional = {}, []
        while self.peek()[0] not in ("newline", "end") and not self.is_mark("}"):
            if self.peek()[0] == "word" and self.is_mark("=", 1):
                name = self.take()
                self.take()
                named[name] = self.value()
            else:
                positional.append(self.value())
        return {"op": "call", "tool": word, "named": named, "positional": positional}

    def value(self) -> Any:
        kind, value, line = self.peek()
        if kind in ("value", "var"):
            return self.take()
        if kind == "word":
            return {"true": True, "false": False, "null": None}.get(self.take(), value)
        if self.is_mark("["):
            return self._list("]", self.value)
        if self.is_mark("{"):
            return dict(self._list("}", self._pair))
        raise ScriptError(f"line {line}: unexpected {value!r}")

    def _pair(self) -> tuple[str, Any]:
        if self.peek()[0] not in ("word", "value"):
            raise ScriptError(f"line {self.peek()[2]}: expected a key")
        key = str(self.take())
        self.take("mark", ":")
        return key, self.value()

    def _list(self, close: str, item) -> list:
        self.take()
        self.skip_lines()
        out = []
        while not self.is_mark(close):
            out.append(item())
            self.skip_lines()
            if self.is_mark(","):
                self.take()
                self.skip_lines()
            elif not self.is_mark(close):
                raise ScriptError(f"line {self.peek()[2]}: expected , or {close}")
        self.take()
        return out


def parse(source: str) -> Script:
    return Parser(source).parse()


def bind(script: Script, given: Mapping[str, Any]) -> dict[str, Any]:
    """Arguments by name: given ones, else defaults; ScriptError if one has neither, or none of that name is declared."""
    unknown = sorted(set(given) - {a["name"] for a in script.args})
    if unknown:
        raise ScriptError(f"no argument {unknown[0]}")
    out = {}
    for a in script.args:
        if a["name"] not in given and "default" not in a:
            raise ScriptError(f"argument {a['name']} is missing")
        out[a["name"]] = given.get(a["name"], a.get("default"))
    return out


def compile_plan(script: Script, given: Mapping[str, Any] | None = None) -> list[Node]:
    """PL5: the script as a chain of nodes. Names are resolved now; parallel blocks and abort can't be compiled."""
    variables, out = bind(script, given or {}), []

    def put(body: list[dict[str, Any]]) -> None:
        for s in body:
            if s["op"] == "let":
                variables[s["name"]] = resolve(s["value"], variables)
            elif s["op"] == "call":
                args = resolve(s["named"], variables) | ({"positional": resolve(s["positional"], variables)} if s["positional"] else {})
                out.append(Node(f"n{len(out)}", s["tool"], args, (out[-1].id,) if out else ()))
            elif s["op"] in ("sequence", "atomic"):
                put(s["body"])
            else:
                raise ScriptError(f"{s['op']} can't be compiled to a plan")

    put(script.body)
    return out


class Aborted(RuntimeError):
    pass


def run(script: Script, tools: Tools, given: Mapping[str, Any] | None = None, on_rollback=None) -> dict[str, Any]:
    """PL4: runs the statements in order and returns the variables; ``last`` is the last call's result. If an atomic block fails, variables are as before it, and on_rollback(name) may undo the rest."""
    variables: dict[str, Any] = bind(script, given or {})
    done = 0

    def go(body: list[dict[str, Any]], depth: int) -> None:
        nonlocal done
        if depth > MOST_DEPTH:
            raise ScriptError(f"blocks nest deeper than {MOST_DEPTH}")
        for s in body:
            done += 1
            if done > MOST_PROGRAM_NODES:
                raise ScriptError(f"over {MOST_PROGRAM_NODES} statements")
            if s["op"] == "let":
                variables[s["name"]] = resolve(s["value"], variables)
            elif s["op"] == "abort":
                raise Aborted(s["reason"])
            elif s["op"] == "call":
                named = resolve(s["named"], variables)
                positional = resolve(s["positional"], variables)
                variables["last"] = tools.call(s["tool"], **named, **({"positional": positional} if positional else {}))
            elif s["op"] == "sequence":
                go(s["body"], depth + 1)
            elif s["op"] == "atomic":
                before = dict(variables)
                try:
                    go(s["body"], depth + 1)
                except Exception:
                    variables.clear()
                    variables.update(before)
                    if on_rollback:
                        on_rollback(s["name"])
                    raise
            else:
                raise ScriptError("parallel blocks are not run")

    go(script.body, 1)
    return variables


def targets(script: Script) -> list[str]:
    """Resources that the script's calls name by uri, path or file."""
    out: list[str] = []

    def walk(body: list[dict[str, Any]]) -> None:
        for s in body:
            if s["op"] == "call":
                out.extend(str(v) for k, v in s["named"].items() if k in ("uri", "path", "file"))
            walk(s.get("body", []))

    walk(script.body)
    return sorted(set(out))
