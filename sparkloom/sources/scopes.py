"""Declarations of C-like languages by tokens and nesting: what a word declares depends on the scope in which it stands."""

from __future__ import annotations

import re

_STRING, _PLAIN = r'"(?:\\.|[^"\\\n])*"?', r"//[^\n]*|/\*[^*]*+(?:\*(?!/)[^*]*+)*+(?:\*/|\Z)"
_WORD = r"[^\W\d][\w$]*|[$#][\w$]+|\d[\w.]*"
#: What tokens of a family of languages look like: what is left out, texts, words and marks. Templates and literal patterns of scripts are read by Tokens.
_FAMILIES = {
    "script": (rf"\s+|{_PLAIN}", rf"{_STRING}|'(?:\\.|[^'\\\n])*'?", _WORD, r"=>|\?\.|\.\.\.|&&|\|\||\?\?|[=!<>]=+|."),
    "java": (rf"\s+|{_PLAIN}", rf'""".*?(?:"""|\Z)|{_STRING}|' + r"'(?:\\.|[^'\\\n])*'?", _WORD, r"->|::|."),
    "c": (rf"\s+|{_PLAIN}|^[^\S\n]*#(?:\\\n|[^\n])*", rf'\bR"(?P<raw>\w*)\(.*?(?:\)(?P=raw)"|\Z)|{_STRING}|' + r"'(?:\\.|[^'\\\n])*'?", _WORD, r"->|::|&&|."),
}
_COMPILED = {k: re.compile(f"(?P<skip>{skip})|(?P<text>{text})|(?P<word>{word})|(?P<mark>{mark})", re.S | re.M) for k, (skip, text, word, mark) in _FAMILIES.items()}
_PATTERN = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/\w*")
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$]++)*", re.S)
#: Words of scripts after which a slash begins a pattern, fixed values.
_BEFORE_PATTERN = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "yield", "await", "instanceof"}
_CLOSES, _OPENS = {")": "(", "]": "[", "}": "{"}, "([{"


class Tokens:
    """A file's tokens without comments. Texts are the token '""'; ``wrong`` counts brackets that belong to none."""

    def __init__(self, content: str, family: str):
        self.content, self.text, self.at, self.stop, self.fresh = content, [], [], [], []
        self.close, self.opened, self.wrong = {}, {}, 0
        script, scan = family == "script", _COMPILED[family].match
        held: list[int] = []  # brackets that are open; those of a template's expression are told by being in templates
        templates: set[int] = set()
        at, fresh = 0, True
        while at < len(content):
            if script and content[at] == "`":
                at = self._template(at, at + 1, held, templates, fresh)
                fresh = False
                continue
            if script and content[at] == "/" and content[at + 1 : at + 2] not in ("/", "*") and self._begins_pattern() and (m := _PATTERN.match(content, at)):
                self._put('""', at, m.end(), fresh)
                at, fresh = m.end(), False
                continue
            m = scan(content, at)
            kind, end = m.lastgroup if m.lastgroup != "raw" else "text", m.end()
            if kind == "skip":
                fresh = fresh or "\n" in m[0]
            else:
                word = '""' if kind == "text" else m[0]
                here = self._put(word, at, end, fresh)
                fresh = False
                if word in ("(", "[", "{"):
                    held.append(here)
                elif word in _CLOSES:
                    if held and self.text[held[-1]] == _CLOSES[word]:
                        first = held.pop()
                        self.close[first], self.opened[here] = here, first
                        if first in templates:
                            end = self._template(end, end, held, templates, False)
                    else:
                        self.wrong += 1
            at = end
        self.wrong += len(held)

    def _put(self, word: str, at: int, stop: int, fresh: bool) -> int:
        self.text.append(word), self.at.append(at), self.stop.append(stop), self.fresh.append(fresh)
        return len(self.text) - 1

    def _template(self, first: int, at: int, held: list[int], templates: set[int], fresh: bool) -> int:
        """Reads on in a template, to its end or to an expression in it, which is a bracket."""
        at = _TEMPLATE.match(self.content, at).end()
        self._put('""', first, at, fresh)
        if self.content[at : at + 2] == "${":
            here = self._put("{", at, at + 2, False)
            held.append(here), templates.add(here)
            return at + 2
        return min(at + 1, len(self.content))

    def _begins_pattern(self) -> bool:
        before = self.text[-1] if self.text else ""
        return before in _BEFORE_PATTERN or not (before in (")", "]", "}", '""') or before[-1:].isalnum() or before[-1:] in "_$")

    def of(self, k: int) -> str:
        return self.text[k] if 0 <= k < len(self.text) else ""

    def is_name(self, k: int) -> bool:
        return self.of(k)[:1].isalpha() or self.of(k)[:1] in ("_", "$")

    def after(self, k: int) -> int:
        """The next token; after a bracket's match if there is one."""
        return self.close.get(k, k) + 1

    def past_generics(self, k: int) -> int:
        """Behind <...> at k, or k."""
        if self.of(k) != "<":
            return k
        depth = 0
        while k < len(self.text):
            mark = self.text[k]
            depth += (mark == "<") - mark.count(">") * (mark in (">", ">>", ">>>"))
            if depth <= 0:
                return k + 1
            if mark == ";":
                break
            k = self.after(k) if mark in _OPENS else k + 1
        return k


class Scan:
    """Walks over tokens with the kinds of the scopes around; kinds of bodies are planned where their heads are read."""

    family, outermost = "script", "block"

    def __init__(self, content: str):
        self.t = Tokens(content, self.family)
        self.found: dict[int, tuple[str, str, str, int, int]] = {}
        self.planned: dict[int, str] = {}

    def declarations(self) -> list[tuple[str, str, str, int, int]]:
        """(name, kind, role, start, end) in characters."""
        t, scopes = self.t, [self.outermost]
        for k, word in enumerate(t.text):
            if k in t.opened:
                scopes.pop()
                continue
            self.look(k, word, scopes[-1])
            if k in t.close:
                scopes.append(self.planned.get(k) or (self.brace(k, scopes[-1]) if word == "{" else "inner"))
        return list(self.found.values())

    def put(self, name: int, kind: str, first: int, last: int, role: str = "definition") -> None:
        start = self.t.at[first]
        self.found.setdefault(start, (self.t.text[name], kind, role, start, self.t.stop[min(last, len(self.t.text) - 1)]))

    def body(self, k: int, plan: str) -> int | None:
        """The closing bracket of a body that opens at k, whose scope is planned."""
        self.planned[k] = plan
        return self.t.close.get(k, len(self.t.text) - 1)

    def look(self, k: int, word: str, scope: str) -> None:
        raise NotImplementedError

    def brace(self, k: int, scope: str) -> str:
        return "block"


_MODIFIERS = {"async", "static", "get", "set", "public", "private", "protected", "readonly", "override", "accessor", "declare", "abstract"}
_GOES_ON = {"=", "=>", "(", "[", ",", ".", "?.", ":", "?", "&&", "||", "??", "+", "-", "*", "/", "%", "<", ">", "&", "|", "^", "!", "~", "...", "return", "new", "typeof", "extends", "implements", "case", "in", "of", "instanceof", "throw", "await", "yield", "void", "delete", "=="}
_TYPE_GOES_ON = {":", "|", "&", "=>", "<", ",", "(", "extends", "keyof", "typeof", "is", "asserts", "."}
_OBJECT_AFTER = {"=", "(", ",", "[", "?", "&&", "||", "??", "return", "default", "...", "yield", "await", "throw"}


class Script(Scan):
    """JavaScript; with types, TypeScript."""

    typed = False

    def begins(self, k: int) -> bool:
        before = self.t.of(k - 1)
        return before in ("", "{", "}", ";", ")", "else", "do", ":") or (self.t.fresh[k] and before not in _GOES_ON)

    def brace(self, k: int, scope: str) -> str:
        before = self.t.of(k - 1)
        return "object" if before in _OBJECT_AFTER or (before == ":" and scope in ("object", "inner")) else "block"

    def head_end(self, k: int) -> int | None:
        """The body's bracket of a head whose parameters open at k, None without a body."""
        t = self.t
        if t.of(k) != "(" or k not in t.close:
            return None
        k = t.close[k] + 1
        typing = t.of(k) == ":"
        while k < len(t.text):
            mark, before = t.text[k], t.of(k - 1)
            if mark == "{":
                if typing and before in (":", "|", "&", "=>", "<", ",", "("):
                    k = t.after(k)
                    continue
                return k
            if mark in (";", "}", ")", "]", "=") or (not typing and mark != ":") or (t.fresh[k] and before not in _TYPE_GOES_ON and mark not in ("|", "&")):
                return None
            k = t.after(k)
        return None

    def look(self, k: int, word: str, scope: str) -> None:
        if scope in ("class", "object"):
            before = self.t.of(k - 1)
            if self.typed and (before in ("{", "}", ";", ",") or (scope == "class" and self.t.fresh[k] and (before not in _GOES_ON or before == "void"))):
                self.method(k)
        if word == "function":
            self.function(k, scope)
        elif word == "class" and self.t.of(k - 1) not in (".", "?.") and self.t.of(k + 1) != ":":
            self.class_(k, scope)
        elif scope == "block" and word in ("const", "let", "var"):
            self.arrow(k)
        elif self.typed and word in ("interface", "type", "enum", "namespace", "module") and scope == "block" and self.t.is_name(k + 1):
            self.type_(k, word)

    def outset(self, k: int, scope: str) -> int | None:
        """Where the statement of a keyword at k begins, behind what exports it; None if it is an expression's."""
        first = k
        while self.t.of(first - 1) in ("export", "default", "declare", "abstract", "async"):
            first -= 1
        if scope != "block" or not self.begins(first):
            return None
        while self.t.of(first) in ("export", "default"):
            first += 1
        return first

    def function(self, k: int, scope: str) -> None:
        first, t = self.outset(k, scope), self.t
        name = k + 1 + (t.of(k + 1) == "*")
        opens = self.head_end(t.past_generics(name + t.is_name(name)))
        if opens is not None:
            last = self.body(opens, "block")
            if first is not None and t.is_name(name):
                self.put(name, "function", first + (t.of(first) == "declare"), last)
        elif first is not None and t.of(first) == "declare" and t.is_name(name) and self.typed:
            end = name
            while end < len(t.text) - 1 and t.text[end] != ";" and not t.fresh[end + 1]:
                end = t.after(end) if t.after(end) < len(t.text) else len(t.text) - 1
            self.put(name, "function", first, end, "stub")

    def class_(self, k: int, scope: str) -> None:
        t, first = self.t, self.outset(k, scope)
        at = k + 1
        while at < len(t.text) and t.text[at] not in ("{", ";", ")", "}"):
            at = t.past_generics(at) if t.text[at] == "<" else t.after(at)
        if t.of(at) == "{":
            last = self.body(at, "class")
            if first is not None and t.is_name(k + 1) and t.of(k + 1) not in ("extends", "implements"):
                self.put(k + 1, "class", first + (t.of(first) == "declare"), last)

    def method(self, k: int) -> None:
        t = self.t
        while t.of(k) == "@":
            k += 2
            while t.of(k) == ".":
                k += 2
            k = t.after(k) if t.of(k) == "(" else k
        name = k
        while t.of(name) in _MODIFIERS and t.of(name + 1) not in ("(", "<", "=", ":", ";", "?", "!", ",", "}"):
            name += 1
        name += t.of(name) == "*"
        if t.is_name(name):
            opens = self.head_end(t.past_generics(name + 1 + (t.of(name + 1) == "?")))
            if opens is not None:
                self.put(name, "function", k, self.body(opens, "block"))

    def arrow(self, k: int) -> None:
        t, at = self.t, k + 2
        first = self.outset(k, "block")
        if first is None or not t.is_name(k + 1):
            return
        if t.of(at) == ":":
            while at < len(t.text) and t.text[at] not in ("=", ";"):
                at = t.after(at)
        if t.of(at) != "=":
            return
        at += 1 + (t.of(at + 1) == "async")
        at = t.past_generics(at)
        at = t.after(at)
        if t.of(at) == ":":
            while at < len(t.text) and t.text[at] not in ("=>", ";"):
                at = t.after(at)
        if t.of(at) != "=>":
            return
        if t.of(at + 1) == "{":
            self.put(k + 1, "function", first, self.body(at + 1, "block"))
        else:  # an expression takes its line
            last = at
            while last + 1 < len(t.text) and not t.fresh[last + 1]:
                last += 1
            self.put(k + 1, "function", first, last)

    def type_(self, k: int, word: str) -> None:
        t, first = self.t, self.outset(k, "block")
        at = t.past_generics(k + 2)
        if first is None:
            return
        if word == "type":
            if t.of(at) != "=":
                return
            while at < len(t.text) - 1 and t.of(at) != ";" and not (t.fresh[at + 1] and t.of(at) not in _GOES_ON and t.of(at + 1) not in ("|", "&", "?", ":")):
                at = t.after(at) - (at in t.close)
                if t.of(at + 1) == "":
                    break
                at += 1
            self.put(k + 1, "interface", first, at)
            return
        while at < len(t.text) and t.text[at] not in ("{", ";"):
            at = t.past_generics(at) if t.text[at] == "<" else t.after(at)
        if t.of(at) == "{":
            last = self.body(at, "block" if word in ("namespace", "module") else "type")
            if word == "interface":
                self.put(k + 1, "interface", first, last)


class TypedScript(Script):
    typed = True


class Java(Scan):
    family, outermost = "java", "file"

    def brace(self, k: int, scope: str) -> str:
        t = self.t
        if t.of(k - 1) == ")":  # new Name<...>(...) { is a class
            at = t.opened.get(k - 1, 0) - 1
            while at >= 0 and (t.is_name(at) or t.text[at] in (".", "<", ">", ",", "?")):
                if t.text[at] == "new":
                    return "class"
                at -= 1
        return "class" if scope == "constants" and not self.constants_ended(k) else "block"

    def look(self, k: int, word: str, scope: str) -> None:
        t = self.t
        if scope in ("file", "class", "constants", "block") and word in ("class", "enum", "interface", "record") and t.is_name(k + 1) and t.of(k - 1) != ".":
            at = k + 2
            while at < len(t.text) and t.text[at] not in ("{", ";", "=", ")"):
                at = t.past_generics(at) if t.text[at] == "<" else t.after(at)
            if t.of(at) == "{":
                last = self.body(at, "constants" if word == "enum" else "class")
                first = k
                while t.of(first - 1) in ("public", "private", "protected", "abstract", "final", "static", "sealed", "strictfp"):
                    first -= 1
                self.put(k + 1, "interface" if word == "interface" else "class", first - (t.of(k - 1) == "@"), last)
        elif scope in ("class", "constants") and t.of(k - 1) in ("{", "}", ";") and (scope == "class" or self.constants_ended(k)):
            self.method(k)

    def constants_ended(self, k: int) -> bool:
        """Whether an enumeration's constants end before k."""
        at = k - 1
        while at >= 0 and self.t.text[at] != "{":
            if self.t.text[at] == ";":
                return True
            at = self.t.opened.get(at, at) - 1
        return False

    def method(self, first: int) -> None:
        t, at, types = self.t, first, 0
        while at < len(t.text):
            mark = t.text[at]
            if mark == "@" and t.of(at + 1) != "interface":
                at += 2
                while t.of(at) == ".":
                    at += 2
                at = t.after(at) if t.of(at) == "(" else at
            elif mark == "<":
                at = t.past_generics(at)
            elif mark == "(":
                break
            elif t.is_name(at) and mark not in ("class", "enum", "interface", "record"):
                types += mark not in ("public", "private", "protected", "static", "final", "abstract", "synchronized", "native", "default", "strictfp")
                at += 1
            elif mark in ("[", ".", "&", "?"):
                at = t.after(at)
            else:
                return
        name = at - 1
        if types < 2 or not t.is_name(name) or at not in t.close:  # a type and a name
            return
        at = t.close[at] + 1
        while at < len(t.text) and t.text[at] not in ("{", ";", "}"):
            at = t.after(at)
        if t.of(at) in ("{", ";"):
            self.put(name, "function", first, self.body(at, "block") if t.text[at] == "{" else at)


#: Words that stand before a bracket and are no function's name, fixed values.
_C_WORDS = {"if", "for", "while", "switch", "return", "sizeof", "catch", "defined", "alignas", "decltype", "__attribute__", "__declspec", "noexcept", "throw", "static_assert"}


class C(Scan):
    family, outermost, plus = "c", "file", False

    def brace(self, k: int, scope: str) -> str:
        return "file" if self.t.of(k - 1) == '""' and self.t.of(k - 2) == "extern" else "block"

    def look(self, k: int, word: str, scope: str) -> None:
        t = self.t
        if word in ("struct", "class") and t.is_name(k + 1) and (word == "struct" or (self.plus and t.of(k - 1) not in ("enum", "<", ","))):
            at = k + 2
            if self.plus:
                while at < len(t.text) and (t.is_name(at) or t.text[at] in (":", "::", ",", "<")):
                    at = t.past_generics(at) if t.text[at] == "<" else at + 1
            if t.of(at) == "{":
                self.put(k + 1, word, k, self.body(at, "members"))
        elif self.plus and word == "namespace":
            at = k + 1
            while t.is_name(at) or t.of(at) == "::":
                at += 1
            if t.of(at) == "{":
                last = self.body(at, "file")
                if at > k + 1:
                    self.put(k + 1, "module", k, last)
        if scope == "file" and t.of(k - 1) in ("", "{", "}", ";"):
            self.function(k)

    def function(self, first: int) -> None:
        t, at = self.t, first
        if t.of(at) == "template":
            at = first = t.past_generics(at + 1)
        while at < len(t.text):
            mark = t.text[at]
            if mark in (";", "{", "}", "=", "typedef", "using", "namespace") or (mark == '""' and t.of(at + 1) == "{"):
                return
            if mark == "(" and at in t.close:
                name = at - 1
                if t.is_name(name) and t.of(name) not in _C_WORDS and name > first and t.of(name - 1) not in ("::", "~", ".", "operator"):
                    break
                if name == first:  # a macro's call before the declaration
                    first = t.close[at] + 1
            at = t.past_generics(at) if mark == "<" else t.after(at)
        else:
            return
        at = t.close[at] + 1
        while at < len(t.text) and (t.is_name(at) or t.text[at] in ("(", "->", "*", "&", "&&", "::", "<", "[")):
            at = t.past_generics(at) if t.text[at] == "<" else t.after(at)
        if t.of(at) == "{":
            self.put(name, "function", first, self.body(at, "block"))
        elif t.of(at) in (";", ","):
            while at < len(t.text) - 1 and t.text[at] != ";":
                at = min(t.after(at), len(t.text) - 1)
            self.put(name, "function", first, at, "stub")


class Cpp(C):
    plus = True


#: Languages that are read by scopes.
SCANS = {"javascript": Script, "typescript": TypedScript, "java": Java, "c": C, "cpp": Cpp}


def declarations(content: str, language: str) -> list[tuple[str, str, str, int, int]]:
    """(name, kind, role, start, end) in characters of a file's declarations, at any depth."""
    return SCANS[language](content).declarations()


def wrong_brackets(content: str, language: str) -> int:
    return Tokens(content, SCANS[language].family).wrong

