"""What one Go file declares, imports and refers to, by a small scanner of its tokens.

The scanner knows comments, literals, brackets and automatic semicolons. It reads declarations
at the top level, references `name.Exported`, and where local names hold (go_scopes); which
references a local name takes is decided by a join.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from cairn.sources.go_scopes import Scopes

FACTS = "path string, fact string, name string, detail string, line int, column int, end_line int, end_column int, snippet string, truncated boolean"
SNIPPET = 8192

_QUIET = re.compile(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|`[^`]*`|\'(?:\\.|[^\'\\\n])+\'', re.S)
_PACKAGE = re.compile(r"\s*package\s+([^\W\d]\w*)\s*(?:[;\n]|\Z)")
_SPEC = re.compile(r'(?:([^\W\d]\w*|\.)\s*)?("(?:\\.|[^"\\\n])*"|`[^`]*`)')
_REFERENCE = re.compile(r"(?<!\w)([^\W\d]\w*)\s*\.\s*([^\W\d]\w*)")
_CLOSES = {")": "(", "]": "[", "}": "{"}
#: Characters after which a new line does not end a statement.
_GOES_ON = set(",+-*/%&|^<>=!(:.{[")


class Broken(ValueError):
    """A file that is no Go source."""


def _blank(text: str, literals: bool) -> str:
    """The text of the same length with comments, and literals where asked, as spaces; lines stay."""
    keep = lambda m: m[0] if not literals and m[0][0] in "\"`'" else re.sub(r"[^\n]", " ", m[0])
    return _QUIET.sub(keep, text)


class _File:
    def __init__(self, path: str, content: bytes):
        self.path, self.content = path, content
        try:
            self.text = content.decode().removeprefix("﻿")
        except UnicodeDecodeError as e:
            raise Broken("illegal UTF-8 encoding") from e
        self.code, self.bare = _blank(self.text, False), _blank(self.text, True)
        self.lines = [0, *(m.end() for m in re.finditer("\n", self.text))]
        self.pairs = self._brackets()

    def _brackets(self) -> dict[int, int]:
        """The closing place of every opening bracket."""
        opened, pairs = [], {}
        for m in re.finditer(r"[(){}\[\]]", self.bare):
            if m[0] in "([{":
                opened.append(m.start())
            elif not opened or self.bare[opened[-1]] != _CLOSES[m[0]]:
                raise Broken(f"{self.path}:{self.where(m.start())[0]}: unexpected {m[0]}")
            else:
                pairs[opened.pop()] = m.start()
        if opened:
            raise Broken(f"{self.path}:{self.where(opened[-1])[0]}: {self.bare[opened[-1]]} is not closed")
        return pairs

    def where(self, at: int) -> tuple[int, int]:
        """Line and UTF-16 column, from 1."""
        line = bisect_right(self.lines, at)
        return line, len(self.text[self.lines[line - 1] : at].encode("utf-16-le")) // 2 + 1

    def row(self, fact, name=None, detail=None, begin=None, end=None) -> tuple:
        if begin is None:
            return (self.path, fact, name, detail, None, None, None, None, None, None)
        raw = self.text[begin:end].encode()
        return (self.path, fact, name, detail, *self.where(begin), *self.where(end), raw[:SNIPPET].decode(errors="ignore"), len(raw) > SNIPPET)

    def selected(self, at: int) -> bool:
        """Whether the name at a place is selected from something before it; three dots select nothing."""
        before = self.bare[max(0, at - 256) : at].rstrip()
        return before.endswith(".") and not before.endswith("...")

    def interval(self, name, kind, begin, end) -> tuple:
        """A row without a snippet: where a local name holds."""
        return (self.path, "binding", name, kind, *self.where(begin), *self.where(end), None, None)

    def statements(self, begin: int, end: int):
        """(begin, end) of the statements between two places, by semicolons and by lines that do not go on."""
        at, start = begin, None
        while at < end:
            c = self.bare[at]
            if c in self._opening and at in self.pairs:
                start = at if start is None else start
                at = self.pairs[at] + 1
                continue
            if c == ";" or (c == "\n" and start is not None and self.bare[start:at].rstrip()[-1:] not in _GOES_ON):
                if start is not None:
                    yield start, at
                start = None
            elif not c.isspace() and start is None:
                start = at
            at += 1
        if start is not None:
            yield start, end

    _opening = set("([{")


def _group(f: _File, begin: int, end: int, word: str):
    """The specs of a declaration: of its parentheses, or the one behind its word."""
    rest = begin + len(word)
    inside = re.compile(r"\s*\(").match(f.bare, rest, end)
    if inside and inside.end() - 1 in f.pairs:
        yield from f.statements(inside.end(), f.pairs[inside.end() - 1])
    else:
        rest += len(f.bare[rest:end]) - len(f.bare[rest:end].lstrip())
        yield rest, end


def _names(text: str) -> list[str]:
    found = re.match(r"[^\W\d]\w*(?:\s*,\s*[^\W\d]\w*)*", text)
    return [n.strip() for n in found[0].split(",")] if found else []


def _declaration(f: _File, begin: int, end: int):
    """Rows (kind, name, detail) of one top-level declaration."""
    text = f.bare[begin:end]
    word = re.match(r"\w*", text)[0]
    if word == "func":
        receiver = re.match(r"func\s*\(([^()]*(?:\([^()]*\)[^()]*)*)\)\s*([^\W\d]\w*)", text)
        if receiver:
            owner = re.search(r"([^\W\d]\w*)\s*(?:\[[^\]]*\])?[\s)]*$", receiver[1])
            if owner:
                yield "METHOD", f"{owner[1]}.{receiver[2]}", None
        elif name := re.match(r"func\s+([^\W\d]\w*)", text):
            yield "FUNCTION", name[1], None
    elif word == "type":
        for a, b in _group(f, begin, end, word):
            spec = re.match(r"([^\W\d]\w*)\s*(\[[^\]]*[^\W\d][^\]]*\]\s*(?=\S))?(=?)\s*(struct|interface)?\b", f.bare[a:b])
            if spec:
                yield {"struct": "STRUCT", "interface": "INTERFACE"}.get(spec[4] if not spec[3] else None, "TYPE"), spec[1], None
    elif word in ("var", "const"):
        for a, b in _group(f, begin, end, word):
            for name in _names(f.bare[a:b]):
                yield "VARIABLE" if word == "var" else "CONSTANT", name, None


def facts_of(path: str, content: bytes) -> list[tuple]:
    """Rows of FACTS of one file: `parsed` with the package's name, declarations, imports, references, bindings of the names that references have; or one `failed` row."""
    try:
        f = _File(path, content)
        clause = _PACKAGE.match(f.bare)
        if not clause:
            raise Broken(f"{path}: expected package clause")
    except Broken as e:
        return [(path, "failed", None, str(e), None, None, None, None, None, None)]
    rows, starts, scopes = [f.row("parsed", clause[1])], 0, None
    for begin, end in f.statements(clause.end(), len(f.text)):
        word = re.match(r"\w*", f.bare[begin:end])[0]
        if f.code.startswith("import", begin) and word == "import":
            for a, b in _group_of_code(f, begin, end):
                if spec := _SPEC.match(f.code, a, b):
                    rows.append(f.row("import", spec[1], spec[2], spec.start(), spec.end()))
        elif word in ("func", "type", "var", "const"):
            for kind, name, detail in _declaration(f, begin, end):
                if name == "init" and kind == "FUNCTION":
                    starts += 1
                    detail = f"init@{starts}"
                if name.split(".")[-1] != "_":
                    rows.append(f.row(kind, name, detail))
            used = [m for m in _REFERENCE.finditer(f.bare, begin, end) if m[2][0].isupper() and not f.selected(m.start())]
            rows += [f.row("reference", m[1], m[2], m.start(), m.end()) for m in used]
            names = {m[1] for m in used}
            scopes = scopes or (Scopes(f.text) if names else None)
            rows += [f.interval(name, kind, a, b) for name, kind, a, b in (scopes.bindings(begin, end) if names else ()) if name in names]
        else:
            return [(path, "failed", None, f"{path}:{f.where(begin)[0]}: expected declaration", None, None, None, None, None, None)]
    return rows


def _group_of_code(f: _File, begin: int, end: int):
    """Import specs: literals are blank in the bare text, so they are found in the code."""
    inside = re.compile(r"import\s*\(").match(f.bare, begin, end)
    if inside and inside.end() - 1 in f.pairs:
        begin, end = inside.end(), f.pairs[inside.end() - 1]
    else:
        begin += len("import")
    for m in _SPEC.finditer(f.code, begin, end):
        yield m.start(), m.end()


_MODULE = re.compile(r"^\s*(module|require|replace|exclude|use)\b\s*(\([^)]*\)|[^\n]*)", re.M)


def module_of(content: bytes) -> dict:
    """path, requires, replaced and what by (targets), excluded and uses of a go.mod or go.work file."""
    text = re.sub(r"(^|\s)//[^\n]*", r"\1", content.decode(errors="replace"))
    out = {"path": None, "requires": [], "replaced": [], "targets": [], "excluded": [], "uses": []}
    for m in _MODULE.finditer(text):
        body = m[2][1:-1] if m[2].startswith("(") else m[2]
        for line in filter(None, (x.strip() for x in body.split("\n"))):
            first = line.split()[0].strip('"`')
            if m[1] == "module":
                out["path"] = first
            else:
                out[{"require": "requires", "replace": "replaced", "exclude": "excluded", "use": "uses"}[m[1]]].append(first)
                if m[1] == "replace":
                    out["targets"].append(line.partition("=>")[2].split()[0].strip('"`') if "=>" in line else "")
    return out
