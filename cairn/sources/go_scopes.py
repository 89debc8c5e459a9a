"""Where the local names of a Go file hold: one interval of places for each binding.

Scopes follow the language's rules: parameters, results and receivers hold in the function's
body, type parameters from their list to the end of the declaration, variables and constants
from behind their declaration, types from their name. What the header of an if, for, switch or
select binds holds to the end of the whole statement (else branches included); what a clause
binds, to the end of the clause; a range's variables only in the body.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

_TOKEN = re.compile(r"(?P<skip>[ \t\r]+|//[^\n]*)|(?P<long>/\*.*?\*/)|(?P<nl>\n)|(?P<name>[^\W\d]\w*)|(?P<lit>\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\.|[^'\\\n])+'|\.?\d[\w.]*(?:(?<=[eEpP])[+-]\w+)?)|(?P<op>:=|\+\+|--|\.\.\.|<-|[^\s\w])", re.S)
_ENDS = frozenset("break continue fallthrough return ++ -- ) ] }".split())
#: Words behind which a name or bracket does not end a line's statement.
_WORDS = frozenset("case chan const default defer else for func go goto if import interface map package range select struct switch type var".split())
_PAIRS = {"(": ")", "[": "]", "{": "}"}


class Scopes:
    """Tokens of a text with the semicolons that line ends stand for, and the bindings found in it."""

    def __init__(self, text: str):
        self.texts, self.begins, self.kinds = [], [], []
        self.match: dict[int, int] = {}
        self.found: list[tuple[str, str, int, int]] = []
        opened = []
        for m in _TOKEN.finditer(text):
            kind = m.lastgroup
            if kind == "nl" or (kind == "long" and "\n" in m[0]):
                if self.texts and (self.kinds[-1] == "lit" or (self.kinds[-1] == "name" and self.texts[-1] not in _WORDS) or self.texts[-1] in _ENDS):
                    self._add(";", "op", m.start())
            elif kind in ("name", "lit", "op"):
                if m[0] in _PAIRS:
                    opened.append(len(self.texts))
                elif m[0] in (")", "]", "}") and opened:
                    self.match[opened.pop()] = len(self.texts)
                self._add(m[0], kind, m.start())
        self._add(";", "op", len(text))

    def _add(self, text: str, kind: str, begin: int) -> None:
        self.texts.append(text)
        self.kinds.append(kind)
        self.begins.append(begin)

    def bindings(self, begin: int, end: int) -> list[tuple[str, str, int, int]]:
        """(name, kind, from, to) of the local bindings of the top-level declaration between two places."""
        self.found = []
        i, stop = bisect_left(self.begins, begin), bisect_left(self.begins, end)
        word = self.texts[i]
        if word == "func":
            self._function(i, stop, True)
        elif word == "type":
            for a, b in self._specs(i + 1, stop):
                self._type_parameters(a + 1, b)
                self._expressions(a + 1, b)
        else:
            self._expressions(i + 1, stop)
        return self.found

    def _bind(self, name: int, kind: str, begin: int, end: int) -> None:
        """Token `name` is bound from token begin to token end."""
        if self.texts[name] != "_":
            self.found.append((self.texts[name], kind, self.begins[begin], self.begins[min(end, len(self.begins) - 1)]))

    def _next(self, i: int) -> int:
        return self.match.get(i, i) + 1

    def _statement_end(self, i: int, stop: int) -> int:
        while i < stop and self.texts[i] != ";":
            i = self._next(i)
        return min(i, stop)

    def _specs(self, i: int, stop: int) -> Iterator[tuple[int, int]]:
        """Token ranges of the specs of a declaration, behind its word."""
        if i < stop and self.texts[i] == "(":
            stop, i = self.match.get(i, stop), i + 1
            while i < stop:
                end = self._statement_end(i, stop)
                if end > i:
                    yield i, end
                i = end + 1
        else:
            yield i, self._statement_end(i, stop)

    def _groups(self, i: int) -> Iterator[tuple[int, int]]:
        """Token ranges between the commas of the list that opens at token i."""
        stop = self.match.get(i, i)
        i += 1
        while i < stop:
            at = i
            while at < stop and self.texts[at] != ",":
                at = self._next(at)
            yield i, at
            i = at + 1

    def _is_named(self, a: int, b: int) -> bool:
        """Whether a group of a parameter list is a name with a type."""
        if b - a < 2 or self.kinds[a] != "name" or self.texts[a] in _WORDS or self.texts[a + 1] == ".":
            return False
        return self.texts[a + 1] != "[" or self._next(a + 1) < b  # List[int] is a type, list []int a name with one

    def _parameters(self, i: int, kind: str, begin: int, end: int) -> None:
        groups = [g for g in self._groups(i) if g[1] > g[0]]
        if any(self._is_named(a, b) for a, b in groups):
            for a, _ in groups:
                self._bind(a, kind, begin, end)

    def _type_parameters(self, i: int, end: int) -> None:
        """A list of type parameters at token i: names with constraints (an array's length is no list)."""
        if i < end and self.texts[i] == "[" and any(self._is_named(a, b) for a, b in self._groups(i)) and self._next(i) <= end:
            for a, _ in self._groups(i):
                self._bind(a, "type parameter", i, end)

    def _function(self, i: int, stop: int, declared: bool) -> int:
        """A function at its word; the token behind it."""
        i += 1
        lists = []
        if declared:
            if self.texts[i] == "(":  # a receiver
                lists.append((i, "receiver"))
                i = self._next(i)
            i += 1  # the name
        generic = i if i < stop and self.texts[i] == "[" else None
        i = self._next(i) if generic is not None else i
        if i >= stop or self.texts[i] != "(":
            return i
        lists.append((i, "parameter"))
        i = self._next(i)
        if i < stop and self.texts[i] == "(":
            lists.append((i, "result"))
            i = self._next(i)
        else:
            i = self._type(i, stop)
        if i < stop and self.texts[i] == "{" and i in self.match:
            end = self.match[i]
            for at, kind in lists:
                self._parameters(at, kind, i, end)
            if generic is not None:
                self._type_parameters(generic, end)
            self._block(i + 1, end)
            return end + 1
        return i

    def _type(self, i: int, stop: int) -> int:
        """The token behind the type at i; braces belong to it only behind struct and interface."""
        while i < stop:
            text = self.texts[i]
            if text in ("struct", "interface"):
                return self._next(i + 1)
            if text == "func":
                i = self._next(i + 1)
                if i < stop and self.texts[i] == "(":
                    return self._next(i)
                continue
            if text in ("*", "[", "<-", "chan", "map", "...", "("):
                named = text == "("
                i = self._next(i)
                if named:
                    return i
                continue
            if self.kinds[i] == "name":
                i += 1
                while i < stop and self.texts[i] in (".", "["):
                    i = i + 2 if self.texts[i] == "." else self._next(i)
            return i
        return i

    def _expressions(self, i: int, stop: int) -> None:
        """The function literals among the tokens."""
        while i < stop:
            i = self._function(i, stop, False) if self.texts[i] == "func" and self.kinds[i] == "name" else i + 1

    def _body(self, i: int, stop: int) -> int:
        """The brace that opens the body of the statement whose header begins at token i."""
        while i < stop and self.texts[i] != "{":
            if self.texts[i] == "func":
                j = self._signature(i, stop)
                i = self._next(j) if j < stop and self.texts[j] == "{" else j
            elif self.texts[i] in ("struct", "interface", "map") or (self.texts[i] == "[" and not self._is_operand(i - 1)):
                i = self._type(i, stop)  # of a literal, whose brace opens no body
                i = self._next(i) if i < stop and self.texts[i] == "{" else i
            else:
                i = self._next(i)
        return i

    def _is_operand(self, i: int) -> bool:
        return self.kinds[i] == "lit" or self.texts[i] in (")", "]", "}") or (self.kinds[i] == "name" and self.texts[i] not in _WORDS)

    def _signature(self, i: int, stop: int) -> int:
        """The token behind a literal's parameters and results."""
        i = self._next(i + 1)
        return self._next(i) if i < stop and self.texts[i] == "(" else self._type(i, stop)

    def _simple(self, i: int, stop: int, begin: int, end: int) -> None:
        """A simple statement: what `:=` binds holds from token begin to token end."""
        at, names = i, []
        while at < stop and self.texts[at] != ":=":
            if self.kinds[at] == "name" and (at == i or self.texts[at - 1] == ","):
                names.append(at)
            elif self.texts[at] != ",":
                break
            at += 1
        if at < stop and self.texts[at] == ":=":
            for name in names:
                self._bind(name, "variable", begin, end)
        self._expressions(i, stop)

    def _header(self, i: int, body: int, end: int) -> None:
        """The header of a statement that ends at token end: simple statements between semicolons."""
        while i < body:
            at = i
            while at < body and self.texts[at] != ";":
                at = self._next(at)
            ranged = any(t == "range" for t in self.texts[i:at])
            self._simple(i, at, body if ranged or at >= body else at, end)
            i = at + 1

    def _block(self, i: int, stop: int) -> None:
        """The statements between two tokens."""
        while i < stop:
            i = self._statement(i, stop, stop)

    def _clauses(self, i: int, stop: int) -> None:
        """The clauses of a switch or select: each is a block of its own."""
        while i < stop:
            colon = i
            while colon < stop and self.texts[colon] != ":":
                if self.texts[colon] == "func":
                    j = self._signature(colon, stop)
                    colon = self._next(j) if j < stop and self.texts[j] == "{" else j
                else:
                    colon = self._next(colon)
            end = colon + 1
            while end < stop and self.texts[end] not in ("case", "default"):
                end = self._next(end)
            self._simple(i + 1, colon, colon, end)
            at = colon + 1
            while at < end:
                at = self._statement(at, end, end)
            i = end

    def _statement(self, i: int, stop: int, end: int) -> int:
        """One statement of a block that ends at token end; the token behind it."""
        text = self.texts[i]
        if text == ";":
            return i + 1
        if text == "{":
            self._block(i + 1, self.match.get(i, stop))
            return self._next(i)
        if text == "if":
            return self._if(i, stop)
        if text in ("for", "switch", "select"):
            body = self._body(i + 1, stop)
            close = self.match.get(body, stop)
            self._header(i + 1, body, close)
            (self._block if text == "for" else self._clauses)(body + 1, close)
            return close + 1
        if text in ("var", "const", "type"):
            close = self._statement_end(i, stop)
            for a, b in self._specs(i + 1, close):
                if text == "type":
                    self._bind(a, "type", a, end)
                    self._type_parameters(a + 1, b)
                else:
                    at = a
                    while at < b and self.kinds[at] == "name":
                        self._bind(at, "variable" if text == "var" else "constant", b, end)
                        if self.texts[at + 1] != ",":
                            break
                        at += 2
                self._expressions(a, b)
            return close + 1
        if self.kinds[i] == "name" and i + 1 < stop and self.texts[i + 1] == ":":  # a label
            return i + 2
        close = self._statement_end(i, stop)
        self._simple(i, close, close, end)
        return close + 1

    def _if(self, i: int, stop: int) -> int:
        parts, at = [], i  # (header, body) of each branch; an else's header is empty
        while True:
            body = self._body(at + 1, stop)
            close = self.match.get(body, stop)
            parts.append((at + 1, body, close))
            if close + 1 < stop and self.texts[close + 1] == "else":
                at = close + 1 + (self.texts[close + 2] == "if")
                continue
            break
        for header, body, close in parts:
            self._header(header, body, parts[-1][2])
            self._block(body + 1, close)
        return parts[-1][2] + 1
