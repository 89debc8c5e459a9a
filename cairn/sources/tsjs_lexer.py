"""Tokens of TypeScript and JavaScript: a pushdown automaton.

Its stack holds what is open: brackets, templates, expressions inside templates, JSX tags and
JSX children. Whether a slash divides or begins a regular expression follows from the token
before it. In files that may hold JSX, a `<` where an expression begins opens an element; if that
leads nowhere (a type parameter list), the automaton goes back and takes it as a sign.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

# Words after which an expression begins, and words whose parentheses a statement follows.
BEFORE_EXPRESSION = frozenset("return typeof case do else in instanceof new void delete throw yield await of extends default".split())
BEFORE_STATEMENT = frozenset("if while for with".split())

_BLANK = re.compile(r"(?:[\s\ufeff]+|//[^\n\r\u2028\u2029]*|/\*.*?\*/)+", re.S)
_ESCAPE = r"\\u(?:[0-9a-fA-F]{4}|\{[0-9a-fA-F]+\})"
_NAME = re.compile(rf"#?(?:[^\W\d]|[$_]|{_ESCAPE})(?:[\w$\u200c\u200d]|{_ESCAPE})*")
_NUMBER = re.compile(r"0[xXoObB][\w]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?")
_STRING = re.compile(r"\"(?:\\(?:\r\n|.)|[^\"\\\n\r])*\"|'(?:\\(?:\r\n|.)|[^'\\\n\r])*'", re.S)
_REGEX = re.compile(r"/(?![*/])(?:\\[^\n\r]|\[(?:\\[^\n\r]|[^\]\\\n\r])*\]|[^/\\\[\n\r])+/[\w$]*")
_SIGN = re.compile(r"=>|\.\.\.|\?\.(?!\d)|\+\+|--|&&=?|\|\|=?|\?\?=?|[^\s\w]")
_CHUNK = re.compile(r"(?:\\.|\$(?!\{)|[^\\`$])*", re.S)
_TAG = re.compile(r"[^\W\d][\w$.:-]*|>")
_ATTRIBUTE = re.compile(r"[\w$:.-]+|=|\"[^\"]*\"|'[^']*'")
_CLOSING = re.compile(r"</\s*([\w$.:-]*)\s*>")
_TEXT = re.compile(r"[^<>{}]*")
_GENERIC = re.compile(r"<\s*(?:const\s+)?[^\W\d][\w$]*\s*(?:,|extends\b(?!\s*[=/>]))")
_TYPES = re.compile(r"<[^<>(){}]*(?:<[^<>(){}]*>[^<>(){}]*)*>")
_CLOSES = {")": "(", "]": "[", "}": "{"}


class Malformed(ValueError):
    """Text whose literals or brackets do not end."""


@dataclass
class Tokens:
    """kind, text and place of every token; match has the closing token's number for every opening one.

    Kinds: name, number, string, regex, sign, open and close. Templates and JSX elements open with
    "`" and "<>"; what is inside of them, but for the expressions, is no token.
    """

    kinds: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    begins: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    match: dict[int, int] = field(default_factory=dict)

    def add(self, kind: str, text: str, begin: int, end: int) -> None:
        self.kinds.append(kind)
        self.texts.append(text)
        self.begins.append(begin)
        self.ends.append(end)

    def cut(self, n: int) -> None:
        """Forget all tokens from number n on."""
        for part in (self.kinds, self.texts, self.begins, self.ends):
            del part[n:]
        self.match = {a: b for a, b in self.match.items() if b < n}

    def __len__(self) -> int:
        return len(self.kinds)


@dataclass
class _Open:
    """What is open: its sign, the number of its token, and whether what ends there ends an expression; for elements, where to go back to."""

    sign: str
    token: int
    value: bool = True
    begin: int = 0
    name: str = ""


def tokens_of(text: str, jsx: bool, typed: bool = True) -> Tokens:
    """The tokens of a source text; jsx where elements are allowed, typed where type parameters are. Malformed if something open does not end."""
    return _Automaton(text, jsx, typed).run()


class _Automaton:
    def __init__(self, text: str, jsx: bool, typed: bool):
        self.text, self.jsx, self.typed = text, jsx, typed
        self.out, self.stack, self.at = Tokens(), [], 0
        self.value = False  # whether the last token ends an expression, so that a slash divides
        self.signs = set()  # places where `<` is no element

    def run(self) -> Tokens:
        if self.text.startswith("#!"):
            self.at = self.text.find("\n") if "\n" in self.text else len(self.text)
        while True:
            try:
                while self.at < len(self.text):
                    top = self.stack[-1].sign if self.stack else ""
                    {"`": self._template, "<": self._tag, ">": self._children}.get(top, self._code)()
                if self.stack:
                    raise Malformed(f"'{self.text[self.stack[-1].begin]}' is not closed")
                return self.out
            except Malformed:
                # the innermost open element may be none
                k = next((k for k in range(len(self.stack) - 1, -1, -1) if self.stack[k].sign in "<>"), None)
                if k is None:
                    raise
                frame = self.stack[k]
                self.signs.add(frame.begin)
                self.out.cut(frame.token)
                del self.stack[k:]
                self.at, self.value = frame.begin, False

    def _line(self) -> int:
        return self.text.count("\n", 0, self.at) + 1

    def _push(self, sign: str, shown: str, value: bool = True, name: str = "", width: int = 1) -> None:
        self.stack.append(_Open(sign, len(self.out), value, self.at, name))
        self.out.add("open", shown, self.at, self.at + width)
        self.at += width
        self.value = False

    def _pop(self, shown: str, end: int) -> None:
        frame = self.stack.pop()
        self.out.match[frame.token] = len(self.out)
        self.out.add("close", shown, self.at, end)
        self.at, self.value = end, frame.value

    def _code(self) -> None:
        text, at, out = self.text, self.at, self.out
        if m := _BLANK.match(text, at):
            self.at = m.end()
            return
        c = text[at]
        if m := _NAME.match(text, at):
            name = m[0]
            after_dot = len(out) and out.texts[-1] in (".", "?.") and out.kinds[-1] == "sign"
            out.add("name", name, at, m.end())
            self.at, self.value = m.end(), after_dot or name not in BEFORE_EXPRESSION
        elif c.isdigit() or (c == "." and text[at + 1 : at + 2].isdigit()):
            self._literal("number", _NUMBER, at)
        elif c in "\"'":
            self._literal("string", _STRING, at)
        elif c == "`":
            self._push("`", "`")
        elif c in "([":
            before = out.texts[-1] if len(out) and out.kinds[-1] == "name" else ""
            member = len(out) > 1 and out.texts[-2] in (".", "?.")
            self._push(c, c, not (c == "(" and before in BEFORE_STATEMENT and not member))
        elif c == "{":
            self._push("{", "{", self._is_object())
        elif c in ")]}":
            if not self.stack or self.stack[-1].sign != _CLOSES[c]:
                raise Malformed(f"line {self._line()}: unexpected '{c}'")
            self._pop(c, at + 1)
        elif c == "/" and not self.value:
            self._literal("regex", _REGEX, at)
        elif c == "<" and self.jsx and not self.value and not (self.typed and _GENERIC.match(text, at)) and self._element():
            return
        else:
            m = _SIGN.match(text, at)
            out.add("sign", m[0], at, m.end())
            self.at = m.end()
            # x++ / 2 divides, while after ++ before a name nothing does
            self.value = self.value if m[0] in ("++", "--") else m[0] == "!" and self.value

    def _literal(self, kind: str, form: re.Pattern, at: int) -> None:
        m = form.match(self.text, at)
        if not m:
            raise Malformed(f"line {self._line()}: unterminated {kind}")
        self.out.add(kind, m[0], at, m.end())
        self.at, self.value = m.end(), True

    def _is_object(self) -> bool:
        """Whether a brace that opens here is an object's, whose end ends an expression; else a block's."""
        out = self.out
        if not len(out):
            return False
        kind, last = out.kinds[-1], out.texts[-1]
        if kind == "sign":
            return last not in (";", "=>") and not (last == ":" and self._is_label())
        if kind == "open":
            return last in ("(", "[")
        return kind == "name" and last in BEFORE_EXPRESSION and last not in ("do", "else", "extends")

    def _is_label(self) -> bool:
        out = self.out
        if len(out) < 2 or out.kinds[-2] != "name":
            return len(out) > 1 and out.texts[-2] == "default"
        before = out.texts[-3] if len(out) > 2 else ";"
        inside = self.stack[-1] if self.stack else None
        return before in (";", "}", "case") or (before == "{" and not (inside and inside.value))

    def _template(self) -> None:
        self.at = _CHUNK.match(self.text, self.at).end()
        if self.at >= len(self.text):
            raise Malformed("unterminated template")
        if self.text[self.at] == "`":
            self._pop("`", self.at + 1)
        elif self.text.startswith("${", self.at):
            self.at += 1
            self._push("{", "{")
        else:
            raise Malformed("unterminated template")  # a backslash at the end

    def _tag(self) -> None:
        """Inside an opening tag, behind its name."""
        text = self.text
        if m := _BLANK.match(text, self.at):
            self.at = m.end()
        elif text.startswith("/>", self.at):
            self._pop("<>", self.at + 2)
        elif text[self.at] == ">":
            self.stack[-1].sign = ">"
            self.at += 1
        elif m := _ATTRIBUTE.match(text, self.at):
            self.at = m.end()
        elif text[self.at] == "{":
            self._push("{", "{")
        elif text[self.at] == "<" and self.at == self.stack[-1].begin + 1 + len(self.stack[-1].name) and (m := _TYPES.match(text, self.at)):
            self.at = m.end()
        elif not self._element():
            raise Malformed(f"line {self._line()}: unexpected '{text[self.at]}' in a tag")

    def _children(self) -> None:
        text = self.text
        self.at = _TEXT.match(text, self.at).end()
        if self.at >= len(text):
            raise Malformed("an element is not closed")
        if text[self.at] == "{":
            self._push("{", "{")
        elif m := _CLOSING.match(text, self.at):
            if m[1] != self.stack[-1].name:
                raise Malformed(f"line {self._line()}: '{m[0]}' closes '<{self.stack[-1].name}>'")
            self._pop("<>", m.end())
        elif not self._element():
            raise Malformed(f"line {self._line()}: unexpected '{text[self.at]}' in an element")

    def _element(self) -> bool:
        """Open the element that begins here; no place is tried again that has led nowhere."""
        m = _TAG.match(self.text, self.at + 1) if self.text[self.at] == "<" and self.at not in self.signs else None
        if not m:
            return False
        name = m[0] if m[0] != ">" else ""
        self._push("<", "<>", True, name, 1 + len(name))
        return True
