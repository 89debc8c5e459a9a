"""What one TypeScript or JavaScript file declares and imports: a walk over its tokens.

Statements at the top level are read as far as their names go: declarations with their binding
patterns and class members, and module specifiers. Types and expressions are skipped by their
brackets. A file in which something open does not end is a failed one.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

from cairn.sources.tsjs_lexer import Malformed, Tokens, tokens_of

FACTS = "path string, fact string, name string, detail string, line int, column int, end_line int, end_column int, snippet string, truncated boolean"
SNIPPET = 4096
# What is reported of imports that are not followed, words that begin statements or stand before members, and suffixes.
IMPORT_EQUALS = "import-equals dependencies are unsupported"
DYNAMIC = "dynamic import/require call dependencies are unsupported; binding not verified"
STARTS = frozenset("export import function async class abstract interface type enum const let var declare".split())
MODIFIERS = frozenset("public private protected static async override abstract declare readonly accessor get set".split())
TYPED_ONLY = (".ts", ".mts", ".cts")
TYPED = (*TYPED_ONLY, ".tsx")
#: Words and signs with which an expression goes on in the next line.
_GOES_ON = frozenset("instanceof in as satisfies".split())
_ENDS_NOTHING = frozenset("typeof new void delete await in instanceof of extends as satisfies".split())


class _File:
    def __init__(self, path: str, content: bytes):
        self.path, self.text = path, content.decode().removeprefix("\ufeff")
        suffix = path[path.rfind(".") :]
        self.t: Tokens = tokens_of(self.text, suffix not in TYPED_ONLY, suffix in TYPED)
        self.lines = [0, *(m.end() for m in re.finditer("\r\n|[\n\r\u2028\u2029]", self.text))]

    def where(self, at: int) -> tuple[int, int]:
        line = bisect_right(self.lines, at)
        return line, len(self.text[self.lines[line - 1] : at].encode("utf-16-le")) // 2 + 1

    def row(self, fact, name=None, detail=None, begin=None, end=None) -> tuple:
        if begin is None:
            return (self.path, fact, name, detail, None, None, None, None, None, None)
        units = self.text[begin:end].encode("utf-16-le")
        return (self.path, fact, name, detail, *self.where(begin), *self.where(end), units[: 2 * SNIPPET].decode("utf-16-le", "ignore"), len(units) > 2 * SNIPPET)

    # ---- tokens

    def is_(self, i: int, *texts: str) -> bool:
        """Whether token i is one of these words or signs (a string's text is none)."""
        return 0 <= i < len(self.t) and self.t.texts[i] in texts and self.t.kinds[i] in ("name", "sign", "open", "close")

    def kind(self, i: int) -> str:
        return self.t.kinds[i] if 0 <= i < len(self.t) else ""

    def next(self, i: int) -> int:
        """The token behind i, or behind what it opens."""
        return self.t.match.get(i, i) + 1

    def breaks(self, i: int) -> bool:
        """Whether a line ends before token i."""
        return i >= len(self.t) or i == 0 or bisect_right(self.lines, self.t.ends[i - 1] - 1) < bisect_right(self.lines, self.t.begins[i])

    def ends(self, i: int, in_type: bool = False) -> bool:
        """Whether an expression, or a type, may end with token i."""
        kind, text = self.kind(i), self.t.texts[i]
        if kind == "sign":
            return text in ("++", "--", ">", "!", "*")
        return kind != "open" and not (kind == "name" and text in _ENDS_NOTHING and not (in_type and text == "void"))

    def stops(self, i: int, in_type: bool = False) -> bool:
        """Whether a statement that has begun ends before token i, with or without a semicolon."""
        if i >= len(self.t) or self.is_(i, ";") or self.kind(i) == "close":
            return True
        if not self.breaks(i) or not self.ends(i - 1, in_type):
            return False
        text = self.t.texts[i]
        if self.kind(i) == "sign":
            return text in ("@", "!", "++", "--", "~", "#")
        if self.kind(i) == "open":
            return text not in ("(", "[", "`")
        return not (self.kind(i) == "name" and text in _GOES_ON)

    def angles(self, i: int) -> int:
        """The token behind a balanced `<..>` list of types at token i; i where there is none."""
        j, depth = i, 0
        while j < len(self.t):
            if self.is_(j, "<"):
                depth += 1
            elif self.is_(j, ">"):
                depth -= 1
                if not depth:
                    return j + 1
            elif self.kind(j) == "close" or self.is_(j, ";", "&&", "||", "++", "--"):
                return i
            j = self.next(j)
        return i


def _value(literal: str) -> str:
    """What a string literal stands for."""
    plain = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": ""}

    def read(m):
        e = m[1]
        return chr(int(e[1:].strip("{}"), 16)) if e[0] in "ux" and len(e) > 1 else plain.get(e, e)

    return re.sub(r"\\(u\{[0-9a-fA-F]{1,6}\}|u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|\r\n|.)", read, literal[1:-1], flags=re.S)


def _bound(f: _File, i: int) -> Iterator[str]:
    """The names that the binding at token i binds."""
    if not f.is_(i, "{", "["):
        if f.kind(i) == "name":
            yield f.t.texts[i]
        return
    end, keyed, i = f.t.match[i], f.is_(i, "{"), i + 1
    while i < end:
        at = i + f.is_(i, "...")
        if keyed and f.is_(f.next(at), ":"):
            at = f.next(at) + 1
        yield from _bound(f, at)
        while i < end and not f.is_(i, ","):
            i = f.next(i)
        i += 1


def _skip_type(f: _File, i: int, *stops: str) -> int:
    """The token behind the type at i: one of the stops, or where the statement ends."""
    first = True
    while i < len(f.t) and not f.is_(i, *stops):
        if not first and f.stops(i, True):
            break
        i, first = (max(f.angles(i), f.next(i)) if f.is_(i, "<") else f.next(i)), False
    return i


def _skip_value(f: _File, i: int) -> int:
    """The token behind the expression at i: a comma, or where the statement ends."""
    first = True
    while i < len(f.t) and not f.is_(i, ",") and (first or not f.stops(i)):
        behind = f.angles(i) if f.is_(i, "<") and f.kind(i - 1) == "name" and f.path.endswith(TYPED) else i
        # behind a list of types no operand begins, but for a call's parentheses
        operand = f.kind(behind) in ("name", "number", "string", "regex", "open") or f.is_(behind, "+", "-", "!", "~", "++", "--", "<")
        types = behind > i and (f.is_(behind, "(", "`") or not operand or f.breaks(behind))
        i, first = (behind if types else f.next(i)), False
    return i


def _is_callable(f: _File, i: int, end: int) -> bool:
    """Whether the expression from token i to end is an arrow function or a function expression."""
    i += f.is_(i, "async") and not f.breaks(i + 1) and (f.is_(i + 1, "function", "(", "<") or f.kind(i + 1) == "name")
    if f.is_(i, "function"):
        while i < end and not f.is_(i, "("):
            i = f.angles(i) if f.is_(i, "<") and f.angles(i) > i else i + 1
        i = f.next(i)
        i = _skip_type(f, i + 1, "{") if f.is_(i, ":") and not f.is_(i + 1, "{") else f.next(i + 1) if f.is_(i, ":") else i
        return f.next(i) >= end
    if f.kind(i) == "name" and f.is_(i + 1, "=>"):
        return True
    i = f.angles(i) if f.is_(i, "<") else i
    if not f.is_(i, "("):
        return False
    i = f.next(i)
    return f.is_(_skip_type(f, i + 1, "=>", ",") if f.is_(i, ":") else i, "=>")


def _variables(f: _File, i: int) -> Iterator[tuple[str, str]]:
    """(kind, name) of the declarators from token i on."""
    while i < len(f.t):
        begin, at = i, f.next(i)
        at += f.is_(at, "!")
        if f.is_(at, ":"):
            at = _skip_type(f, at + 1, "=", ",")
        call = False
        if f.is_(at, "="):
            value = at + 1
            at = _skip_value(f, value)
            call = f.kind(begin) == "name" and _is_callable(f, value, at)
        for name in _bound(f, begin):
            yield ("FUNCTION" if call else "VARIABLE"), name
        if not f.is_(at, ","):
            return
        i = at + 1


def _member_name(f: _File, i: int) -> str | None:
    """The name at token i; a computed one only where it is a literal."""
    if f.is_(i, "["):
        return _member_name(f, i + 1) if f.t.match[i] == i + 2 and f.kind(i + 1) in ("string", "number") else None
    return _value(f.t.texts[i]) if f.kind(i) == "string" else f.t.texts[i] if f.kind(i) in ("name", "number") else None


def _members(f: _File, i: int, end: int) -> Iterator[str]:
    """Names of the constructors and methods between two tokens of a class body."""
    while i < end:
        if f.is_(i, ";"):
            i += 1
            continue
        while f.is_(i, "@"):  # a decorator: a name with calls and members, or parentheses
            i = f.next(i + 1)
            while f.is_(i, ".", "(") and i < end:
                i = f.next(i) if f.is_(i, "(") else i + 2
        words = set()
        while f.kind(i) == "name" and f.t.texts[i] in MODIFIERS and not f.is_(i + 1, "(", "=", ";", "?", "!", ":", "<", ",") and i + 1 < end:
            words.add(f.t.texts[i])
            i += 1
        if f.is_(i, "{"):  # a static block
            i = f.next(i)
            continue
        i += f.is_(i, "*")
        if i >= end:
            return
        name, i = _member_name(f, i), f.next(i)
        i += f.is_(i, "?", "!")
        i = f.angles(i) if f.is_(i, "<") else i
        if f.is_(i, "("):
            if name is not None and not words & {"get", "set"}:
                yield name
            i = f.next(i)
            if f.is_(i, ":"):
                i += 1
                # a brace is a type's where a type must begin, else the body's
                while i < end and not f.is_(i, ";"):
                    if f.is_(i, "{") and f.ends(i - 1) and not f.is_(i - 1, ":"):
                        break
                    if not f.is_(i - 1, ":") and f.stops(i, True) and not f.is_(i, "{"):
                        break
                    i = max(f.angles(i), f.next(i)) if f.is_(i, "<") else f.next(i)
            if f.is_(i, "{"):
                i = f.next(i)
        else:
            while i < end and not f.stops(i):
                i = f.next(i)


def _specifier(f: _File, i: int) -> int | None:
    """The token of the module specifier of the import or export whose words begin at i."""
    if f.kind(i) == "string":
        return i
    while i < len(f.t):
        if f.is_(i, "from") and f.kind(i + 1) == "string":
            return i + 1
        if not (f.kind(i) in ("name", "string") or f.is_(i, ",", "*", "{")):
            return None
        i = f.next(i)
    return None


def _declared(f: _File, i: int) -> list[tuple[str, str]]:
    """(kind, name) of what the statement at token i declares, behind its modifiers."""
    while f.is_(i, "export", "default", "declare", "abstract") or (f.is_(i, "async") and f.is_(i + 1, "function")):
        i += 1
    name = i + 1
    if f.is_(i, "function"):
        name += f.is_(name, "*")
        return [("FUNCTION", f.t.texts[name])] if f.kind(name) == "name" else []
    if f.is_(i, "const") and f.is_(i + 1, "enum"):
        i, name = i + 1, name + 1
    if f.is_(i, "const", "let", "var"):
        return list(_variables(f, i + 1)) if f.kind(name) == "name" or f.is_(name, "{", "[") else []
    if f.kind(name) != "name" or (f.breaks(name) and not f.is_(i, "class", "enum", "interface")):
        return []
    if f.is_(i, "class") and not f.is_(name, "extends", "implements"):
        out, body = [("CLASS", f.t.texts[name])], name + 1
        while body < len(f.t) and not f.is_(body, "{"):
            body = max(f.angles(body), f.next(body)) if f.is_(body, "<") else f.next(body)
        if body in f.t.match:
            out += [("METHOD", f"{f.t.texts[name]}.{m}") for m in _members(f, body + 1, f.t.match[body])]
        return out
    if f.is_(i, "type") and not f.is_(name + 1, "=", "<"):
        return []
    kinds = {"interface": "INTERFACE", "enum": "ENUM", "type": "TYPE"}
    return [(kinds[f.t.texts[i]], f.t.texts[name])] if f.is_(i, *kinds) else []


def _calls_module(f: _File, i: int) -> bool:
    """Whether token i is the import or require of a call; `import("x").Name` in a type is none."""
    call = i + 1 + f.is_(i + 1, "?.")
    if not f.is_(i, "import", "require") or not f.is_(call, "(") or f.is_(i - 1, ".", "?.", "function"):
        return False
    behind = f.next(call)
    if f.is_(i, "require"):
        return not f.is_(behind, "{")  # a method of that name
    in_type = f.is_(i - 1, "typeof", "<", "|", "&") or (f.is_(i - 1, ":", "=") and f.is_(behind, ".") and f.t.texts[behind + 1][:1].isupper())
    return not (in_type and f.path.endswith(TYPED))


def facts_of(path: str, content: bytes) -> list[tuple]:
    """Rows of FACTS of one file: `parsed`, declarations in order, imports and limitations; or one `failed` row."""
    try:
        f = _File(path, content)
    except (Malformed, UnicodeDecodeError) as e:
        return [(path, "failed", None, str(e), None, None, None, None, None, None)]
    rows, limits, i = [f.row("parsed")], [], 0
    begun = True  # whether a statement may begin at token i
    while i < len(f.t):
        if f.kind(i) == "name" and f.t.texts[i] in STARTS and begun:
            words = i + 1 if f.is_(i, "export", "import") else i
            words += f.is_(i, "export") and f.is_(words, "import")
            equals = words + (f.is_(words, "type") and f.kind(words + 1) == "name")
            if f.is_(words - 1, "import") and f.kind(equals) == "name" and f.is_(equals + 1, "="):
                limits.append(IMPORT_EQUALS)
            elif f.is_(i, "import", "export") and not f.is_(words, "(", ".") and (spec := _specifier(f, words)) is not None:
                end = spec + 1
                if f.is_(end, "with", "assert") and f.is_(end + 1, "{"):
                    end = f.next(end + 1)
                end += f.is_(end, ";")
                rows.append(f.row("import", _value(f.t.texts[spec]), None, f.t.begins[i], f.t.ends[end - 1]))
                i, begun = end, True
                continue
            else:
                found = _declared(f, i)
                rows += [f.row(kind, name) for kind, name in found]
                if found and f.is_(i, "export", "declare", "abstract", "async"):
                    # its own words begin no other statement
                    while f.is_(i + 1, *STARTS, "default"):
                        i += 1
        block = f.is_(i, "{")
        i = f.next(i)
        # behind a brace, a semicolon, or a line that may end there
        begun = i < len(f.t) and (f.is_(i - 1, ";") or (block and f.is_(i - 1, "}")) or (f.breaks(i) and f.ends(i - 1)))
    limits += [DYNAMIC for i in range(len(f.t)) if _calls_module(f, i)]
    return rows + [f.row("limitation", None, x) for x in dict.fromkeys(limits)]
