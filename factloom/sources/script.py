"""Declarations and imports of JavaScript and TypeScript texts.

A lexer drops comments and knows strings, templates and regular expressions, so
that braces and keywords inside them count for nothing. A reader then walks the
tokens: a declaration begins a line, at brace depth 0 or, for methods, directly
inside a class body; its head may go over several lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

_OPEN, _CLOSE = "([{", ")]}"
#: After one of these names a slash begins a regular expression.
_BEFORE_PATTERN = ("return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "yield", "await")


class Token(NamedTuple):
    kind: str  # name, string, mark or other
    text: str
    line: int
    at: int
    first: bool  # no other token stands before it on its line


def _end_of_quoted(text: str, at: int) -> int:
    """Where a string that begins at ``at`` has ended; one without an end stops with its line."""
    quote, i = text[at], at + 1
    while i < len(text) and text[i] != quote and text[i] != "\n":
        i += 2 if text[i] == "\\" else 1
    return min(i + (i < len(text) and text[i] == quote), len(text))


def _end_of_template(text: str, at: int) -> int:
    """Where a template has ended, whatever its substitutions hold."""
    i = at + 1
    while i < len(text):
        if text[i] == "\\":
            i += 2
        elif text[i] == "`":
            return i + 1
        elif text.startswith("${", i):
            level, i = 1, i + 2
            while i < len(text) and level:
                c = text[i]
                if c in "'\"":
                    i = _end_of_quoted(text, i)
                elif c == "`":
                    i = _end_of_template(text, i)
                else:
                    level += (c == "{") - (c == "}")
                    i += 1
        else:
            i += 1
    return len(text)


def _end_of_pattern(text: str, at: int) -> int | None:
    """Where a regular expression has ended; None if its line holds no end."""
    i, inside = at + 1, False
    while i < len(text) and text[i] != "\n":
        c = text[i]
        if c == "\\":
            i += 1
        elif c == "/" and not inside:
            return i + 1
        else:
            inside = c == "[" or inside and c != "]"
        i += 1
    return None


def tokens(text: str) -> Iterator[Token]:
    line, at, newest, before = 1, 0, 0, None
    word = re.compile(r"[\w$]+")
    while at < len(text):
        c = text[at]
        if c == "\n":
            line, at = line + 1, at + 1
            continue
        if c.isspace():
            at += 1
            continue
        if text.startswith("//", at):
            end = text.find("\n", at)
            at = len(text) if end < 0 else end
            continue
        if text.startswith("/*", at):
            end = text.find("*/", at + 2)
            end = len(text) if end < 0 else end + 2
            line += text.count("\n", at, end)
            at = end
            continue
        kind, end = "mark", at + 1
        if c in "'\"":
            kind, end = "string", _end_of_quoted(text, at)
        elif c == "`":
            kind, end = "other", _end_of_template(text, at)
        elif found := word.match(text, at):
            kind, end = "other" if c.isdigit() else "name", found.end()
        elif c == "/" and (before is None or before.kind == "mark" and before.text not in (")", "]", "}") or before.kind == "name" and before.text in _BEFORE_PATTERN):
            if (closed := _end_of_pattern(text, at)) is not None:
                kind, end = "other", closed
        elif text.startswith(("=>", "=="), at):
            end = at + 2
        elif text.startswith("...", at):
            end = at + 3
        before = Token(kind, text[at:end], line, at, newest != line)
        newest = line + text.count("\n", at, end)
        yield before
        line, at = newest, end


@dataclass
class Declaration:
    kind: str
    name: str
    line: int
    end: int
    arguments: str | None = None
    base: str | None = None
    returns: str | None = None
    is_async: bool = False
    parent: str | None = None


@dataclass
class Reading:
    declarations: list[Declaration] = field(default_factory=list)
    exported: set[str] = field(default_factory=set)
    imports: list[tuple[str, int, str]] = field(default_factory=list)  # kind, line, specifier


class _Reader:
    def __init__(self, text: str):
        self.text = text
        self.tokens = list(tokens(text))
        self.partner = self._partners()

    def _partners(self) -> dict[int, int]:
        """Token numbers of closing brackets by those of the opening ones."""
        out, open_ = {}, []
        for i, t in enumerate(self.tokens):
            if t.kind != "mark":
                continue
            if t.text in _OPEN:
                open_.append(i)
            elif t.text in _CLOSE and open_ and self.tokens[open_[-1]].text == _OPEN[_CLOSE.index(t.text)]:
                out[open_.pop()] = i
        return out

    def is_(self, i: int, *texts: str) -> bool:
        return i < len(self.tokens) and self.tokens[i].kind in ("name", "mark") and self.tokens[i].text in texts

    def name(self, i: int) -> str | None:
        return self.tokens[i].text if i < len(self.tokens) and self.tokens[i].kind == "name" else None

    def source(self, i: int, j: int) -> str:
        """What stands from token i up to token j, in one line."""
        if i >= j or j > len(self.tokens):
            return ""
        last = self.tokens[j - 1]
        return re.sub(r"\s+", " ", self.text[self.tokens[i].at : last.at + len(last.text)]).strip()

    def inside(self, i: int) -> str:
        """What stands in the brackets that open at token i."""
        return self.text[self.tokens[i].at + 1 : self.tokens[self.partner[i]].at]

    def until(self, i: int, *texts: str) -> int:
        """The first token from i that is one of the texts and in no brackets of its own; the number of tokens if there is none."""
        while i < len(self.tokens) and not self.is_(i, *texts):
            if self.is_(i, ";"):
                return len(self.tokens)
            i = self.partner.get(i, i) + 1
        return i

    def last_line(self, i: int, otherwise: int) -> int:
        """The line of the brace that closes what opens at token i."""
        return self.tokens[self.partner[i]].line if self.is_(i, "{") and i in self.partner else otherwise

    def generic(self, i: int) -> int:
        """Past type parameters in angle brackets."""
        if not self.is_(i, "<"):
            return i
        level = 0
        while i < len(self.tokens):
            level += self.is_(i, "<") - self.is_(i, ">")
            i += 1
            if not level:
                break
        return i

    def callable(self, i: int, line: int, kind: str, name: str, is_async: bool, parent: str | None = None) -> Declaration | None:
        """A function whose parameters open at token i and whose body is a block."""
        i = self.generic(i)
        if not self.is_(i, "(") or i not in self.partner:
            return None
        after = self.partner[i] + 1
        body = after
        if self.is_(after, ":"):
            # a type may itself hold objects in braces: the body is the block that nothing of a type follows
            body = self.until(after + 1, "{")
            while body in self.partner and self.is_(follow := self.partner[body] + 1, ">", "|", "&", ",", "[", "]", "{") and not (self.is_(follow, "[", "{") and self.tokens[follow].first):
                body = self.until(follow, "{")
        if not self.is_(body, "{"):
            return None
        returns = self.source(after + 1, body) if body > after else ""
        return Declaration(kind, name, line, self.last_line(body, line), self.inside(i), None, returns or None, is_async, parent)

    def arrow(self, i: int, line: int, name: str) -> Declaration | None:
        """An arrow function from token i on, after the equals sign."""
        is_async = self.is_(i, "async") and not self.is_(i + 1, "=>")
        i += is_async
        i = self.generic(i)
        if self.is_(i, "(") and i in self.partner:
            arguments, after = self.inside(i), self.partner[i] + 1
        elif self.name(i):
            arguments, after = self.name(i), i + 1
        else:
            return None
        to = self.until(after + 1, "=>") if self.is_(after, ":") else after
        if not self.is_(to, "=>"):
            return None
        returns = self.source(after + 1, to) if to > after else ""
        return Declaration("function", name, line, self.last_line(to + 1, line), arguments, None, returns or None, is_async)

    def class_(self, i: int, line: int) -> tuple[list[Declaration], str] | None:
        name = self.name(i)
        if not name:
            return None
        body = self.until(i + 1, "{")
        base, at = None, self.generic(i + 1)
        if self.is_(at, "extends"):
            base = self.source(at + 1, min(body, len(self.tokens))) or None
        out = [Declaration("class", name, line, self.last_line(body, line), None, base)]
        if body in self.partner:
            at = body + 1
            while at < self.partner[body]:
                t = self.tokens[at]
                if t.first:
                    head = at + self.is_(at, "static")
                    is_async = self.is_(head, "async") and not self.is_(head + 1, "(")
                    head += is_async
                    member = self.name(head)
                    found = self.callable(head + 1, t.line, "method", member, is_async, name) if member else None
                    if found:
                        out.append(found)
                at = self.partner.get(at, at) + 1
        return out, name

    def statement(self, i: int, out: Reading) -> None:
        """A top-level statement that begins a line with token i."""
        line = self.tokens[i].line
        exported = self.is_(i, "export")
        at = i + exported
        default = exported and self.is_(at, "default")
        at += default
        if exported and self.is_(at, "{") and at in self.partner and not self.is_(self.partner[at] + 1, "from"):
            names = (x.split(" as ")[0].strip() for x in self.inside(at).split(","))
            out.exported |= {x for x in names if x}
            return
        is_async = self.is_(at, "async") and self.is_(at + 1, "function")
        if self.is_(at + is_async, "function"):
            head = at + is_async + 1
            head += self.is_(head, "*")
            name = self.name(head)
            found = self.callable(head + 1, line, "function", name, is_async) if name else None
            if found:
                out.declarations.append(found)
            if exported and name:
                out.exported.add(name)
        elif self.is_(at, "class"):
            found = self.class_(at + 1, line)
            if found:
                out.declarations += found[0]
                if exported:
                    out.exported.add(found[1])
        elif self.is_(at, "const", "let", "var") and not default:
            name = self.name(at + 1)
            equals = self.until(at + 2, "=") if self.is_(at + 2, ":") else at + 2
            if name and self.is_(equals, "="):
                if exported:
                    out.exported.add(name)
                found = self.arrow(equals + 1, line, name)
                if found:
                    out.declarations.append(found)
        elif default and self.name(at) and (at + 1 >= len(self.tokens) or self.is_(at + 1, ";") or self.tokens[at + 1].first):
            out.exported.add(self.name(at))

    def specifier(self, i: int) -> tuple[str, int, str] | None:
        """The import of the statement that begins with token i, if its specifier stands on the same line."""
        t = self.tokens[i]
        kind = {"import": "import", "export": "re-export"}.get(t.text) if t.kind == "name" else None
        if not kind:
            return None
        for j in range(i + 1, len(self.tokens)):
            x = self.tokens[j]
            if x.line != t.line or self.is_(j, ";", "=", "("):
                return None
            if x.kind == "string":
                named = self.is_(j - 1, "from") or kind == "import" and j == i + 1
                return (kind, t.line, x.text[1:-1]) if named and len(x.text) > 2 else None
        return None

    def read(self) -> Reading:
        out = Reading()
        depth = 0
        for i, t in enumerate(self.tokens):
            if t.first and not depth:
                self.statement(i, out)
            if t.first and (found := self.specifier(i)):
                out.imports.append(found)
            if self.is_(i, "require") and self.is_(i + 1, "(") and i + 3 < len(self.tokens) and self.tokens[i + 2].kind == "string" and self.is_(i + 3, ")") and len(self.tokens[i + 2].text) > 2:
                out.imports.append(("require", t.line, self.tokens[i + 2].text[1:-1]))
            depth = max(0, depth + self.is_(i, "{") - self.is_(i, "}"))
        return out


def read(text: str) -> Reading:
    """All top-level functions and classes with their methods, exported names, and imports in the order of their lines."""
    return _Reader(text).read()
