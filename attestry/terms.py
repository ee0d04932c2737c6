"""Terms of the goal language: reading, printing, and the tagged form that fact columns hold.

A term is an atom, a number, a string, a variable, a call ``(p a b)``, a conjunction ``(and ...)`` or,
outermost only, a query ``(find (?x ...) body)``.  In fact columns an argument is a string with a tag
before it (``a:`` atom, ``n:`` number, ``s:`` string in JSON, ``c:`` call in print), so that equality
of columns is equality of terms and an atom never equals a number or string spelt alike.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

_LEXEME = re.compile(r'(?P<space>\s+|;[^\n]*)|(?P<string>"(?:[^"\\]|\\.)*")|(?P<paren>[()])|(?P<plain>[^\s()]+)', re.S)
_NUMBER = re.compile(r"-?(?:\d+\.?\d*|\.\d+)")


class TermError(ValueError):
    """A text that is no term, or a term in the wrong place."""


@dataclass(frozen=True)
class Term:
    kind: str  # atom, number, string, variable, call, and, find
    value: object = None  # name, number or predicate
    args: tuple["Term", ...] = ()

    def variables(self) -> set[str]:
        return {self.value} if self.kind == "variable" else set().union(*(a.variables() for a in self.args))

    @property
    def ground(self) -> bool:
        return not self.variables()


def _lexemes(text: str) -> list[tuple[str, str]]:
    if not isinstance(text, str):
        raise TermError("a term is read from text")
    return [(m.lastgroup, m.group()) for m in _LEXEME.finditer(text) if m.lastgroup != "space"]


class _Reader:
    def __init__(self, text: str):
        self.items, self.at = _lexemes(text), 0

    def peek(self, ahead: int = 0) -> str | None:
        i = self.at + ahead
        return self.items[i][1] if i < len(self.items) else None

    def take(self, want: str | None = None) -> tuple[str, str]:
        if self.at >= len(self.items):
            raise TermError(f"ends where {want or 'a term'} should follow")
        kind, text = self.items[self.at]
        if want and (kind != "paren" or text != want):
            raise TermError(f"{text} where {want} should follow")
        self.at += 1
        return kind, text

    def until_close(self) -> tuple[Term, ...]:
        found = []
        while self.peek() != ")" or self.items[self.at][0] != "paren":
            found.append(self.term())
        self.take(")")
        return tuple(found)

    def term(self) -> Term:
        kind, text = self.take()
        if kind == "string":
            return Term("string", json.loads(text))
        if kind == "plain":
            if text.startswith('"'):
                raise TermError(f"{text} is never closed")
            if text.startswith("?"):
                return Term("variable", text[1:])
            return Term("number", float(text)) if _NUMBER.fullmatch(text) else Term("atom", text)
        if text == ")":
            raise TermError("closes what was never opened")
        kind, head = self.take()
        if kind == "paren":
            raise TermError("a call needs a predicate")
        if head == "find":
            raise TermError("find stands outermost only")
        args = self.until_close()
        return Term("and", None, args) if head == "and" else Term("call", head, args)

    def whole(self) -> Term:
        if (self.peek(), self.peek(1), self.peek(2)) == ("(", "find", "("):
            self.at += 3
            names = self.until_close()
            if any(v.kind != "variable" for v in names):
                raise TermError("find binds variables only")
            t = Term("find", tuple(v.value for v in names), (self.term(),))
            self.take(")")
        else:
            t = self.term()
        if self.at < len(self.items):
            raise TermError(f"{self.peek()} after the end")
        return t


def read(text: str) -> Term:
    """The term that ``text`` spells; TermError where it spells none."""
    try:
        return _Reader(text).whole()
    except json.JSONDecodeError as e:
        raise TermError(str(e)) from e


def _number(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e21 else repr(x)


def show(t: Term) -> str:
    """Canonical print; ``read(show(t)) == t``."""
    if t.kind == "variable":
        return f"?{t.value}"
    if t.kind == "number":
        return _number(t.value)
    if t.kind == "string":
        return json.dumps(t.value, ensure_ascii=False)
    if t.kind == "atom":
        return t.value
    if t.kind == "find":
        return f"(find ({' '.join('?' + v for v in t.value)}) {show(t.args[0])})"
    return "(" + " ".join(["and" if t.kind == "and" else t.value, *map(show, t.args)]) + ")"


_TAGS = {"atom": "a", "number": "n", "string": "s", "call": "c", "and": "c"}


def tagged(t: Term) -> str:
    """The form of a ground argument in fact columns."""
    return f"{_TAGS[t.kind]}:{show(t)}"


def untagged(x: str) -> Term:
    return Term("string", json.loads(x[2:])) if x[0] == "s" else read(x[2:])


def call_of(text: str | None) -> Term | None:
    """The call that a stored text spells, or None (no text, no term, or no call)."""
    try:
        t = read(text) if text else None
    except TermError:
        return None
    return t if t is not None and t.kind == "call" else None


def goals(t: Term) -> tuple[Term, ...]:
    """The goals of a query body: a conjunction's parts, else the one term."""
    return t.args if t.kind == "and" else (t,)


def bind(pattern: Term, fact: Term, known: dict[str, Term] | None = None) -> dict[str, Term] | None:
    """Bindings that make ``pattern`` equal to the ground ``fact``, or None; the row-wise form of what plans do with columns."""
    known = {} if known is None else known
    if pattern.kind == "variable":
        return known if known.setdefault(pattern.value, fact) == fact else None
    if (pattern.kind, pattern.value, len(pattern.args)) != (fact.kind, fact.value, len(fact.args)):
        return None
    for a, b in zip(pattern.args, fact.args):
        if bind(a, b, known) is None:
            return None
    return known
