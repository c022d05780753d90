"""Formula text to terms: an operator-precedence parser; nothing is evaluated."""

from __future__ import annotations

import re
import warnings

from designmat.errors import FormulaSyntaxError
from designmat.plans.terms import Call, Const, Formula, Sum, TermBase, Var, cleanup, interact, plus, star

TOKEN = re.compile(r"\s*(?:(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<name>[^\W\d][\w.]*(?:!(?!=))?|`[^`]+`)|(?P<str>\"[^\"]*\")|(?P<op>==|!=|<=|>=|[-+*/^&|%÷<>!~(),$=:\[\]]))")
#: Binding powers; tilde is lowest, powers are highest.
POWER = {"~": 1, "==": 2, "!=": 2, "<": 2, "<=": 2, ">": 2, ">=": 2, "+": 3, "-": 3, "|": 3, "*": 4, "&": 4, "/": 4, "%": 4, "÷": 4, "^": 6}
SPECIAL = {"+": plus, "&": interact, "*": star}


class _Node:
    """A call before its meaning is settled, with its place among operators."""

    def __init__(self, fn: str, args: list, infix: bool):
        self.fn, self.args, self.infix = fn, args, infix

    def text(self) -> str:
        if not self.infix:
            return f"{self.fn}({', '.join(map(_text, self.args))})"
        if len(self.args) == 1:
            inner = _text(self.args[0])
            return f"{self.fn}({inner})" if isinstance(self.args[0], _Node) and self.args[0].infix else f"{self.fn}{inner}"
        level, out = POWER[self.fn], []
        for a in self.args:
            t = _text(a)
            inner = a.infix and len(a.args) > 1 and POWER[a.fn] <= level if isinstance(a, _Node) else False
            out.append(f"({t})" if inner else t)
        return f" {self.fn} ".join(out)


def _text(x: _Node | TermBase | str) -> str:
    return x.text() if isinstance(x, _Node) else f'"{x}"' if isinstance(x, str) else str(x)


class _Parser:
    def __init__(self, text: str):
        self.text, self.tokens, at = text, [], 0
        while text[at:].strip():
            m = TOKEN.match(text, at)
            if not m:
                self.fail("can't read this", at + len(text[at:]) - len(text[at:].lstrip()))
            self.tokens.append((m.lastgroup, m[m.lastgroup], m.start(m.lastgroup)))
            at = m.end()
        self.i = 0

    def fail(self, why: str, at: int | None = None) -> None:
        raise FormulaSyntaxError(why, self.text, len(self.text) if at is None else at)

    def peek(self) -> str | None:
        return self.tokens[self.i][1] if self.i < len(self.tokens) and self.tokens[self.i][0] == "op" else None

    def place(self) -> int:
        return self.tokens[self.i][2] if self.i < len(self.tokens) else len(self.text)

    def expression(self, least: int = 0):
        left = self.prefix()
        while (op := self.peek()) in POWER and POWER[op] >= max(least, 1):
            at = self.place()
            self.i += 1
            if op == "~":
                if least > 1:
                    self.fail("~ can't stand here", at)
                right = self.expression(1)
            else:
                right = self.expression(POWER[op] if op == "^" else POWER[op] + 1)
            if op in ("+", "*") and isinstance(left, _Node) and left.infix and left.fn == op and len(left.args) > 1 and not getattr(left, "closed", False):
                left.args.append(right)
            else:
                left = _Node(op, [left, right], True)
        return left

    def prefix(self):
        if self.i >= len(self.tokens):
            self.fail("the formula ends too early")
        kind, value, at = self.tokens[self.i]
        self.i += 1
        if kind == "num":
            return Const(float(value) if re.search(r"[.eE]", value) else int(value))
        if kind == "str":
            return value[1:-1]
        if kind == "name":
            name = value.strip("`")
            if self.peek() == "(" and value[0] != "`":
                return _Node(name, self.arguments(), False)
            return None if value == "nothing" else Var(name)
        if value == "(":
            inner = self.expression()
            self.expect(")")
            if isinstance(inner, _Node):
                inner.closed = True
            return inner
        if value == "-" and self.i < len(self.tokens) and self.tokens[self.i][0] == "num":
            if self.tokens[self.i + 1 : self.i + 2] and self.tokens[self.i + 1][1] == "^":  # a power binds first
                return _Node("-", [self.expression(5)], True)
            return Const(-self.prefix().n)
        if value in ("+", "-", "!", "&", "*"):
            if value in ("&", "*") and self.peek() != "(":
                self.fail(f"{value} needs a left side", at)
            return _Node(value, [self.expression(5)], True)
        self.fail("interpolation isn't supported" if value == "$" else f"{value} can't stand here", at)

    def arguments(self) -> list:
        self.expect("(")
        out = []
        while self.peek() != ")":
            out.append(self.expression())
            if self.peek() != ")":
                self.expect(",")
        self.expect(")")
        return out

    def expect(self, op: str) -> None:
        if self.peek() != op:
            self.fail(f"{op} expected", self.place())
        self.i += 1


def _settle(x, free: bool):
    """Terms of a parsed expression; free: the specials have their formula meaning here."""
    if not isinstance(x, _Node):
        return x
    if free and x.infix and x.fn in SPECIAL:
        args = [_settle(a, True) for a in x.args]
        if len(args) == 1:
            return args[0]
        out = args[0]
        for a in args[1:]:
            out = SPECIAL[x.fn](out, a)
        return out
    if x.fn == "~":
        raise FormulaSyntaxError(f"~ can stand at the top only: {x.text()}")
    if free and x.infix and x.fn == "-" and len(x.args) == 2:
        warnings.warn(f"'{x.text()}' is one column: minus has no formula meaning; write + 0 or + -1 to omit the intercept", stacklevel=4)
    args = tuple(a if not isinstance(a, str) else Text(a) for a in (_settle(a, False) for a in x.args))
    return Call(x.fn, args, x.text())


class Text(TermBase):
    """A string argument of a function."""

    def __init__(self, value: str):
        self.value = value

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Text) and other.value == self.value

    def __hash__(self) -> int:
        return hash(self.value)

    def __str__(self) -> str:
        return f'"{self.value}"'


def formula(text: str) -> Formula:
    """Read ``response ~ predictors``."""
    p = _Parser(text)
    top = p.expression()
    if p.i < len(p.tokens):
        p.fail("can't read on from here", p.place())
    if not isinstance(top, _Node) or top.fn != "~" or not top.infix or len(top.args) != 2:
        raise FormulaSyntaxError("a formula has two sides with ~ between them; leave out the response with 0 ~ ...", text, 0)
    lhs, rhs = (_settle(a, True) for a in top.args)
    if isinstance(rhs, str) or isinstance(lhs, str) or rhs is None:
        raise FormulaSyntaxError("a string can stand inside a function only", text, 0)
    return Formula(lhs, cleanup(rhs))


__all__ = ["formula", "Text", "Sum"]
