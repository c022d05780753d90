"""The term algebra: immutable terms, the operators + & * ~, and what can be asked of a term without data."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from itertools import product
from typing import Any

from designmat.errors import UnboundTermError
from designmat.plans.contrasts import ContrastsMatrix, level_text


class TermBase:
    """Anything that can stand in a formula. Own terms subclass it and define names, columns and vars."""

    is_matrix_term = True

    def __add__(self, other: TermBase) -> TermBase:
        return plus(self, other)

    def __radd__(self, other: Any) -> TermBase:  # so that sum() works on a list of terms
        return self if isinstance(other, int) and other == 0 else plus(term(other), self)

    def __and__(self, other: TermBase) -> TermBase:
        return interact(self, other)

    def __mul__(self, other: TermBase) -> TermBase:
        return star(self, other)

    def __pos__(self) -> TermBase:
        return self

    def tilde(self, rhs: TermBase) -> Formula:
        return Formula(self, cleanup(rhs))

    def vars(self) -> list[str]:
        return []

    def names(self) -> list[str]:
        raise UnboundTermError(f"the columns of {self} aren't known yet. Did you forget to call apply_schema?")

    def width(self) -> int:
        return len(self.names())


@dataclass(frozen=True)
class Var(TermBase):
    """A variable that isn't bound yet."""

    name: str

    def vars(self) -> list[str]:
        return [self.name]

    def __str__(self) -> str:
        return self.name if self.name.isidentifier() else f"`{self.name}`"


@dataclass(frozen=True)
class Const(TermBase):
    n: int | float

    def names(self) -> list[str]:
        return [str(self.n)]

    def __str__(self) -> str:
        return str(self.n)


@dataclass(frozen=True)
class Intercept(TermBase):
    present: bool

    def names(self) -> list[str]:
        return ["(Intercept)"] if self.present else []

    def __str__(self) -> str:
        return "1" if self.present else "0"


@dataclass(frozen=True)
class Continuous(TermBase):
    """A numeric variable with its statistics."""

    name: str
    mean: float = math.nan
    var: float = math.nan
    min: float = math.nan
    max: float = math.nan

    def vars(self) -> list[str]:
        return [self.name]

    def names(self) -> list[str]:
        return [self.name]

    def __str__(self) -> str:
        return str(Var(self.name))


@dataclass(frozen=True)
class Categorical(TermBase):
    """A variable of levels with its contrasts."""

    name: str
    contrasts: ContrastsMatrix

    def vars(self) -> list[str]:
        return [self.name]

    def names(self) -> list[str]:
        return [f"{self.name}: {x}" for x in self.contrasts.names]

    def __str__(self) -> str:
        return str(Var(self.name))


@dataclass(frozen=True)
class Call(TermBase):
    """A function of row values; its text names the column."""

    fn: str
    args: tuple[TermBase, ...]
    text: str

    def vars(self) -> list[str]:
        return unique(v for a in self.args for v in a.vars())

    def names(self) -> list[str]:
        return [self.text]

    def __str__(self) -> str:
        return self.text


@dataclass(frozen=True)
class Interaction(TermBase):
    terms: tuple[TermBase, ...]

    def vars(self) -> list[str]:
        return unique(v for t in self.terms for v in t.vars())

    def names(self) -> list[str]:
        # The first term varies fastest.
        return [" & ".join(reversed(x)) for x in product(*(t.names() for t in reversed(self.terms)))]

    def __str__(self) -> str:
        return " & ".join(f"({t})" if isinstance(t, Call) and t.fn in INFIX else str(t) for t in self.terms)


@dataclass(frozen=True)
class Shift(TermBase):
    """Values of a term some rows before (lag, positive) or after (lead)."""

    term: TermBase
    steps: int
    kind: str = "lag"

    def vars(self) -> list[str]:
        return self.term.vars()

    def names(self) -> list[str]:
        return [f"{n}_{self.kind}{self.steps}" for n in self.term.names()]

    @property
    def offset(self) -> int:
        return self.steps if self.kind == "lag" else -self.steps

    def __str__(self) -> str:
        return f"{self.kind}({self.term}, {self.steps})"


@dataclass(frozen=True)
class Sum(TermBase):
    """Several terms side by side."""

    terms: tuple[TermBase, ...]

    def vars(self) -> list[str]:
        return unique(v for t in self.terms for v in t.vars())

    def names(self) -> list[str]:
        return [n for t in self.terms for n in t.names()]

    def __str__(self) -> str:
        return " + ".join(map(str, self.terms))


class Matrix(Sum):
    """Bound terms that make one matrix."""


@dataclass(frozen=True)
class Formula(TermBase):
    lhs: TermBase | None
    rhs: TermBase | tuple[TermBase, ...]

    def vars(self) -> list[str]:
        return unique(v for t in (self.lhs, *parts(self.rhs)) if t is not None for v in t.vars())

    def names(self) -> tuple[list[str], list[str]]:
        return ([] if self.lhs is None else self.lhs.names()), [n for t in parts(self.rhs) for n in t.names()]

    def width(self) -> tuple[int, int]:
        return tuple(map(len, self.names()))

    def __str__(self) -> str:
        return f"{'' if self.lhs is None else self.lhs} ~ {' + '.join(map(str, parts(self.rhs)))}"


INFIX = {"+", "-", "*", "/", "^", "&", "|", "%", "÷", "==", "!=", "<", "<=", ">", ">="}


def unique(items: Iterable) -> list:
    return list(dict.fromkeys(items))


def term(x: Any) -> TermBase:
    """A number gives a constant, a string a variable, a term itself."""
    if isinstance(x, TermBase):
        return x
    if isinstance(x, str):
        return Var(x)
    if isinstance(x, int | float) and not isinstance(x, bool):
        return Const(x)
    raise TypeError(f"no term can be made of {x!r}")


def members(t: TermBase) -> tuple[TermBase, ...]:
    return t.terms if isinstance(t, Sum) else (t,)


def parts(rhs: TermBase | tuple[TermBase, ...]) -> tuple[TermBase, ...]:
    """The right side as separate results: usually one matrix."""
    return rhs if isinstance(rhs, tuple) else (rhs,)


def plus(*terms: TermBase) -> TermBase:
    """Terms in order, each once."""
    found = unique(m for t in terms for m in members(t))
    return found[0] if len(found) == 1 else Sum(tuple(found))


def interact(a: TermBase, b: TermBase) -> TermBase:
    """a & b: spreads over sums (the left one outside), drops a constant one, holds each member once."""
    if isinstance(a, Sum) or isinstance(b, Sum):
        return plus(*(interact(x, y) for x in members(a) for y in members(b)))
    for x, y in ((a, b), (b, a)):
        if isinstance(x, Const):
            if x.n != 1:
                raise ValueError(f"only 1 can stand in an interaction, not {x.n}")
            return y
    found = unique(m for t in (a, b) for m in (t.terms if isinstance(t, Interaction) else (t,)))
    return found[0] if len(found) == 1 else Interaction(tuple(found))


def star(*terms: TermBase) -> TermBase:
    return reduce(lambda a, b: plus(a, b, interact(a, b)), terms)


def degree(t: TermBase) -> float:
    if isinstance(t, Const | Intercept):
        return 0
    if isinstance(t, Interaction):
        return sum(map(degree, t.terms))
    return math.inf if isinstance(t, Call) and t.fn == "|" else 1


def cleanup(rhs: TermBase) -> TermBase:
    return plus(*sorted(members(rhs), key=degree)) if isinstance(rhs, Sum) else rhs


def formula_of(lhs: Any, rhs: Any) -> Formula:
    """lhs ~ rhs from terms, names or numbers."""
    return Formula(term(lhs), cleanup(term(rhs)))


def call(fn: str, *args: Any, text: str | None = None) -> Call:
    """A function term built at run time."""
    terms = tuple(map(term, args))
    if text is None:
        text = f" {fn} ".join(map(wrapped, terms)) if fn in INFIX and len(terms) > 1 else f"{fn}({', '.join(map(str, terms))})"
    return Call(fn, terms, text)


def wrapped(t: TermBase) -> str:
    return f"({t})" if isinstance(t, Call) and t.fn in INFIX and len(t.args) > 1 or isinstance(t, Sum | Interaction) else str(t)


def lag(t: Any, n: int = 1) -> Shift:
    return Shift(term(t), n, "lag")


def lead(t: Any, n: int = 1) -> Shift:
    return Shift(term(t), n, "lead")


def leaves(t: Any) -> list[TermBase]:
    """The leaf terms of a term, each once."""
    if isinstance(t, Formula):
        return unique(x for p in ([] if t.lhs is None else [t.lhs]) + list(parts(t.rhs)) for x in leaves(p))
    below = t.terms if isinstance(t, Sum | Interaction) else t.args if isinstance(t, Call) else (t.term,) if isinstance(t, Shift) else None
    return [t] if below is None else unique(x for b in below for x in leaves(b))


def shifted(t: Any) -> bool:
    """Whether a lag or lead stands anywhere in a term or formula."""
    if isinstance(t, Formula):
        return any(shifted(p) for p in (t.lhs, *parts(t.rhs)) if p is not None)
    below = t.terms if isinstance(t, Sum | Interaction) else getattr(t, "args", ())
    return isinstance(t, Shift) or any(map(shifted, below))


def symbols(t: TermBase) -> frozenset:
    """What a term is compared by when looking for aliases."""
    if isinstance(t, Const):
        return frozenset([t.n])
    if isinstance(t, Intercept):
        return frozenset([1]) if t.present else frozenset()
    if isinstance(t, Call):
        return frozenset([t.text])
    if isinstance(t, Interaction | Sum):
        return frozenset().union(*map(symbols, t.terms))
    if isinstance(t, Shift):
        return frozenset([str(t)])
    return frozenset([t.name]) if hasattr(t, "name") else frozenset([str(t)])


def drop_term(t: Any, gone: TermBase) -> Any:
    """t without a term; what is left of a lone match is the constant 1."""
    same = lambda x: symbols(x) == symbols(gone)
    if isinstance(t, Formula):
        return Formula(t.lhs, drop_term(t.rhs, gone))
    if isinstance(t, tuple):
        return tuple(drop_term(x, gone) for x in t)
    if isinstance(t, Sum | Interaction) and not same(t):
        kept = tuple(x for x in t.terms if not same(x))
        if isinstance(t, Matrix):
            return Matrix(kept)
        return kept[0] if len(kept) == 1 else type(t)(kept) if kept else Const(1)
    return Const(1) if same(t) else t


def has_intercept(t: Any) -> bool:
    rhs = t.rhs if isinstance(t, Formula) else t
    return any(x in (Const(1), Intercept(True)) for p in parts(rhs) for x in members(p))


def omits_intercept(t: Any) -> bool:
    rhs = t.rhs if isinstance(t, Formula) else t
    return any(x in (Const(0), Const(-1), Intercept(False)) for p in parts(rhs) for x in members(p))


def has_response(f: Formula) -> bool:
    return f.lhs is not None and f.lhs not in (Const(0), Intercept(False))


def term_names(t: Any) -> Any:
    """Names by variable: a pair for a formula, a list for a sum, a string (or an empty list) for a term."""
    if isinstance(t, Formula):
        return (None if t.lhs is None else term_names(t.lhs)), [n for p in parts(t.rhs) for m in members(p) for n in _as_list(term_names(m))]
    if isinstance(t, Sum):
        return [n for m in t.terms for n in _as_list(term_names(m))]
    if isinstance(t, Intercept | Const):
        return [] if t in (Intercept(False), Const(0), Const(-1)) else "(Intercept)" if t in (Intercept(True), Const(1)) else str(t.n)
    if isinstance(t, Interaction):
        return " & ".join(str(term_names(m)) for m in t.terms)
    return getattr(t, "name", None) or str(t)


def _as_list(x: Any) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def describe(t: Any) -> str:
    """The long form: kinds of variables and of codings."""
    if isinstance(t, Formula):
        body = [f"  {describe(m)}" for p in parts(t.rhs) for m in members(p)]
        return "\n".join(["Response:", f"  {'' if t.lhs is None else describe(t.lhs)}", "Predictors:", *body])
    if isinstance(t, Var):
        return f"{t}(unknown)"
    if isinstance(t, Continuous):
        return f"{t}(continuous)"
    if isinstance(t, Categorical):
        c = t.contrasts
        return f"{t}({type(c.coding).__name__}:{len(c.levels)}→{len(c.names)})"
    if isinstance(t, Call):
        return f"({', '.join(unique(map(str, leaves(t))))})->{t.text}"
    if isinstance(t, Interaction | Sum):
        return (" & " if isinstance(t, Interaction) else " + ").join(map(describe, t.terms))
    return str(t)


__all__ = [n for n in dir() if not n.startswith("_")] + ["level_text"]
