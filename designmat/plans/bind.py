"""Binding: formulas meet a schema and the kind of model they are for."""

from __future__ import annotations

from typing import Any

from designmat.functions.registry import TERM_LEVEL, syntax, syntax_for
from designmat.plans.contrasts import FullDummy, code
from designmat.plans.parser import SPECIAL, Text
from designmat.plans.schema import Schema
from designmat.plans.terms import (
    Call, Categorical, Const, Continuous, Formula, Interaction, Intercept, Matrix, Shift, Sum, TermBase, Var,
    drop_term, has_intercept, interact, members, omits_intercept, parts, plus, symbols,
)


class StatisticalModel:
    """Base of model types. An implicit intercept is added unless omitted; a model that drops it has none."""

    implicit_intercept = True
    drop_intercept = False


class RegressionModel(StatisticalModel):
    pass


class Poly(TermBase):
    """Powers of a continuous variable."""

    def __init__(self, term: TermBase, degree: int):
        self.term, self.degree = term, degree

    def vars(self) -> list[str]:
        return self.term.vars()

    def names(self) -> list[str]:
        return [f"{self.term}^{i}" for i in range(1, self.degree + 1)]

    def columns(self, inner: list) -> list:
        from pyspark.sql import functions as F

        return [F.pow(inner[0][1].cast("double"), F.lit(float(i))) for i in range(1, self.degree + 1)]

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Poly) and (self.term, self.degree) == (other.term, other.degree)

    def __hash__(self) -> int:
        return hash((self.term, self.degree))

    def __str__(self) -> str:
        return f"poly({self.term}, {self.degree})"


def unprotected(t: TermBase) -> TermBase:
    """A protected expression with the formula meaning of its operators."""
    if isinstance(t, Call) and t.fn in SPECIAL:
        args = [unprotected(a) for a in t.args]
        out = args[0]
        for a in args[1:]:
            out = SPECIAL[t.fn](out, a)
        return out
    if isinstance(t, Call) and t.fn in TERM_LEVEL:
        return TERM_LEVEL[t.fn](*map(unprotected, t.args))
    return t


def _shift(call: Call, kind: str, bind) -> Shift:
    if len(call.args) not in (1, 2):
        raise ValueError(f"{kind} takes a term and a number of rows: {call}")
    steps = call.args[1] if len(call.args) == 2 else Const(1)
    if not isinstance(steps, Const) or steps.n != int(steps.n):
        raise ValueError(f"{kind} needs a whole number of rows: {call}")
    return Shift(bind(unprotected(call.args[0])), int(steps.n), kind)


@syntax("lag")
def _lag(call: Call, schema: Schema, bind) -> Shift:
    return _shift(call, "lag", bind)


@syntax("lead")
def _lead(call: Call, schema: Schema, bind) -> Shift:
    return _shift(call, "lead", bind)


@syntax("poly")
def _poly(call: Call, schema: Schema, bind) -> Poly:
    if len(call.args) != 2 or not isinstance(call.args[1], Const) or call.args[1].n != int(call.args[1].n) or call.args[1].n < 1:
        raise ValueError(f"poly takes a variable and a whole degree: {call}")
    inner = bind(call.args[0])
    if not isinstance(inner, Continuous | Call):
        raise ValueError(f"poly is for continuous variables: {call}")
    return Poly(inner, int(call.args[1].n))


def apply_schema(t: Any, schema: Schema, model: type | None = None) -> Any:
    """Bind a term, a tuple of terms or a formula. Without a model no intercept is added and nothing is promoted."""
    if isinstance(t, tuple):
        return plus(*(apply_schema(x, schema, model) for x in t))
    bind = lambda x: apply_schema(x, schema, model)
    if isinstance(t, Formula):
        rhs = _full_rank(t, schema, model) if model is not None else bind(t.rhs)
        return Formula(None if t.lhs is None else bind(t.lhs), collect(rhs))
    if isinstance(t, Const):
        if t.n in (0, -1, 1):
            return Intercept(t.n == 1)
        raise ValueError(f"only 1, 0 and -1 can stand as terms of a formula, not {t.n}")
    if isinstance(t, Var):
        if t.name not in schema:
            raise KeyError(f"variable '{t.name}' isn't in the schema")
        return schema[t.name]
    if isinstance(t, Continuous | Categorical):
        return schema.get(t.name, t)
    if isinstance(t, Matrix):
        return Matrix(tuple(map(bind, t.terms)))
    if isinstance(t, Sum):
        return plus(*map(bind, t.terms))
    if isinstance(t, Interaction):
        out = bind(t.terms[0])
        for x in t.terms[1:]:
            out = interact(out, bind(x))
        return out
    if isinstance(t, Shift):
        return Shift(bind(t.term), t.steps, t.kind)
    if isinstance(t, Call):
        return _call(t, schema, model)
    return t


def _call(t: Call, schema: Schema, model: type | None) -> TermBase:
    bind = lambda x: apply_schema(x, schema, model)
    if t.fn == "protect":
        return _within(_only(t), schema, model)
    if t.fn == "unprotect":
        return bind(unprotected(_only(t)))
    if t.fn in TERM_LEVEL:
        return bind(TERM_LEVEL[t.fn](*(bind(a) if not isinstance(a, Const | Text) else a for a in t.args)))
    own = syntax_for(t.fn, model)
    if own is not None:
        return own(t, schema, bind)
    return Call(t.fn, tuple(_within(a, schema, model) for a in t.args), t.text)


def _within(a: TermBase, schema: Schema, model: type | None) -> TermBase:
    """An argument of a protected call: left as it is, but for calls that mean more."""
    return _call(a, schema, model) if isinstance(a, Call) else a


def _only(t: Call) -> TermBase:
    if len(t.args) != 1:
        raise ValueError(f"{t.fn} takes one argument: {t}")
    return t.args[0]


def collect(rhs: TermBase) -> Any:
    """Matrix terms joined to one matrix, the others after it on their own."""
    terms = members(rhs)
    matrix, rest = tuple(x for x in terms if x.is_matrix_term), tuple(x for x in terms if not x.is_matrix_term)
    if not rest:
        return Matrix(matrix)
    return (Matrix(matrix), *rest) if matrix else rest if len(rest) > 1 else rest[0]


def _full_rank(f: Formula, schema: Schema, model: type) -> TermBase:
    rhs, seen = f.rhs, []
    if getattr(model, "drop_intercept", False):
        if has_intercept(f):
            raise ValueError(f"{model.__name__} has no intercept, but the formula asks for one: {f}")
        seen.append(frozenset([1]))
    elif getattr(model, "implicit_intercept", False) and not has_intercept(f) and not omits_intercept(f):
        rhs = plus(Const(1), rhs)

    def repair(c: TermBase, context: TermBase) -> TermBase:
        if not isinstance(c, Categorical):
            return c
        aliased = symbols(drop_term(context, c))
        if aliased in seen:
            return c
        seen.append(aliased)
        return Categorical(c.name, code(FullDummy(levels=c.contrasts.levels), c.contrasts.levels))

    out = []
    for t in members(rhs):
        seen.append(symbols(apply_schema(t, schema, model) if isinstance(t, Const) else t))
        bound = apply_schema(t, schema, model)
        if isinstance(bound, Interaction):
            out.append(Interaction(tuple(repair(c, bound) for c in bound.terms)))
        elif isinstance(bound, Sum):
            out += [repair(c, c) for c in bound.terms]
        else:
            out.append(repair(bound, bound))
    return plus(*out)


def is_bound(t: Any) -> bool:
    """Whether columns can be made of a term as it is. Plain calls count as unbound at the top."""
    if isinstance(t, Formula):
        return all(map(is_bound, parts(t.rhs)))
    if isinstance(t, Sum | Interaction):
        return all(map(is_bound, t.terms))
    return is_bound(t.term) if isinstance(t, Shift) else not isinstance(t, Var | Const | Call)


__all__ = ["apply_schema", "collect", "is_bound", "StatisticalModel", "RegressionModel", "Poly", "Text", "unprotected"]
