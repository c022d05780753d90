"""Bound terms to Spark columns: one flat projection, names and columns made by one walk each in the same order."""

from __future__ import annotations

import datetime
import decimal
import json
import math
import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import product
from typing import Any

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from designmat.errors import UnboundTermError
from designmat.functions.registry import FUNCTIONS
from designmat.plans.parser import Text
from designmat.plans.terms import Call, Categorical, Const, Continuous, Formula, Interaction, Intercept, Shift, Sum, TermBase, Var, parts


@dataclass(frozen=True)
class Rows:
    """The order of rows that lag and lead go by, and the columns within whose groups they stay."""

    order_by: Sequence[Any] = field(default_factory=tuple)
    partition_by: Sequence[Any] = field(default_factory=tuple)

    def window(self):
        if not self.order_by:
            raise ValueError("lag and lead need order_by: a table has no row order of its own")
        if not self.partition_by:
            warnings.warn("lag or lead without partition_by moves all rows to one task", stacklevel=2)
            return Window.orderBy(*self.order_by)
        return Window.partitionBy(*self.partition_by).orderBy(*self.order_by)


def rows(order_by: Any = (), partition_by: Any = ()) -> Rows:
    as_tuple = lambda x: (x,) if isinstance(x, str | Column) else tuple(x or ())
    return Rows(as_tuple(order_by), as_tuple(partition_by))


def ref(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def columns(t: TermBase, at: Rows = Rows()) -> list[tuple[str, Column]]:  # noqa: B008
    """(name, column) pairs of a bound term, all doubles but for raw variables."""
    if isinstance(t, Var):
        return _unbound(t)
    if isinstance(t, Sum):
        return [c for x in t.terms for c in columns(x, at)]
    double = isinstance(t, Categorical | Interaction | Intercept | Continuous)
    return list(zip(t.names(), [c if double else _number(c) for c in _columns(t, at)], strict=True))


def _number(c: Column) -> Column:
    return c.cast("double")


def _unbound(t: TermBase) -> Any:
    raise UnboundTermError(f"{t} isn't bound to a schema. Did you forget to call apply_schema?")


def _columns(t: TermBase, at: Rows) -> list[Column]:
    if isinstance(t, Intercept):
        return [F.lit(1.0)] if t.present else []
    if isinstance(t, Const):
        return [F.lit(float(t.n))]
    if isinstance(t, Continuous):
        return [ref(t.name).cast("double")]
    if isinstance(t, Categorical):
        return coded(t)
    if isinstance(t, Call):
        return [value(t, at)]
    if isinstance(t, Shift):
        inner, n = t.term, t.offset
        while isinstance(inner, Shift):  # nested shifts are one
            inner, n = inner.term, n + inner.offset
        return [F.lag(c.cast("double"), n).over(at.window()) for c in _columns(inner, at)]
    if isinstance(t, Interaction):
        out = []
        for combo in product(*(_columns(x, at) for x in reversed(t.terms))):
            cols = list(reversed(combo))
            c = cols[0].cast("double")
            for x in cols[1:]:
                c = c * x.cast("double")
            out.append(c)
        return out
    if isinstance(t, Sum):
        return [c for x in t.terms for c in _columns(x, at)]
    if isinstance(t, Var):
        _unbound(t)
    if hasattr(t, "term"):  # own terms get the columns of what they stand on
        return t.columns(columns(t.term, at))
    return t.columns()


def _sql(v: Any) -> str:
    """A constant as SQL text."""
    if isinstance(v, str):
        return "'" + "".join(x if x.isprintable() and x not in "'\\" else "".join(f"\\u{u:04x}" for u in memoryview(x.encode("utf-16-le")).cast("H")) for x in v) + "'"
    if isinstance(v, float):
        return f"{v!r}D" if math.isfinite(v) else f"double('{v!r}')"
    if isinstance(v, bool) or v is None:
        return str(v).lower()
    if isinstance(v, int):
        return str(v)
    if isinstance(v, datetime.datetime):
        return f"timestamp'{v.isoformat(' ')}'"
    return f"date'{v.isoformat()}'" if isinstance(v, datetime.date) else f"{v}BD" if isinstance(v, decimal.Decimal) else _sql(str(v))


def _array(values: Sequence) -> str:
    """An array of constants, one node of the plan where the values are texts or whole numbers."""
    if all(isinstance(v, str) and "\x01" not in v for v in values):
        return f"split({_sql(chr(1).join(values))}, '\\u0001')"
    if all(isinstance(v, int) and not isinstance(v, bool) for v in values):
        return f"cast(split('{' '.join(map(str, values))}', ' ') as array<bigint>)"
    return f"array({', '.join(map(_sql, values))})"


def _doubles(values: Sequence[float]) -> str:
    return f"cast(split('{' '.join(map(repr, values))}', ' ') as array<double>)"


def _name(t: Categorical) -> str:
    return f"`{t.name.replace('`', '``')}`"


def _unknown(t: Categorical, kind: str) -> str:
    return f"cast(raise_error(concat({_sql(f'level not seen before in {t.name}: ')}, cast({_name(t)} as string))) as {kind})"


def _found(t: Categorical) -> str:
    """The place of the row's level among the levels, 0 for one that isn't known."""
    c, levels = _name(t), _array(t.contrasts.levels)
    if any(isinstance(v, decimal.Decimal) for v in t.contrasts.levels):  # array_position takes decimals of one scale only
        x = f"{c[:-1]}_`"  # a name that isn't the column's
        return f"array_position(transform({levels}, {x} -> {x} = {c}), true)"
    return f"array_position({levels}, {c})"


#: Levels that a column of a coding names one by one; beyond, its values are looked up by the level's place.
NAMED = 16


def coded(t: Categorical) -> list[Column]:
    """A column for each contrast. Null stays null; levels not known are errors.

    Every column looks its value up by the place of the row's level. The place is one expression for all columns and
    nothing above it is conditional: only then does Spark evaluate it once a row, not once a column (of what stands in
    the branches of a case, it shares nothing). A sparse coding names the one or two places that differ from a
    column's commonest value, so that its plan grows with the number of levels only.
    """
    c, m = _name(t), t.contrasts
    found, out = _found(t), []
    place = f"case when {found} > 0 then cast({found} as int) when {c} is null then cast(null as int) else {_unknown(t, 'int')} end"
    for j in range(len(m.names)):
        values, groups = m.column(j), {}
        for i, v in enumerate(values, 1):
            groups.setdefault(v, []).append(i)
        rest = max(groups, key=lambda v: len(groups[v]))
        some = [(i, v) for v, of in groups.items() if v != rest for i in of]
        if 0 < len(some) <= NAMED < len(values):
            numbers, at = _doubles([rest, *(v for _, v in some)]), f"cast(array_position({_array([i for i, _ in some])}, {place}) as int) + 1"
        else:
            numbers, at = _doubles(values), place
        out.append(F.expr(f"element_at({numbers}, {at})"))
    return out


ENTRY = "array<struct<col:int,name:string,value:double>>"


def entries(t: TermBase, at: Rows = Rows(), first: int = 1) -> Column:  # noqa: B008
    """The matrix row of a term as (col, name, value), zeros mostly left out: of a categorical variable only the
    entries of its level's row of the coding, whatever the number of levels."""
    if isinstance(t, Sum):
        out = []
        for x in t.terms:
            out.append(entries(x, at, first))
            first += x.width()
        return F.concat(*out) if out else F.array().cast(ENTRY)
    if not isinstance(t, Categorical):
        return F.array(*[F.struct(F.lit(i).alias("col"), F.lit(n).alias("name"), c.alias("value")) for i, (n, c) in enumerate(columns(t, at), first)]).cast(ENTRY)
    c, m, names = _name(t), t.contrasts, t.names()
    body = _sql(json.dumps([[{"col": first + j, "name": names[j], "value": v} for j, v in m.entries(i)] for i in range(len(m.levels))]))
    empty = _sql(json.dumps([{"col": first + j, "name": n} for j, n in enumerate(names)]))
    place = _found(t)
    return F.expr(
        f"case when {c} is null then from_json({empty}, '{ENTRY}') when {place} > 0 then element_at(from_json({body}, 'array<{ENTRY}>'), cast({place} as int))"
        f" else {_unknown(t, ENTRY)} end"
    )


def value(t: TermBase, at: Rows) -> Column:
    """The one value of a row that a function's argument stands for."""
    if isinstance(t, Var):
        return ref(t.name)
    if isinstance(t, Const):
        return F.lit(t.n)
    if isinstance(t, Text):
        return F.lit(t.value)
    if isinstance(t, Call):
        if t.fn == "protect":
            return value(t.args[0], at)
        if t.fn not in FUNCTIONS:
            raise ValueError(f"no function called '{t.fn}' is registered; see formula_function")
        return FUNCTIONS[t.fn](*(value(a, at) for a in t.args))
    found = _columns(t, at)
    if len(found) != 1:
        raise ValueError(f"{t} has {len(found)} columns and can't be an argument of a function")
    return found[0]


def both(f: Formula, at: Rows = Rows()) -> tuple[list, list]:  # noqa: B008
    """Response and predictor columns of a bound formula."""
    return ([] if f.lhs is None else columns(f.lhs, at)), [c for p in parts(f.rhs) for c in columns(p, at)]


def assign(f: Any) -> list[int]:
    """For each matrix column the number of the term that makes it, from 1; an omitted intercept counts as a term."""
    m = f.rhs if isinstance(f, Formula) else f
    m = m[0] if isinstance(m, tuple) else m
    return [i for i, t in enumerate(m.terms if isinstance(m, Sum) else (m,), 1) for _ in t.names()]
