"""The functions that formulas may call, and the terms that calls may become.

Values follow floating-point rules rather than Spark's: log(0) is -Infinity, 1/0 is Infinity, arithmetic is done
in doubles. A value outside a function's domain is an error in strict mode (the default) and null otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column
from pyspark.sql import functions as F

FUNCTIONS: dict[str, Callable[..., Column]] = {}
SYNTAX: dict[str, Callable] = {}
TERM_LEVEL: dict[str, Callable] = {}
_STRICT = [True]


@contextmanager
def lenient():
    """Within this, values outside a function's domain are null instead of errors."""
    _STRICT.append(False)
    try:
        yield
    finally:
        _STRICT.pop()


def formula_function(name: str, term_level: bool = False) -> Callable:
    """Register a function of columns under a name; with ``term_level`` one of terms, which gives the term that the
    call stands for, also within protected and unprotected calls."""

    def add(f: Callable) -> Callable:
        (TERM_LEVEL if term_level else FUNCTIONS)[name] = f
        return f

    return add


def syntax(name: str, context: type | None = None) -> Callable:
    """Register what a call becomes when it is bound: f(call, schema, bind) -> term, for a model type if given."""

    def add(f: Callable) -> Callable:
        SYNTAX.setdefault(name, []).append((context, f))
        return f

    return add


def syntax_for(name: str, context: type | None) -> Callable | None:
    """The most special meaning of a call for a model type, along its base classes."""
    own = dict(SYNTAX.get(name, []))
    for base in context.__mro__ if isinstance(context, type) else []:
        if base in own:
            return own[base]
    return own.get(None)


def number(c: Column) -> Column:
    return c.cast("double")


def _outside(what: str) -> Column:
    return F.raise_error(F.lit(what)).cast("double") if _STRICT[-1] else F.lit(None).cast("double")


def _log(name: str, f: Callable[[Column], Column], zero: float = 0.0) -> None:
    def apply(c: Column) -> Column:
        x = number(c)
        return F.when(x > zero, f(x)).when(x == zero, F.lit(-math.inf)).when(x < zero, _outside(f"{name} of a number below {zero:g}"))

    FUNCTIONS[name] = apply


for _n, _f, _z in (("log", F.log, 0.0), ("log2", F.log2, 0.0), ("log10", F.log10, 0.0), ("log1p", F.log1p, -1.0)):
    _log(_n, _f, _z)
for _n in ("exp", "expm1", "cbrt", "sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh"):
    FUNCTIONS[_n] = lambda c, f=getattr(F, _n): f(number(c))
for _n, _g in (("abs", F.abs), ("floor", F.floor), ("ceil", F.ceil), ("sign", F.signum)):
    FUNCTIONS[_n] = lambda c, f=_g: number(f(number(c)))
for _n in ("lower", "upper", "trim", "length", "year", "month", "dayofweek", "hour", "size", "substring", "contains", "startswith", "endswith", "rlike", "datediff", "element_at"):
    FUNCTIONS[_n] = getattr(F, _n)



@formula_function("sqrt")
def _sqrt(c: Column) -> Column:
    x = number(c)
    return F.when(x >= 0, F.sqrt(x)).when(x < 0, _outside("sqrt of a negative number"))


@formula_function("round")
def _round(c: Column, *digits: Column) -> Column:
    return F.call_function("bround", number(c), *digits)  # ties go to even


@formula_function("+")
def _plus(*c: Column) -> Column:
    out = number(c[0])
    for x in c[1:]:
        out = out + number(x)
    return out


@formula_function("-")
def _minus(a: Column, b: Column | None = None) -> Column:
    return -number(a) if b is None else number(a) - number(b)


@formula_function("*")
def _times(*c: Column) -> Column:
    out = number(c[0])
    for x in c[1:]:
        out = out * number(x)
    return out


@formula_function("/")
def _over(a: Column, b: Column) -> Column:
    x, y = number(a), number(b)
    at_zero = F.when(x > 0, F.lit(math.inf)).when(x < 0, F.lit(-math.inf)).when(x.isNotNull(), F.lit(math.nan))
    return F.when(y != 0, F.try_divide(x, y)).when(y == 0, at_zero)


@formula_function("%")
def _rest(a: Column, b: Column) -> Column:
    x, y = number(a), number(b)
    return F.when(y != 0, F.try_mod(x, y)).when(y.isNotNull() & x.isNotNull(), F.lit(math.nan))


@formula_function("÷")
def _whole(a: Column, b: Column) -> Column:
    q = _over(a, b)
    return F.when(q >= 0, number(F.floor(q))).otherwise(number(F.ceil(q)))


FUNCTIONS["^"] = lambda a, b: F.pow(number(a), number(b))
FUNCTIONS["|"] = lambda a, b: a.bitwiseOR(b)
FUNCTIONS["&"] = lambda a, b: a.bitwiseAND(b)
FUNCTIONS["!"] = lambda a: ~a
FUNCTIONS["=="] = lambda a, b: a == b
FUNCTIONS["!="] = lambda a, b: a != b
FUNCTIONS["<"] = lambda a, b: a < b
FUNCTIONS["<="] = lambda a, b: a <= b
FUNCTIONS[">"] = lambda a, b: a > b
FUNCTIONS[">="] = lambda a, b: a >= b
FUNCTIONS["get_json_object"] = lambda c, path: F.call_function("get_json_object", c, path)
FUNCTIONS["ifelse"] = lambda c, a, b: F.when(c, a).otherwise(b)


@formula_function("gt_e")
def _gt_e(c: Column) -> Column:
    """Whether any letter comes after e."""
    return F.exists(F.split(c, ""), lambda x: x > "e")
