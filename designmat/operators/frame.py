"""Model frames: missing rows, schema, binding, and the matrices made of them."""

from __future__ import annotations

import warnings
from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from designmat.errors import check_columns
from designmat.plans.bind import StatisticalModel, apply_schema, is_bound
from designmat.plans.compile import Rows, assign, both, columns, entries, ref, rows
from designmat.plans.parser import formula
from designmat.plans.schema import Schema, check_table, schema
from designmat.plans.terms import Formula, Sum, TermBase, members, parts, plus
from designmat.sources import tables


def _formula(f: Any) -> Any:
    return formula(f) if isinstance(f, str) else f


def missing_mask(names: list[str]) -> Column:
    """True for rows where all of these columns have values."""
    return reduce(and_, [ref(n).isNotNull() for n in names], F.lit(True))


def missing_omit(df: DataFrame, f: Any) -> DataFrame:
    """The rows that have values in all variables of a formula. Other columns are pruned when the plan is made."""
    check_table(df)
    names = _formula(f).vars()
    check_columns(names, df.columns)
    return df.where(missing_mask(names))


def modelcols(t: Any, df: DataFrame, order_by: Any = (), partition_by: Any = ()) -> Any:
    """Columns of a bound term as a table; a pair of tables for a formula, a list for a tuple."""
    check_table(df)
    at = rows(order_by, partition_by)
    if isinstance(t, tuple):
        return [modelcols(x, df, order_by, partition_by) for x in t]
    if isinstance(t, Formula):
        y, x = both(t, at)
        return tables.wide(df, y), tables.wide(df, x)
    return tables.wide(df, columns(t, at))


def modelmatrix(f: Any, df: DataFrame, hints: dict | None = None, model: type | None = None, order_by: Any = (), partition_by: Any = (), form: str = "wide", keep: tuple[str, ...] = ()) -> DataFrame:
    """The matrix of a formula's right side or of terms. No row is dropped; no intercept is added and nothing is
    promoted, as the right side alone is bound. ``form`` is wide, vector, sparse or long (keep names the row)."""
    check_table(df)
    f = _formula(f)
    t = f.rhs if isinstance(f, Formula) else f
    if not all(map(is_bound, parts(t))):
        t = apply_schema(t, schema(df, plus(*parts(t)), hints), model)
    return shaped(df, parts(t), rows(order_by, partition_by), form, keep)


def shaped(df: DataFrame, terms: tuple, at: Rows, form: str, keep: tuple[str, ...] = ()) -> DataFrame:
    if form == "long":
        return tables.long(df, entries(Sum(tuple(m for p in terms for m in members(p))), at), keep)
    cols = [c for p in terms for c in columns(p, at)]
    return tables.wide(df, cols, keep) if form == "wide" else tables.vector(df, cols, keep, sparse=form == "sparse")


def response(f: Any, df: DataFrame, hints: dict | None = None, model: type | None = None, order_by: Any = (), partition_by: Any = ()) -> DataFrame:
    """The left side of a formula."""
    check_table(df)
    f = _formula(f)
    if not is_bound(f) or not is_bound(f.lhs):
        f = apply_schema(f, schema(df, f, hints), model)
    return tables.wide(df, columns(f.lhs, rows(order_by, partition_by)))


class ModelFrame:
    """A formula bound to a table: rows with missing values are left out first, then levels and statistics are
    taken, then the formula is bound for a kind of model. The data stay a lazy DataFrame."""

    def __init__(self, f: Any, df: DataFrame, model: type = StatisticalModel, contrasts: dict | None = None, order_by: Any = (), partition_by: Any = ()):
        check_table(df)
        self.written: Formula = _formula(f)
        self.model, self.at = model, rows(order_by, partition_by)
        check_columns(self.written.vars(), df.columns)
        self.data = missing_omit(df, self.written)
        self.schema = schema(self.data, self.written, contrasts)
        self.formula: Formula = apply_schema(self.written, self.schema, model)

    def coefnames(self) -> list[str]:
        return self.formula.names()[1]

    def modelmatrix(self, df: DataFrame | None = None, form: str = "wide", keep: tuple[str, ...] = ()) -> DataFrame:
        return shaped(self.data if df is None else df, parts(self.formula.rhs), self.at, form, keep)

    def response(self, df: DataFrame | None = None) -> DataFrame:
        return tables.wide(self.data if df is None else df, both(self.formula, self.at)[0])

    def assign(self) -> list[int]:
        return assign(self.formula)

    def setcontrasts(self, contrasts: dict | None = None, **more: Any) -> ModelFrame:
        """Code some variables anew; only their levels are read again."""
        new = {**(contrasts or {}), **more}
        unknown = [n for n in new if n not in self.schema]
        if unknown:
            warnings.warn(f"contrasts for variables that the formula hasn't: {', '.join(unknown)}", stacklevel=2)
        known = {n: c for n, c in new.items() if n in self.schema}
        self.schema = self.schema.merge(schema(self.data, list(known), known))
        self.formula = apply_schema(self.written, self.schema, self.model)
        return self


class ModelMatrix:
    """The matrix of a model frame and the term of each of its columns."""

    def __init__(self, frame: ModelFrame, form: str = "wide", keep: tuple[str, ...] = ()):
        self.data, self.assign, self.names = frame.modelmatrix(form=form, keep=keep), frame.assign(), frame.coefnames()


__all__ = ["ModelFrame", "ModelMatrix", "Rows", "Schema", "TermBase", "missing_mask", "missing_omit", "modelcols", "modelmatrix", "response"]
