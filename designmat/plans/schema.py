"""Schemas: what is known of each variable before a formula is bound."""

from __future__ import annotations

import math
from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from designmat.errors import EmptyColumnError, LevelError, check_columns
from designmat.functions.registry import SYNTAX, TERM_LEVEL
from designmat.plans.contrasts import Contrast, ContrastsMatrix, Dummy, code
from designmat.plans.terms import Call, Categorical, Continuous, Formula, Interaction, Shift, Sum, TermBase, Var, parts, unique

NUMERIC = (T.NumericType, T.BooleanType)
NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType, T.DayTimeIntervalType, T.YearMonthIntervalType)
MAX_LEVELS = 10_000


class Schema(dict):
    """Variable names to bound terms."""

    def __init__(self, items: Any = ()):
        items = items.items() if isinstance(items, dict) else items
        super().__init__((k.name if isinstance(k, Var) else k, v) for k, v in items)

    def merge(self, other: Any) -> Schema:
        return Schema({**self, **Schema(other)})


def check_table(df: Any) -> None:
    if not isinstance(df, DataFrame):
        raise TypeError(f"a Spark DataFrame is needed, not {type(df).__name__}")


def needed(t: Any) -> list[str]:
    """Variables whose statistics binding asks for: those not only inside protected calls."""
    if isinstance(t, Formula):
        return unique(v for p in (() if t.lhs is None else (t.lhs,)) + parts(t.rhs) for v in needed(p))
    if isinstance(t, Var):
        return [t.name]
    if isinstance(t, Sum | Interaction):
        return unique(v for x in t.terms for v in needed(x))
    if isinstance(t, Shift):
        return needed(t.term)
    if isinstance(t, Call):
        if t.fn in SYNTAX or t.fn in TERM_LEVEL or t.fn == "unprotect":
            return t.vars()
        return unique(v for a in t.args for v in (needed(a) if isinstance(a, Call) else []))
    return []


def schema(df: DataFrame, target: Any = None, hints: dict[str, Any] | None = None, max_levels: int = MAX_LEVELS) -> Schema:
    """Statistics of continuous variables and levels of categorical ones, for a formula's or a list's variables or
    for all columns.

    Numbers and booleans are continuous, all else is categorical; hints override that: "continuous",
    "categorical", a contrast coding, or a bound term. One sweep gives the statistics; levels take a second one,
    made only when the first has shown that they are at most ``max_levels``.
    """
    check_table(df)
    if df.isStreaming:
        raise TypeError("a stream can't be swept for its schema; give a Schema made by hand or from stored data")
    hints = {(k.name if isinstance(k, Var) else k): v for k, v in (hints or {}).items()}
    names = df.columns if target is None else needed(target) if isinstance(target, TermBase) else [x.name if isinstance(x, Var) else x for x in target]
    check_columns(names, df.columns)
    out, plans = {}, {}
    for n in names:
        hint, kind = hints.get(n), df.schema[n].dataType
        if isinstance(hint, type) and issubclass(hint, Contrast):
            raise TypeError(f"{hint.__name__} is a class; an instance is needed: {hint.__name__}()")
        if isinstance(hint, Continuous | Categorical):
            out[n] = hint
        elif hint in ("continuous", Continuous) or hint is None and isinstance(kind, NUMERIC):
            plans[n] = None
        elif isinstance(kind, NESTED):
            raise TypeError(f"column '{n}' of type {kind.simpleString()} can't be a variable")
        else:
            plans[n] = hint if isinstance(hint, Contrast | ContrastsMatrix) else Dummy()
    if plans:
        out |= _sweep(df, plans, max_levels)
    elif isinstance(target, TermBase) and target.vars():  # variables within calls aren't swept, but must have rows
        check_columns(target.vars(), df.columns)
        if df.isEmpty():
            raise EmptyColumnError(f"Column '{target.vars()[0]}' is empty.")
    return Schema((n, out[n]) for n in names)


def _quoted(n: str):
    return F.col(f"`{n.replace('`', '``')}`")


def _sweep(df: DataFrame, plans: dict[str, Any], max_levels: int) -> dict[str, TermBase]:
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, (n, coding) in enumerate(plans.items()):
        c = _quoted(n)
        if coding is None:
            x = c.cast("double")
            aggs += [F.avg(x).alias(f"m{i}"), F.var_samp(x).alias(f"v{i}"), F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}"), F.max(F.isnan(x)).alias(f"q{i}")]
        else:
            aggs.append(F.approx_count_distinct(c, 0.02).alias(f"d{i}"))
    row = df.agg(*aggs).first()
    if not row["n"]:
        raise EmptyColumnError(f"Column '{next(iter(plans))}' is empty.")
    out, sets = {}, []
    for i, (n, coding) in enumerate(plans.items()):
        if coding is None:
            stats = [math.nan if row[f"{k}{i}"] is None or row[f"q{i}"] else float(row[f"{k}{i}"]) for k in "mvlh"]
            out[n] = Continuous(n, *stats)
        elif row[f"d{i}"] > 1.1 * max_levels:
            raise LevelError(f"column '{n}' has about {row[f'd{i}']} levels; more than {max_levels} aren't coded (max_levels)")
        else:
            sets.append(F.collect_set(_quoted(n)).alias(f"s{i}"))
    if sets:
        row = df.agg(*sets).first()
        for i, (n, coding) in enumerate(plans.items()):
            if coding is not None:
                levels = ordered(row[f"s{i}"], df, n, coding)
                out[n] = Categorical(n, coding.check(levels) if isinstance(coding, ContrastsMatrix) else code(coding, levels))
    return out


def ordered(found: Iterable, df: DataFrame, name: str, coding: Any) -> list:
    """Levels in the order of the column's nominal attribute if it has one, else sorted (strings by bytes)."""
    known = df.schema[name].metadata.get("ml_attr", {}).get("vals") or []
    rank = {v: i for i, v in enumerate(known)}
    return sorted(found, key=lambda x: (rank.get(x, len(rank)), x.encode() if isinstance(x, str) else x))
