"""Streams: a bound formula without lag and lead is a projection of single rows, so it runs on a stream as it is."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from designmat.plans.compile import both
from designmat.plans.parser import formula
from designmat.plans.bind import apply_schema, is_bound
from designmat.plans.schema import Schema
from designmat.plans.terms import shifted
from designmat.sources import tables


def stream_matrix(f: Any, stream: DataFrame, schema: Schema | None = None, model: type | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Response and predictors of each row of a stream (or table), for a bound formula or one with a given schema."""
    f = formula(f) if isinstance(f, str) else f
    if not is_bound(f):
        if schema is None:
            raise TypeError("a stream can't be swept for its schema; give one")
        f = apply_schema(f, schema, model)
    if shifted(f):
        raise ValueError("lag and lead need the order of all rows, which a stream has not")
    y, x = both(f)
    return tables.wide(stream, y + x, keep)
