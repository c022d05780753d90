"""Tables in, matrices out: wide columns, one vector column, or non-zero entries in long form."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Wider projections leave whole-stage code generation; the vector and long forms don't.
WIDE = 100


def read(spark: SparkSession, source: str, format: str = "parquet", **options: Any) -> DataFrame:
    """Any source that Spark reads: parquet, csv, json, orc, text, jdbc, or "table" for a catalogue name."""
    return spark.table(source) if format == "table" else spark.read.format(format).options(**options).load(source)


def from_rows(spark: SparkSession, data: Any) -> DataFrame:
    """A table of a dict of columns, a list of dicts, or a pandas frame."""
    if isinstance(data, dict):
        names = list(data)
        return spark.createDataFrame(list(zip(*data.values(), strict=True)), names)
    return spark.createDataFrame(data)


def wide(df: DataFrame, cols: list[tuple[str, Column]], keep: Iterable[str] = ()) -> DataFrame:
    """A column of doubles for each matrix column, after the kept columns."""
    return df.select(*keep, *[c.alias(n) for n, c in cols])


def vector(df: DataFrame, cols: list[tuple[str, Column]], keep: Iterable[str] = (), name: str = "features", sparse: bool = False) -> DataFrame:
    """One vector column, with the names of its entries as metadata; sparse stores the non-zero entries only."""
    from pyspark.ml.functions import array_to_vector

    attrs = {"ml_attr": {"attrs": {"numeric": [{"idx": i, "name": n} for i, (n, _) in enumerate(cols)]}, "num_attrs": len(cols)}}
    if not sparse:
        return df.select(*keep, array_to_vector(F.array(*[c for _, c in cols])).alias(name, metadata=attrs))
    from pyspark.ml.feature import VectorAssembler

    own = [f"_{i}" for i in range(len(cols))]
    made = df.select(*keep, *[c.alias(o) for o, (_, c) in zip(own, cols, strict=True)])
    made = VectorAssembler(inputCols=own, outputCol=name, handleInvalid="keep").transform(made).drop(*own)
    return made.withMetadata(name, attrs)


def long(df: DataFrame, entry: Column, keys: Iterable[str]) -> DataFrame:
    """keys, col (from 1), name, value of each entry that isn't zero; nulls stay."""
    kept = F.filter(entry, lambda e: e["value"].isNull() | (e["value"] != 0))
    return df.select(*keys, F.explode(kept).alias("e")).select(*keys, "e.*")
