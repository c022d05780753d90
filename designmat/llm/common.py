"""Shared helpers of the training-data operators: table reading, lineage cuts, connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_OWN: dict[str, str] = {}  # temporary folders of sessions on one machine
SALTS = 64
FEW_LINKS = 1_000_000
CROWDED = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark only (any store Spark can open)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """A column by its whole name, whatever signs are in it."""
    return F.col(f"`{column.replace('`', '``')}`")


def free(names: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with as many underscores before it as it takes to be none of the names, case ignored."""
    taken = {n.lower() for n in names}
    out = []
    for w in wanted:
        while w.lower() in taken:
            w = "_" + w
        out.append(w)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where it is unset a session on one machine gets a new temporary folder, removed at its end, with a warning;
    on several machines that is an error, as no local folder is shared among them.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not found:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        if context.applicationId not in _OWN:
            _OWN[context.applicationId] = tempfile.mkdtemp(prefix="designmat-")
            atexit.register(shutil.rmtree, _OWN[context.applicationId], ignore_errors=True)
            warnings.warn("spark.checkpoint.dir is unset: intermediate results go to a temporary folder of this machine", stacklevel=2)
        found = _OWN[context.applicationId]
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(found)
    return found


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate results, in whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, so that every machine opens it in the same store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def cut(df: DataFrame) -> DataFrame:
    """Compute once and keep in the shared folder, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars (node, smallest node) of the links a[i]-b[i] seen by one task."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    off = label != np.arange(len(nodes))
    return nodes[off], nodes[label[off]]


def _parents(e: DataFrame, node: str, links: int) -> DataFrame:
    """e(u, v) with m, the least v of the links of its ``node`` (null where it has none).

    A node with over a hundred-thousandth of the links (a thousand at least) has its rows dealt to many tasks, so
    there are at most 100,000 such nodes, which is the bound of what is broadcast here.
    """
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    crowded = max(CROWDED, links // 100_000)
    hot = F.broadcast(e.groupBy(node).agg(F.count("*").alias("n")).where(F.col("n") > crowded).select(F.col(node).alias("h")))
    other = "u" if node == "v" else "v"
    dealt = e.join(hot, F.col(node) == F.col("h"), "left").withColumn("salt", F.when(F.col("h").isNull(), 0).otherwise(F.pmod(F.xxhash64(other), F.lit(SALTS))).cast("int")).drop("h")
    low = low.withColumnRenamed("u", "w").join(hot, F.col("w") == F.col("h"), "left")
    low = low.withColumn("k", F.explode(F.when(F.col("h").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1))))).drop("h")
    return dealt.join(low, (F.col(node) == F.col("w")) & (F.col("salt") == F.col("k")), "left").select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges(a, b), the component being its smallest node.

    Alternating large and small stars. Links are kept from the larger node u to the smaller v. In a large star a
    node's larger neighbours are linked to the least of its neighbours, in a small star its smaller neighbours are.
    Each round is aggregations, whose partial minima are combined before the shuffle, and equi-joins, in which the
    rows of a node with very many links are dealt to many tasks. What is left once no more than a million links are,
    16 MB, is joined by one task. Nodes without links are not returned; self-links and nulls are ignored; an empty
    input gives an empty result.
    """

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if held:
            u, v = forest(*(np.concatenate([b[k].to_numpy() for b in held]) for k in "uv"))
            yield pd.DataFrame({"u": u, "v": v})

    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen, links = None, e.count()
    while links:
        if links <= FEW_LINKS:
            e = cut(e.repartition(1).mapInPandas(rest, "u long, v long"))
            break
        large = cut(_parents(e, "v", links).select("u", F.coalesce("m", "v").alias("v")).distinct())
        small = _parents(large, "u", links).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(large.groupBy("u").agg(F.min("v").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38,0)))")).first()
        if now == seen:
            break
        seen, links = now, now[0]
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of a partition that is sorted by its keys, one at a time."""
    kept: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        k = b[keys].to_numpy()
        if kept and (kept[-1][keys].iloc[-1].to_numpy() != k[0]).any():
            yield pd.concat(kept) if len(kept) > 1 else kept[0]
            kept = []
        at = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        bounds = [0, *at.tolist(), len(b)]
        for lo, hi in zip(bounds[:-2], bounds[1:-1], strict=True):
            kept.append(b.iloc[lo:hi])
            yield pd.concat(kept) if len(kept) > 1 else kept[0]
            kept = []
        kept.append(b.iloc[bounds[-2] :])
    if kept:
        yield pd.concat(kept) if len(kept) > 1 else kept[0]


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """The rows of a partition that is sorted by its keys, many groups at a time and each of them whole, with the
    places where groups begin."""
    kept: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        k = b[keys].to_numpy()
        at = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        if kept and (kept[-1][keys].iloc[-1].to_numpy() != k[0]).any():
            at = np.concatenate([[0], at])
        if not len(at):
            kept.append(b)
            continue
        out = pd.concat([*kept, b.iloc[: at[-1]]], ignore_index=True)
        kept = [b.iloc[at[-1] :]]
        k = out[keys].to_numpy()
        yield out, np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1])
    if kept:
        yield pd.concat(kept, ignore_index=True), np.zeros(1, np.int64)


def together(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a key in one partition and next to each other, for runs()."""
    return df.repartition(*keys).sortWithinPartitions(*keys)
