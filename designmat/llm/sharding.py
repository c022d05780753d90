"""Two-pass external shuffle: seeded scatter into memory-sized buckets, then Fisher-Yates within each bucket."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from designmat.llm.common import free, named, runs, shared_dir, table


def two_pass_shuffle(df: DataFrame, size: str, shards: int = 8, seed: int = 17, bucket_bytes: int = 12 << 20, task_bytes: int = 256 << 20, path: str | None = None) -> DataFrame:
    """All columns of df, and shard and slot; row counts of shards differ by one at most, slots run from 0.

    Pass one scatters rows by a seeded hash of their place in the input, so equal rows and null keys spread like
    any others. A task takes in many buckets and sorts its rows by bucket, on disk where it must, so that the
    number of shuffle partitions follows from ``task_bytes`` and not from the size of a bucket. Pass two permutes
    each bucket in memory and writes it to ``path`` (by default a new folder among the session's shared ones).
    Shards are the consecutive parts of the written order; the order depends on the seed, the input files and how
    they are split only. ``size`` is an SQL expression for a row's bytes. Columns of df may have any names and
    values; where they are called shard or slot the new columns have an underscore before their names. An empty
    table gives no rows.
    """
    spark, names = df.sparkSession, df.columns
    total = df.agg(F.sum(F.expr(size))).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    each = max(1, task_bytes // bucket_bytes)  # buckets of a task, while every core of the cluster has one
    each = max(1, min(each, buckets // spark.sparkContext.defaultParallelism))
    tasks = -(-buckets // each)
    row = F.struct(*[named(c) for c in names]).alias("row")
    scattered = df.select(row, F.monotonically_increasing_id().alias("id"))
    scattered = scattered.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(buckets)).cast("long"))

    def permute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in runs(batches, ["bucket"]):
            order = np.arange(len(g))
            np.random.default_rng([seed, int(g["bucket"].iloc[0])]).shuffle(order)  # Fisher-Yates
            for i in range(0, len(g), 2000):
                part = g.iloc[order[i : i + 2000]]
                yield pd.DataFrame({"bucket": part["bucket"].to_numpy(), "pos": np.arange(i, i + len(part)), "row": part["row"]})

    schema = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("row", df.schema)])
    path = path or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    dealt = scattered.withColumn("task", F.expr(f"cast(bucket div {each} as int)")).repartitionById(tasks, "task").drop("task")
    dealt.sortWithinPartitions("bucket", "id").mapInPandas(permute, schema).write.parquet(path)
    written = spark.read.schema(schema).parquet(path)
    # Rows before each bucket: sums of a thousand buckets at a time, then sums of these.
    counts = written.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("part", F.expr("bucket div 1000"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    tops = counts.groupBy("part").agg(F.sum("n").alias("m"))
    tops = tops.withColumn("start", F.coalesce(F.sum("m").over(before.orderBy("part")), F.lit(0))).withColumn("rows", F.sum("m").over(Window.partitionBy()))
    inner = F.coalesce(F.sum("n").over(before.partitionBy("part").orderBy("bucket")), F.lit(0))
    offsets = counts.withColumn("inner", inner).join(tops, "part").select(F.col("bucket").alias("b"), (F.col("start") + F.col("inner")).alias("first"), "rows")
    if buckets <= 100_000:  # 24 bytes a bucket
        offsets = F.broadcast(offsets)
    at, least, rest = F.col("first") + F.col("pos"), F.expr(f"rows div {shards}"), F.expr(f"rows % {shards}")
    placed = written.join(offsets, F.col("bucket") == F.col("b")).select("row", at.alias("at"), least.alias("least"), rest.alias("rest"))
    early = F.expr("at < rest * (least + 1)")
    shard = F.when(early, F.expr("at div (least + 1)")).otherwise(F.expr("rest + (at - rest * (least + 1)) div greatest(least, 1)"))
    slot = F.when(early, F.expr("at % (least + 1)")).otherwise(F.expr("(at - rest * (least + 1)) % greatest(least, 1)"))
    own = free(names, "shard", "slot")
    return placed.select("row.*", shard.cast("int").alias(own[0]), slot.cast("long").alias(own[1]))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    out = two_pass_shuffle(docs, "coalesce(octet_length(text), 0) + 1")
    return out.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
