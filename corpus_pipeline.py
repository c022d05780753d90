"""A corpus pipeline of five stages; each is written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from designmat.llm import bpe, decontam, quality, secrets, simhash
from designmat.llm.common import cut, named, remove, shared_dir, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts are scored like others; repeated rows and rows
    without a doc_id too; columns may have any names; an empty table stays empty."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, stays of each group of near copies. Texts without words are copies of
    each other; of rows with equal doc_id and text one stays; rows without a doc_id stay; columns may have any names."""
    return simhash.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, whole or edited, go, all rows of their doc_id with them. Null and empty
    texts hold none; rows without a doc_id stay; columns may have any names."""
    hits = decontam.contaminated(docs, table(spark, sf_dir, "benchmark"))
    found = cut(hits.select("doc_id").where("doc_id is not null").distinct())
    return docs.join(found, "doc_id", "left_anti").select(*[named(c) for c in docs.columns])


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every row stays, null and empty texts as they are; columns may have any names."""
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text, a row for each row; null texts count as empty."""
    return bpe.digests(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scans", redact_secrets),
    ("BPE encoding", encode),
]

#: No stage but the secret scan can be told in SQL; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder. Each is written among the session's shared folders, and what its
    predecessor wrote is removed once it is there; the last but one stays, as the result is read from it."""
    top = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
        if k:
            remove(spark, f"{top}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
