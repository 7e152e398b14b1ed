"""Corpus cleaning: quality, exact copies, near copies, benchmark passages, tokens.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its rows are written as
Parquet to the shared folder and read again as the next stage's ``docs``; a
stage's table is deleted once its successor's is written.

Cases: every stage judges rows by their text, so null and repeated doc_ids are
treated like others; null text counts as empty; of equal and of near-equal rows
exactly one stays; further columns go through to the last stage; an empty
``documents``, ``labels`` or ``benchmark`` gives a defined result (nothing, no
rejection, no passage).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ionweave.llm import bpe, decontaminate, exact_dedup, quality, simhash_dedup
from ionweave.llm.common import discard, read_table, shared_path


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays."""
    return simhash_dedup.near_dedup(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of the text they decode to."""
    return bpe.tokenised(docs)


STAGES = [("quality", good), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", clean), ("byte_bpe", tokens)]

#: The classifier of the first stage is fitted iteratively, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        done = stage(spark, docs, sf_dir)
        done.write.parquet(path)
        docs = spark.read.schema(done.schema).parquet(path)
        if before:
            discard(spark, before)
        before = path
    return docs
