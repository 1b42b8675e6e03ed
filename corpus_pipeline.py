"""The training-data pipeline: five stages from ``documents`` to packed token sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. ``run`` writes
every stage's result as Parquet in the shared folder and hands the reread table on; a result is
deleted once the next one is written. Null ids and texts, repeated rows, empty tables and extra
columns pass through as each operator's docstring says; extra columns stay until packing.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import bagminhash, common, decontam, packing, pii, quality

OWNER = "pipeline"


def _stage(f: Callable) -> Callable:
    """A stage first deletes what the one before it staged, whose result is written by then; other queries' tables stay."""

    @functools.wraps(f)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.release(spark, OWNER)
        with common.owner(OWNER):
            return f(spark, docs, sf_dir)

    return begun


@_stage
def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the ordinal classifier gives the highest grade to with at least even odds."""
    return quality.select_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return bagminhash.one_of_each(docs)


@_stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked."""
    return pii.masked_documents(docs)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces and their places in sequences of 2048."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", select_quality),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("packing", pack_sequences),
]

#: The classifier and the signatures are not SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{common.shared_dir(spark)}/tidelog-pipeline/{common.run_name()}"
    before = None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            common.delete(spark, before)
        before = path
    common.release(spark, OWNER)
    return docs
