"""From raw documents to a weighted training mix, in five stages.

Each stage reads what its predecessor kept, judges all of it, and (but for the last) returns the
kept rows with the columns of ``documents``.  ``run`` writes every stage's rows as Parquet to the
shared folder and reads them back, so that a lost executor costs a re-read and nothing else.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkloom.llm import decontaminate, exact_dedup, mixing, near_copies, quality
from linkloom.runtime import materialize


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps; the models are fitted on ``docs`` and the labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.resample(docs, labels).select(docs.columns)


def keep_first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id."""
    return exact_dedup.keep_first(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by a five-word Jaccard of 0.8 or more the document with the smallest id."""
    return near_copies.keep_one(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a test item."""
    return decontaminate.drop_leaked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document's words, and to which shards they go."""
    return mixing.mix(docs)


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", keep_first_copies),
    ("near_dedup", keep_one_of_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("mixing", mix_sources),
]

#: Hash models, fingerprint links and seeded draws have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for ``documents`` in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
