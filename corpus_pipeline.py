"""The corpus pipeline: quality rules, n-gram Jaccard join, personal data, mixing of sources, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.jaccard import one_of_each
from plumbline.llm.mixing import mixed_documents
from plumbline.llm.packing import packed_documents
from plumbline.llm.pii import redact_documents
from plumbline.llm.quality import keep_quality
from plumbline.llm.shared import materialize, small_batches

#: Words whose ids a worker keeps for packing. Workers outlive the stage, so this memory is missing in the stages of a following run.
REMEMBERED = 340_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    small_batches(spark)
    return keep_quality(docs)


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, five-word shingles at a similarity of 0.8, the document with the least doc_id."""
    small_batches(spark)
    return one_of_each(docs, size=5, percent=80)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    small_batches(spark)
    return redact_documents(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, in the order of the Pfair schedule; files hold consecutive slots, so each is a mixture by the target weights."""
    small_batches(spark)
    return mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences; a partition's sequences come from its part of the mixture."""
    small_batches(spark)
    return packed_documents(docs, remembered=REMEMBERED)


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram jaccard join", duplicates_stage),
    ("personal data", personal_data_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the robust estimates, the boosted trees and the packing; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage{k}")
    return docs
