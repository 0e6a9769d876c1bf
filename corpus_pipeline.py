"""Corpus pipeline: quality rules, near-duplicates, personal data, packing.

Each stage is written as Parquet in the shared folder and read again by the
next, so a lost executor never costs more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docparity.llm.common import new_folder
from docparity.llm.minhash import near_duplicates_dropped
from docparity.llm.packing import pack
from docparity.llm.pii import redact
from docparity.llm.quality import quality_filter


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule; null, empty and blank texts go. Rows without ``doc_id`` and repeated rows are judged one by one."""
    return quality_filter(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least ``doc_id``, rows without one last.

    Null and blank texts are in no group and stay. Rows repeated with ``doc_id`` and text stay or go together.
    """
    return near_duplicates_dropped(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, identifiers in their texts replaced by the kind in brackets; null and empty texts stay as they are."""
    return redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all documents in sequences of 8,192 characters: ``doc_id, piece, start, length, bin_id, bin_offset, fixed``.

    A null or empty text is one row without a place. Repeated rows, and rows without ``doc_id``, get a place each.
    """
    return pack(docs)


STAGES = [("quality rules", quality_stage), ("near-duplicates", dedup_stage), ("personal data", pii_stage), ("packing", packing_stage)]

#: Personal data and packing have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        folder = new_folder(spark, f"pipeline-stage{i}")
        out.write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
