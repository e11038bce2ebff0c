"""The corpus pipeline: quality rules, exact dedup, near dedup, source mixing and packing of the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents; the last returns a row for each packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecscore.llm import exact_dedup, mixing, near_dedup, packing, quality
from vecscore.llm.common import drop_written, free_heap, written
from vecscore.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.quality_stage(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup.exact_dedup_stage(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, a similarity of 0.8 or more."""
    return near_dedup.near_dedup_stage(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, those of rare sources more than once."""
    return mixing.mix_stage(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences. The work is the Python workers', so the heap that the stages before have grown goes first."""
    free_heap(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact), ("near_dedup", near), ("mix_sources", mix), ("pack", pack)]
#: SQL can't express tokenization and packing; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            drop_written(docs)
        docs = out
    return docs
