"""A cleaning pipeline over `documents`: every stage works on all that the stage before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hindcast.llm import decontamination, line_quality, near_dedup, packing, personal_data, queries
from hindcast.llm.text import read_table
from hindcast.sources.sinks import through_storage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return line_quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the one with the smallest id."""
    return near_dedup.keep_first(docs, words=5, similar=0.8)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    return personal_data.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left becomes token sequences."""
    return packing.pack(docs, queries.word_bpe(), capacity=2048, end_id=0)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("personal data", redaction),
    ("packing", packed),
]

#: SQL has no fitted labelling, weighted sampling, tiling or tokenizer; a test compares run() with brute-force stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in a row over `documents`; what a stage returns is written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = through_storage(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
