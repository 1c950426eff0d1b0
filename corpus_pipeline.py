"""A training-corpus pipeline over the table documents: five stages, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siskin.llm import blocks, jaccard, langid, lines, packing, pii

#: Name and function of each stage; a function takes (spark, docs, sf_dir).
STAGES = [
    ("language_id", langid.stage),
    ("line_dedup", lines.stage),
    ("near_duplicates", jaccard.stage),
    ("pii", pii.stage),
    ("packing", packing.stage),
]

#: Language models, trees and tokens are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages keep."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = blocks.written(stage(spark, docs, sf_dir), spark)
        blocks.tidy(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
