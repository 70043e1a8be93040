"""A corpus pipeline: quality rules, near duplicates, repeated passages, benchmark passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fitscape.llm import stages
from fitscape.llm.shared import discard, stored, table

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("ngram_jaccard_join", stages.near_duplicates),
    ("substring_dedup", stages.repeated_passages),
    ("benchmark_decontamination", stages.benchmark_passages),
    ("packing", stages.packing),
]

#: Tokenizer, component search and best-fit packing are beyond SQL; tests/llm/test_pipeline.py has the plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written as Parquet in the shared folder and read again, and deleted once the next one is written."""
    docs = before = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
            if k:
                discard(before)
            before = docs
    return docs
