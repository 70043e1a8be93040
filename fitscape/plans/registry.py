"""All registered queries and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fitscape.plans import core_queries, model_queries, source_queries

QUERIES = {**core_queries.QUERIES, **model_queries.QUERIES, **source_queries.QUERIES}
ORACLES = {**core_queries.ORACLES, **model_queries.ORACLES, **source_queries.ORACLES}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["conservation_report"](spark, sf_dir)
