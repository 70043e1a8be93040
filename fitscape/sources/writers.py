"""Sinks, and tables that are computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Overwrites; CSV has a header, JSON (of summaries) a line a row; partitioned by the given keys (assay, family)."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def cached_table(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet table at path; built and written first if it isn't there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or "") and "UNABLE_TO_INFER_SCHEMA" not in (e.getCondition() or ""):
            raise
    build().write.mode("errorifexists").parquet(path)
    return spark.read.parquet(path)
