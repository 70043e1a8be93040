"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, a temporary one is set on a single machine (tests), and a cluster must name one."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    return Scratch(df.sparkSession).stored(df, name)


def delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables of stored() that nothing reads any more."""
    for df in tables:
        for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
            delete(df.sparkSession, folder)


class Scratch:
    """Tables of one computation in the shared folder; clear() deletes them once all that is made of them is stored elsewhere."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        # shuffle files of earlier plans go when the driver collects its garbage
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self, *names: str) -> None:
        """Of the given names, or all."""
        for name in names or list(self.paths):
            for path in self.paths.pop(name, []):
                delete(self.spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut Arrow batches into slices whose texts sum to about `limit` bytes; yields each with its texts as bytes (null: empty)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, before + limit, side="right")))
            part = batch.slice(start, stop - start)
            yield part, [x or b"" for x in part.column(column).cast(pa.binary()).to_pylist()]
            start = stop


def with_match(rows: DataFrame, key: Column, lookup: DataFrame, name: str, spread: Column, *, share: int = 1000) -> DataFrame:
    """rows with `name`, taken from the row of lookup (columns _key, of which each is one row, and name) whose _key equals key; null if there is none.

    Keys with at least one row in `share` are at most `share`: what they find is broadcast. All other keys are too small
    to fill a task and are joined by shuffle; rows that are done by then, or have no key, are dealt by `spread` (a string).
    """
    rows = rows.withColumn("_k", key)
    counts = rows.filter("_k is not null").groupBy(F.col("_k").alias("_key")).agg(F.count("*").alias("_n"))
    hot = lookup.join(counts.filter(F.col("_n") >= rows.count() / share), "_key", "left_semi")
    done = rows.join(F.broadcast(hot.select(F.col("_key").alias("_k"), F.struct(name).alias("_hot"))), "_k", "left")
    done = done.withColumn("_key", F.when(F.col("_hot").isNull(), F.col("_k")).otherwise(None)).withColumn("_key", F.coalesce("_key", F.concat(F.lit("-"), spread)))
    out = done.join(lookup.select("_key", F.struct(name).alias("_cold")), "_key", "left")
    return out.withColumn(name, F.coalesce("_hot", "_cold")[name]).drop("_k", "_key", "_hot", "_cold")


def most_frequent(counts: DataFrame, n: str, limit: int) -> DataFrame:
    """The rows of the greatest counts n (at least 1): at most `limit`, cut at a bound of the count (in steps of 2 ** (1 / 32)), so that no task or driver sorts them."""
    step = F.floor(F.log2(n) * 32).cast("int")
    sizes = sorted(((x["k"], x["m"]) for x in counts.groupBy(step.alias("k")).agg(F.count("*").alias("m")).collect()), reverse=True)  # at most 2,048 rows
    total, least = 0, 1 << 30
    for k, m in sizes:
        total += m
        if total > limit:
            break
        least = k
    return counts.filter(step >= least)
