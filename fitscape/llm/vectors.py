"""Vectors as exact integers: kept rows, floor means, totals joined back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integers stay below this, so that squared distances of 64 components fit 64 bits.
LARGEST = 1 << 27


def integer_vectors(df: DataFrame, scale: int, *, id_col: str, vector_col: str, extra: dict[str, str] | None = None) -> DataFrame:
    """vec_id, v (floor(scale * x) of each component) and the extra columns, given as {new name: column}.

    Rows whose vector is null, or holds a null, a NaN or an infinity, go. A component of 2 ** 27 / scale or more raises an error, as
    distances of such vectors needn't fit a long.
    """
    whole = lambda x: F.when(F.abs(x) < LARGEST, x.cast("int")).otherwise(F.raise_error(F.lit("component too large for exact distances")).cast("int"))
    # renamed before anything else, so that a table's other columns can't clash
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"), *[F.col(c).alias(n) for n, c in (extra or {}).items()])
    fine = F.col("x").isNotNull() & F.forall("x", lambda x: F.coalesce(x - x == 0, F.lit(False)))
    return rows.filter(fine).withColumn("v", F.transform("x", lambda x: whole(F.floor(x * scale)))).drop("x")


def matrix(batch: pa.RecordBatch, column: str = "v") -> np.ndarray:
    """A batch's arrays of one length, a row each."""
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)


def member_sums(rows: DataFrame, group_of: Callable[[pa.RecordBatch, np.ndarray], np.ndarray], groups: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(n, sums) of the integer vectors in each group. group_of gives a batch's parts as (group, vector) rows.

    Each task sends one row a group, and these are summed by Spark: what reaches the driver is one row a group.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(groups, np.int64), np.zeros((groups, width), np.int64)
        for batch in batches:
            if batch.num_rows:
                group, parts = group_of(batch, matrix(batch))
                n += np.bincount(group, minlength=groups)
                np.add.at(total, group, parts)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), *(pa.array(total[used, j]) for j in range(width))], ["g", "n", *(f"s{j}" for j in range(width))])

    names = ["n", *(f"s{j}" for j in range(width))]
    partial = rows.mapInArrow(add, "g long, " + ", ".join(f"{x} long" for x in names))
    n, total = np.zeros(groups, np.int64), np.zeros((groups, width), np.int64)
    for r in partial.groupBy("g").agg(*[F.sum(x).alias(x) for x in names]).collect():  # a row a group at most
        n[r["g"]], total[r["g"]] = r["n"], r[2:]
    return n, total


def floor_means(old: np.ndarray, n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / n); a group without members keeps its old entry."""
    return np.where(n[:, None] > 0, total // np.maximum(n, 1)[:, None], old)


def with_total(rows: DataFrame, key: str, value: str, name: str, *, share: int = 1000) -> DataFrame:
    """Adds the sum of value over the rows of an equal key (nulls are equal). rows: a stored table, as it is read three times.

    Keys with at least one row in `share` are at most `share`, and their totals are broadcast; all other keys are too
    small to fill a task, and their rows are joined by shuffle.
    """
    totals = rows.groupBy(F.col(key).alias("_k")).agg(F.sum(value).alias(name), F.count("*").alias("_n"))
    least = rows.count() / share
    hot, rest = F.broadcast(totals.filter(F.col("_n") >= least)), totals.filter(F.col("_n") < least)
    same: Column = F.col(key).eqNullSafe(F.col("_k"))
    columns = [*rows.columns, name]
    return rows.join(hot, same).select(columns).unionByName(rows.join(hot, same, "left_anti").join(rest, same).select(columns))
