"""Global order without one-partition windows: ordinals, running sums, exact cuts; and greedy filling of splits."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fitscape.operators.checkpoints import with_checkpoints

def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows in ranges of the whole order, one a task, with _bucket (the range's number) and _at (ascending along the whole order).

    Ranges are cut on all order columns, so neither equal first columns nor a common prefix gathers rows in one task, and
    there are as many as the session has shuffle partitions. They are stored once, as two runs needn't cut alike.
    """
    with_checkpoints(df.sparkSession)
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    return rows.withColumn("_bucket", F.shiftright("_at", 33))


def _same(left: str, right: str, columns: list[str]) -> Column:
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return cond


def _carried(rows: DataFrame, value: Column, by: list[str], name: str, last: bool = False) -> DataFrame:
    """Adds what earlier ranges pass on to a row's group: the sum of value, or its last one; null for a group's first range.

    Groups that reach over k ranges have k - 1 rows in the broadcast table: fewer rows than ranges, whatever the number of groups.
    """
    of = rows.groupBy(*by, "_bucket").agg((F.max_by(F.struct(value.alias("v")), "_at") if last else F.sum(value)).alias("_s"))
    earlier = Window.partitionBy(*by).orderBy("_bucket")
    before = F.lag("_s").over(earlier) if last else F.sum("_s").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    of = of.withColumn(name, before).filter(F.col(name).isNotNull())
    return rows.alias("l").join(F.broadcast(of).alias("r"), _same("l", "r", [*by, "_bucket"]), "left").select("l.*", f"r.{name}")


def _in_bucket(by: list[str]) -> WindowSpec:
    return Window.partitionBy("_bucket", *by).orderBy("_at")


def running_sum(df: DataFrame, value: Column | str, order: list[str], by: list[str] | None = None, name: str = "running") -> DataFrame:
    """Sum of `value` over the rows up to each one in `order` (a total order, nulls first), within `by`; null while all values are null. Each range of rows is summed by itself; sums of earlier ranges are joined in."""
    by = by or []
    rows = _ranged(df.withColumn("_v", F.col(value) if isinstance(value, str) else value), [*by, *order])
    return _summed(rows, F.col("_v"), by, name).select(*df.columns, name)


def _summed(rows: DataFrame, value: Column, by: list[str], name: str) -> DataFrame:
    # ranges stay apart: windows by them need no other shuffle
    own = _carried(rows, value, by, "_carried").repartitionByRange("_bucket").withColumn("_own", F.sum(value).over(_in_bucket(by).rowsBetween(Window.unboundedPreceding, 0)))
    return own.withColumn(name, F.coalesce(F.col("_own") + F.col("_carried"), "_own", "_carried")).drop("_own", "_carried")


def with_ordinal(df: DataFrame, order: list[str], by: list[str] | None = None, name: str = "ordinal") -> DataFrame:
    """Adds the row's number from 1 in `order`, within `by`."""
    if by:
        out = running_sum(df, F.lit(1), order, by, name)
        return out.withColumn(name, F.col(name).cast("long"))
    rows = _carried(_ranged(df, order), F.lit(1), [], "_carried")
    return rows.select(*df.columns, (F.coalesce("_carried", F.lit(0)) + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).alias(name))


def run_number(df: DataFrame, value: str, order: list[str], by: list[str], name: str) -> DataFrame:
    """Adds the number, from 0, of the run of equal consecutive values within `by`: a value that comes again later begins a new run. A range's first row meets the last value of the range before."""
    rows = _carried(_ranged(df, [*by, *order]), F.col(value), by, "_last", last=True).repartitionByRange("_bucket")
    own = F.struct(F.col(value).alias("v"))
    before = F.coalesce(F.lag(own).over(_in_bucket(by)), "_last")
    rows = rows.withColumn("_new", F.when(before.eqNullSafe(own), 0).otherwise(1)).drop("_last")
    return _summed(rows, F.col("_new"), by, name).select(*df.columns, (F.col(name) - 1).cast("long").alias(name))


def shuffled(df: DataFrame, key: str, seed: int, name: str = "_shuffle") -> DataFrame:
    """Adds md5 of seed:key, the order of every seeded shuffle here."""
    return df.withColumn(name, F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))


def exact_cut(df: DataFrame, key: str, train: float = 0.8, val: float = 0.1, seed: int = 1012) -> DataFrame:
    """Adds split: of the rows in shuffled order the first int(train * n), the next up to int((train + val) * n), and the rest. `key` is unique."""
    n = df.count()
    rows = with_ordinal(shuffled(df, key, seed), ["_shuffle", key], name="_n")
    cut = F.when(F.col("_n") <= int(train * n), "train").when(F.col("_n") <= int((train + val) * n), "val").otherwise("test")
    return rows.withColumn("split", cut).drop("_n", "_shuffle")


def greedy_fill(groups: DataFrame, size: str, order: list[tuple[str, bool]], fractions: tuple[float, float, float], by: list[str], total: str | None = None) -> DataFrame:
    """Adds split to a table of groups: each, in order, goes to the split with the least filled share; ties to train, then val; a share of 0 is never filled.

    order: (column, ascending). One small table of (group, size) for each `by` goes to one task: about 40 bytes a group,
    meant for up to some 10 million groups.
    """
    names, shares = ("train", "val", "test"), list(fractions)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([c for c, _ in order], ascending=[a for _, a in order], kind="stable")
        goal = pdf[size].sum() if total is None else pdf[total].iloc[0]
        filled, out = [0.0, 0.0, 0.0], []
        for n in pdf[size].tolist():
            best = min(range(3), key=lambda k: filled[k] / (shares[k] * goal) if shares[k] * goal > 0 else float("inf"))
            filled[best] += n
            out.append(names[best])
        return pdf.assign(split=out)

    return groups.groupBy(*by).applyInPandas(fill, ", ".join(f"{n} {t}" for n, t in groups.dtypes) + ", split string")
