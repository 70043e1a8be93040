"""Evaluation of prediction tables: correlations, errors, classes, leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitscape.operators.checkpoints import Rounds, with_checkpoints
from fitscape.operators.ordering import running_sum, with_ordinal


def _ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def _clean(c: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(c.cast("double")), c.cast("double"))


def pearson(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """by, n, r over rows with both values; null for a constant column or no rows."""
    d = df.withColumn("_x", _clean(F.col(x))).withColumn("_y", _clean(F.col(y))).filter("_x is not null and _y is not null")
    m = d.groupBy(*by).agg(F.avg("_x").alias("_mx"), F.avg("_y").alias("_my")) if by else d.agg(F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"))
    d = d.join(_small(m), by) if by else d.join(F.broadcast(m), F.lit(True))
    dx, dy = F.col("_x") - F.col("_mx"), F.col("_y") - F.col("_my")
    aggs = [F.count("*").alias("n"), _ratio(F.sum(dx * dy), F.sqrt(F.sum(dx * dx)) * F.sqrt(F.sum(dy * dy))).alias("r")]
    return d.groupBy(*by).agg(*aggs) if by else d.agg(*aggs)


def _small(df: DataFrame, limit: int = 1000) -> DataFrame:
    """df, for a join on its key: broadcast if it has few rows, as a few keys would gather the other side's rows in as many tasks."""
    with_checkpoints(df.sparkSession)
    df = df.checkpoint()
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def average_ranks(df: DataFrame, column: str, by: list[str], name: str) -> DataFrame:
    """Adds the average rank (from 1) within `by`; ties share it. Distinct values are counted and summed in ranges of (by, value), so no group is one task's."""
    values = df.groupBy(*by, column).agg(F.count("*").alias("_c"))
    upto = running_sum(values, "_c", [column], by, name="_u").select(*[F.col(c).alias(f"_r{k}") for k, c in enumerate([*by, column])], (F.col("_u") - (F.col("_c") - 1) / 2.0).alias(name))
    upto, same = _small(upto), F.lit(True)
    for k, c in enumerate([*by, column]):
        same = same & F.col(c).eqNullSafe(F.col(f"_r{k}"))
    return df.join(upto, same).select(*df.columns, name)


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """by, n, rho: Pearson of average ranks."""
    d = df.withColumn("_vx", _clean(F.col(x))).withColumn("_vy", _clean(F.col(y))).filter("_vx is not null and _vy is not null").select(*by, "_vx", "_vy")
    rounds = Rounds(df.sparkSession)
    d = rounds.stored(d, "values")  # each step reads its rows several times
    d = rounds.stored(average_ranks(d, "_vx", by, "_rx").drop("_vx"), "ranks-x")
    rounds.drop("values")
    d = rounds.stored(average_ranks(d, "_vy", by, "_ry").drop("_vy"), "ranks")
    rounds.drop("ranks-x")
    return pearson(d, "_rx", "_ry", by).withColumnRenamed("r", "rho")


def group_report(predictions: DataFrame, by: list[str]) -> DataFrame:
    """by, n, loss (MSE), baseline_loss (population variance of the target), r, rho, n and rho of singles and doubles (rho if n > 1), balanced (mean of both), flag_rho (Spearman of single and target)."""
    d = predictions.withColumn("flag", F.col("single").cast("double"))
    e = F.col("prediction") - F.col("target")
    out = d.groupBy(*by).agg(F.count("*").alias("n"), F.avg(e * e).alias("loss"), F.var_pop("target").alias("baseline_loss"))
    out = out.join(pearson(d, "prediction", "target", by).drop("n"), by, "left").join(spearman(d, "prediction", "target", by).drop("n"), by, "left")
    parts = spearman(d, "prediction", "target", [*by, "single"])
    for k, name in ((1, "single"), (0, "double")):
        p = parts.filter(F.col("single") == k).select(*by, F.col("n").alias(f"n_{name}"), F.when(F.col("n") > 1, F.col("rho")).alias(f"rho_{name}"))
        out = out.join(p, by, "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    flag = spearman(d, "flag", "target", by).select(*by, F.col("rho").alias("flag_rho"))
    return out.withColumn("balanced", (F.col("rho_single") + F.col("rho_double")) / 2).join(flag, by, "left")


def regression_metrics(predictions: DataFrame, by: list[str], cut: float | None = None) -> DataFrame:
    """by, n, rmse, rmse_std, mae, mae_std, mse, mse_std, r2, r, rho (sample deviations); with `cut`, over targets of at least that."""
    d = predictions if cut is None else predictions.filter(F.col("target") >= cut)
    e = F.col("prediction") - F.col("target")
    out = d.groupBy(*by).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sqrt(F.stddev_samp(e * e)).alias("rmse_std"), F.avg(F.abs(e)).alias("mae"), F.stddev_samp(F.abs(e)).alias("mae_std"),
        F.avg(e * e).alias("mse"), F.stddev_samp(e * e).alias("mse_std"), (1 - _ratio(F.avg(e * e), F.var_pop("target"))).alias("r2"),
    )
    return out.join(pearson(d, "prediction", "target", by).drop("n"), by, "left").join(spearman(d, "prediction", "target", by).drop("n"), by, "left")


def model_split_table(predictions: DataFrame) -> DataFrame:
    """model, split, n, rho, r, mse, mse_ratio (by the constant predictor's)."""
    m = regression_metrics(predictions, ["model", "split"]).select("model", "split", "n", "rho", "r", "mse")
    v = predictions.groupBy("model", "split").agg(F.var_pop("target").alias("_v"))
    return m.join(v, ["model", "split"]).withColumn("mse_ratio", _ratio(F.col("mse"), F.col("_v"))).drop("_v")


def fitness_class(fitness: Column, dead_tol: float = 0.01) -> Column:
    return F.when(fitness >= 1, "beneficial").when(fitness <= dead_tol, "dead").when(fitness.isNotNull(), "deleterious")


def fitness_classes(df: DataFrame, value: str, by: str, dead_tol: float = 0.01) -> DataFrame:
    """by, class, n (0 where none), share of the by's rows."""
    x = df.select(by, fitness_class(_clean(F.col(value)), dead_tol).alias("class")).filter(F.col("class").isNotNull())
    grid = x.select(by).distinct().select(by, F.explode(F.array(F.lit("beneficial"), F.lit("dead"), F.lit("deleterious"))).alias("class"))
    n = grid.join(x.groupBy(by, "class").agg(F.count("*").alias("n")), [by, "class"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def share_above(df: DataFrame, value: str, cut: float, by: list[str]) -> DataFrame:
    """by, n_at_least, share_above: rows >= cut, and the share > cut."""
    return df.groupBy(*by).agg(F.sum((F.col(value) >= cut).cast("long")).alias("n_at_least"), F.avg((F.col(value) > cut).cast("int")).alias("share_above"))


def subset_correlations(scores: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """by, subset (single, pair, all), n, r, rho."""
    key = [*(by or []), "subset"]
    d = scores.select(*(by or []), F.explode(F.array(F.when(F.col("single") == 1, "single").otherwise("pair"), F.lit("all"))).alias("subset"), x, y)
    d = Rounds(scores.sparkSession).stored(d, "scores")
    return pearson(d, x, y, key).join(spearman(d, x, y, key).drop("n"), key)


def merge_predictions(a: DataFrame, b: DataFrame) -> DataFrame:
    """assay_id, single, code, target, prediction_a, prediction_b of rows that both models scored."""
    key = ["assay_id", "single", "code"]
    return a.select(*key, "target", F.col("prediction").alias("prediction_a")).join(b.select(*key, F.col("prediction").alias("prediction_b")), key)


def leaderboard(runs: DataFrame, base_seed: str) -> DataFrame:
    """place, trial, n_seeds, mean, std (sample), min, mean_epoch, mean_gap, n_params and config (of the first run), base: score on the base seed. Most seeds first, then the best mean."""
    s = runs.groupBy("trial").agg(
        F.count("seed").alias("n_seeds"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"), F.min("score").alias("min"), F.avg("best_epoch").alias("mean_epoch"),
        F.avg("gap").alias("mean_gap"), F.min_by("n_params", "run").alias("n_params"), F.min_by("config", "run").alias("config"),
        F.max_by(F.when(F.col("seed") == base_seed, F.col("score")), F.when(F.col("seed") == base_seed, F.col("run"))).alias("base"),
    )
    key = s.withColumn("_rest", -F.col("mean")).withColumn("_key", -F.col("n_seeds"))
    return with_ordinal(key, ["_key", "_rest", "trial"], name="place").drop("_key", "_rest")


def top_trials(runs: DataFrame, k: int) -> DataFrame:
    """trial, mean of the k best trials by mean score."""
    return runs.groupBy("trial").agg(F.avg("score").alias("mean")).orderBy(F.desc("mean"), "trial").limit(k)


def seed_difficulty(runs: DataFrame) -> DataFrame:
    """seed, mean over the trials with a run of stage confirm."""
    confirmed = runs.filter("stage = 'confirm'").select("trial").distinct()
    return runs.join(confirmed, "trial", "left_semi").groupBy("seed").agg(F.avg("score").alias("mean"))
