"""Leakage-free train, validation and test splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fitscape.operators.ordering import exact_cut, greedy_fill, shuffled


def split_by_position(variants: DataFrame, train: float = 0.8, val: float = 0.1, seed: int = 1012, n_blocks: int | None = None) -> DataFrame:
    """Rows (assay_id, ord, single, nodes: array) whose nodes' groups are in one split, with split.

    A group is a node, or one of n_blocks contiguous blocks of the assay's observed nodes (20 if it has pairs). Groups
    in shuffled order go to the split with the least filled share, by the rows that lie in one group. Unaligned rows
    (no nodes) and rows across splits are left out. An assay without aligned rows gives none.
    """
    groups = node_groups(variants, n_blocks)
    sites = variants.select("assay_id", "ord", F.explode("nodes").alias("node")).join(groups, ["assay_id", "node"])
    of_row = sites.groupBy("assay_id", "ord").agg(F.collect_set("grp").alias("groups"))
    sizes = of_row.filter(F.size("groups") == 1).groupBy("assay_id", F.get("groups", F.lit(0)).alias("grp")).agg(F.count("*").alias("n"))
    table = groups.select("assay_id", "grp").distinct().join(sizes, ["assay_id", "grp"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    table = shuffled(table, "grp", seed)
    filled = greedy_fill(table, "n", [("_shuffle", True)], (train, val, 1 - train - val), ["assay_id"]).select("assay_id", "grp", "split")
    splits = of_row.select("assay_id", "ord", F.explode("groups").alias("grp")).join(filled, ["assay_id", "grp"]).groupBy("assay_id", "ord").agg(F.min("split").alias("split"), F.max("split").alias("_other")).filter("split = _other").drop("_other")
    return variants.join(splits, ["assay_id", "ord"])


def node_groups(variants: DataFrame, n_blocks: int | None = None) -> DataFrame:
    """assay_id, node, grp for each observed node. Block k of b holds places int(k * n / b) to int((k + 1) * n / b) of the n sorted nodes."""
    nodes = variants.select("assay_id", F.explode("nodes").alias("node")).distinct()
    pairs = variants.groupBy("assay_id").agg(F.max((F.col("single") == 0).cast("int")).alias("_pairs"))
    own = Window.partitionBy("assay_id")
    blocks = F.lit(n_blocks) if n_blocks else F.when(F.col("_pairs") == 1, 20)
    x = nodes.join(pairs, "assay_id").withColumn("_n", F.count("*").over(own)).withColumn("_i", F.row_number().over(own.orderBy("node")) - 1).withColumn("_b", blocks)
    # the greatest k with int(k * n / b) <= i
    k = F.floor(((F.col("_i") + 1) * F.col("_b") - 1) / F.col("_n"))
    return x.select("assay_id", "node", F.when(F.col("_b").isNull(), F.col("node")).otherwise(k).cast("long").alias("grp"))


def describe_split(df: DataFrame) -> DataFrame:
    """assay_id, split, n, n_single, n_double, too_few (below 2 rows)."""
    return df.groupBy("assay_id", "split").agg(F.count("*").alias("n"), F.sum((F.col("single") == 1).cast("long")).alias("n_single"), F.sum((F.col("single") == 0).cast("long")).alias("n_double")).withColumn("too_few", F.col("n") < 2)


def held_out_doubles(variants: DataFrame, scope: str = "unseen", train: float = 0.8, val: float = 0.1, seed: int = 1012) -> DataFrame:
    """Aligned pairs; with scope unseen, those without a node of the singles' training rows. Fails on another scope, no singles, no pairs, or fewer than two rows kept."""
    if scope not in ("unseen", "all"):
        raise ValueError(f"scope must be unseen or all, not {scope}")
    singles, doubles = variants.filter("single = 1"), variants.filter("single = 0")
    for name, part in (("single", singles), ("double", doubles)):
        if part.isEmpty():
            raise ValueError(f"no {name} mutants")
    kept = doubles.filter(F.size("nodes") > 0)
    if scope == "unseen":
        seen = split_by_position(singles, train, val, seed).filter("split = 'train'").select("assay_id", F.explode("nodes").alias("node")).distinct()
        bad = kept.select("assay_id", "ord", F.explode("nodes").alias("node")).join(seen, ["assay_id", "node"], "left_semi").select("assay_id", "ord").distinct()
        kept = kept.join(bad, ["assay_id", "ord"], "left_anti")
    if kept.limit(2).count() < 2:
        raise ValueError("fewer than two double mutants held out")
    return kept


def split_random(df: DataFrame, key: str, train: float = 0.8, val: float = 0.1, seed: int = 1012) -> DataFrame:
    """Exact shares of shuffled rows."""
    return exact_cut(df, key, train, val, seed)


def split_by_id(df: DataFrame, key: str, train: float = 0.8, val: float = 0.1, seed: int = 1012) -> DataFrame:
    """Exact shares of shuffled ids; all rows of an id together."""
    return df.join(exact_cut(df.select(key).distinct(), key, train, val, seed), key)


def split_by_cluster(df: DataFrame, clusters: DataFrame, key: str = "seq_id", train: float = 0.8, val: float = 0.1, seed: int = 1012) -> DataFrame:
    """Whole clusters, largest first (shuffled ties), each to the least filled split; shares count all rows."""
    rows = df.join(clusters.select(key, "cluster"), key)
    sizes = shuffled(rows.groupBy("cluster").agg(F.count("*").alias("n")), "cluster", seed).withColumn("_all", F.lit(0))
    filled = greedy_fill(sizes, "n", [("n", False), ("_shuffle", True)], (train, val, 1 - train - val), ["_all"])
    return rows.join(filled.select("cluster", "split"), "cluster").drop("cluster")


def split_shares(df: DataFrame) -> DataFrame:
    """split, n, percent of all rows."""
    n = df.groupBy("split").agg(F.count("*").alias("n"))
    return n.withColumn("percent", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))  # three rows


