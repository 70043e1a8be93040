"""Feature rows of residues, mutated sites and variants; label scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fitscape.functions.alphabet import LETTERS, aa_index
from fitscape.functions.arrays import one_hot
from fitscape.operators.assay import code_sites, with_nodes


def standardize_properties(props: DataFrame) -> DataFrame:
    """prop_id, aa, value: z-scores over the 20 letters, population deviation (1 if it is 0)."""
    own = Window.partitionBy("prop_id")
    s = F.stddev_pop("value").over(own)
    return props.filter(F.col("aa").isin(list(LETTERS))).select("prop_id", "aa", ((F.col("value") - F.avg("value").over(own)) / F.when(s > 0, s).otherwise(1.0)).alias("value"))


def load_property_set(df: DataFrame, width: int) -> DataFrame:
    """prop_id, aa, value of a table of components (aa, values: array), taken as they are. Fails unless it has the 20 letters, each with `width` values."""
    bad = df.filter((F.size("values") != width) | ~F.col("aa").isin(list(LETTERS))).limit(1).count()
    if bad or df.select("aa").distinct().count() != 20:
        raise ValueError(f"not a table of 20 letters by {width}")
    return df.select("aa", F.posexplode("values").alias("_k", "value")).select(F.concat(F.lit("component_"), F.lpad(F.col("_k").cast("string"), 3, "0")).alias("prop_id"), "aa", F.col("value").cast("double"))


def property_arrays(props: DataFrame) -> DataFrame:
    """aa, props: values in order of prop_id. 20 rows."""
    return props.groupBy("aa").agg(F.transform(F.array_sort(F.collect_list(F.struct("prop_id", "value"))), lambda x: x["value"]).alias("props"))


def _with_props(df: DataFrame, letter: str, props: DataFrame, name: str) -> DataFrame:
    """Adds the property array of a letter column; zeros for other letters. The table of 20 rows is broadcast."""
    width = props.select("prop_id").distinct().count()
    table = property_arrays(props).select(F.col("aa").alias(letter), F.col("props").alias(name))
    zeros = F.array_repeat(F.lit(0.0), width)
    return df.join(F.broadcast(table), letter, "left").withColumn(name, F.coalesce(name, zeros))


def node_features(residues: DataFrame, props: DataFrame) -> DataFrame:
    """structure_id, node, features: one-hot letter and properties; zeros for another letter."""
    x = _with_props(residues.select("structure_id", "node", "aa"), "aa", props, "_p")
    return x.select("structure_id", "node", F.concat(one_hot(aa_index(F.col("aa"))), "_p").alias("features"))


def site_features(sites: DataFrame, props: DataFrame) -> DataFrame:
    """Sites (wt, mut) with features: both one-hots, both property arrays, and mutant less wild type (40 + 3 P numbers)."""
    x = _with_props(_with_props(sites, "wt", props, "_w"), "mut", props, "_m")
    delta = F.zip_with("_m", "_w", lambda m, w: m - w)
    return x.select(*sites.columns, F.concat(one_hot(aa_index(F.col("wt"))), one_hot(aa_index(F.col("mut"))), "_w", "_m", delta).alias("features"))


def variant_features(variants: DataFrame, mapping: DataFrame, props: DataFrame) -> DataFrame:
    """assay_id, ord, features of aligned rows: site 1, site 2 (zeros if it isn't there or isn't aligned), and whether it is: 2 (40 + 3 P) + 1 numbers."""
    v = with_nodes(variants, mapping).filter("node_1 is not null").withColumn("_s", code_sites(F.col("code")))
    mut = lambda k: F.get("_s", F.lit(k))["mut"]
    v = v.select("assay_id", "ord", F.col("wt_1"), mut(0).alias("m_1"), F.when(F.col("node_2").isNotNull(), F.col("wt_2")).alias("wt_2"), F.when(F.col("node_2").isNotNull(), mut(1)).alias("m_2"))
    one = site_features(v.select("assay_id", "ord", "wt_2", "m_2", F.col("wt_1").alias("wt"), F.col("m_1").alias("mut")), props)
    two = site_features(one.select("assay_id", "ord", F.col("features").alias("_f1"), F.col("wt_2").alias("wt"), F.col("m_2").alias("mut")), props)
    return two.select("assay_id", "ord", F.concat("_f1", "features", F.array(F.col("mut").isNotNull().cast("double"))).alias("features"))


def mutated_node_features(variants: DataFrame, mapping: DataFrame, props: DataFrame, structural: DataFrame) -> DataFrame:
    """assay_id, ord, node, features of mutated nodes only: mask, one-hot, properties, delta, wild-type one-hot, structural (43 + 2 P). structural: node, features."""
    v = with_nodes(variants, mapping).filter("node_1 is not null").withColumn("_s", code_sites(F.col("code")))
    site = lambda k: F.struct(F.col(f"node_{k}").alias("node"), F.col(f"wt_{k}").alias("wt"), F.get("_s", F.lit(k - 1))["mut"].alias("mut"))
    sites = v.select("assay_id", "ord", F.inline(F.array(site(1), site(2)))).filter("node is not null and mut is not null")
    x = _with_props(_with_props(sites, "wt", props, "_w"), "mut", props, "_m")
    delta = F.zip_with("_m", "_w", lambda m, w: m - w)
    x = x.join(structural.select("node", F.col("features").alias("_st")), "node")
    return x.select("assay_id", "ord", "node", F.concat(F.array(F.lit(1.0)), one_hot(aa_index(F.col("mut"))), "_m", delta, one_hot(aa_index(F.col("wt"))), "_st").alias("features"))


def wild_type_background(residues: DataFrame, props: DataFrame, structural: DataFrame) -> DataFrame:
    """node, features of the unmutated nodes: no mask, zero delta and wild-type one-hot."""
    x = _with_props(residues.select("structure_id", "node", "aa"), "aa", props, "_p").join(structural.select("structure_id", "node", F.col("features").alias("_st")), ["structure_id", "node"])
    zeros = F.transform("_p", lambda p: F.lit(0.0))
    return x.select("structure_id", "node", F.concat(F.array(F.lit(0.0)), one_hot(aa_index(F.col("aa"))), "_p", zeros, F.array_repeat(F.lit(0.0), 20), "_st").alias("features"))


def graph_rows(changed: DataFrame, background: DataFrame) -> DataFrame:
    """assay_id, ord, node, features of all nodes of the structure for each variant of changed (mutated_node_features): its own rows, and the background's (node, features; one structure, thousands of nodes at most) elsewhere.

    The background is one array, in which a variant's nodes are replaced before it becomes rows; nothing is shuffled but
    the changed rows of a variant, of which there are two at most.
    """
    whole = background.agg(F.array_sort(F.collect_list(F.struct(F.col("node").alias("node"), F.col("features").alias("features")))).alias("_all"))
    own = changed.groupBy("assay_id", "ord").agg(F.map_from_entries(F.collect_list(F.struct("node", "features"))).alias("_own"))
    place = lambda x: F.struct(x["node"].alias("node"), F.coalesce(F.try_element_at("_own", x["node"]), x["features"]).alias("features"))
    return own.join(F.broadcast(whole), F.lit(True)).select("assay_id", "ord", F.inline(F.transform("_all", place)))


def graph_totals(changed: DataFrame, background: DataFrame) -> DataFrame:
    """assay_id, ord, n_nodes, n_changed and total of graph_rows: its rows, those with the mask, and the sum of all their features, without making rows of nodes that are the background's.

    Each variant has the background's sums, less those of the nodes that it changes, plus its own.
    """
    add, masked = lambda f: F.aggregate(f, F.lit(0.0), lambda a, v: a + v), lambda f: (F.get(f, F.lit(0)) == 1).cast("long")
    back = background.select("node", add("features").alias("_back"), masked("features").alias("_was"))
    whole = back.agg(F.count("*").alias("_n"), F.sum("_was").alias("_flags"), F.sum("_back").alias("_sum"))
    own = changed.select("assay_id", "ord", "node", add("features").alias("_own"), masked("features").alias("_is"))
    own = own.join(F.broadcast(back), "node", "left")
    known = lambda x: F.coalesce(F.sum(F.when(F.col("_back").isNotNull(), x)), F.lit(0))
    own = own.groupBy("assay_id", "ord").agg(known(F.col("_is") - F.col("_was")).alias("_more"), known(F.col("_own") - F.col("_back")).alias("_delta"))
    return own.join(F.broadcast(whole), F.lit(True)).select("assay_id", "ord", F.col("_n").alias("n_nodes"), (F.col("_flags") + F.col("_more")).alias("n_changed"), (F.col("_sum") + F.col("_delta")).alias("total"))


def _scaled(df: DataFrame, value: str, by: list[str], shift: Column, scale: Column, name: str) -> DataFrame:
    stats = df.filter("split = 'train'").groupBy(*by).agg(shift.alias("_shift"), scale.alias("_scale"))
    return df.join(stats, by, "left").withColumn(name, (F.col(value) - F.col("_shift")) / F.nullif("_scale", F.lit(0.0))).drop("_shift", "_scale")


def standardize(df: DataFrame, value: str, by: list[str], name: str = "scaled") -> DataFrame:
    """z-scores by the training rows' mean and sample deviation, for all splits; null without a deviation."""
    return _scaled(df, value, by, F.avg(value), F.stddev_samp(value), name)


def min_max(df: DataFrame, value: str, by: list[str], name: str = "scaled") -> DataFrame:
    """Training minimum to 0 and maximum to 1; no clipping."""
    return _scaled(df, value, by, F.min(value), F.max(value) - F.min(value), name)


def unscale(df: DataFrame, stats: DataFrame, value: str, by: list[str], name: str = "original") -> DataFrame:
    """value * std + mean; stats: by, mean, std."""
    return df.join(stats, by).withColumn(name, F.col(value) * F.col("std") + F.col("mean")).drop("mean", "std")


def group_weights(train: DataFrame, by: list[str]) -> DataFrame:
    """by, single, weight: total / (2 * count) of singles and doubles; 0 for none."""
    n = train.groupBy(*by).agg(F.count("*").alias("t"), F.sum((F.col("single") == 1).cast("long")).alias("s1"))
    rows = F.inline(F.array(*[F.struct(F.lit(k).alias("single"), c.alias("n")) for k, c in ((1, F.col("s1")), (0, F.col("t") - F.col("s1")))]))
    return n.select(*by, "t", rows).select(*by, "single", F.when(F.col("n") > 0, F.col("t") / (2.0 * F.col("n"))).otherwise(0.0).alias("weight"))
