"""Connected components of links, by joins: the least label spreads to neighbours and then jumps along labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fitscape.llm.shared import Scratch, stored


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long). Returns node, comp for each node of a link; comp is the least node that it reaches."""
    scratch = Scratch(links.sparkSession)
    both = scratch.stored(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct(), "links")
    label = scratch.stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("comp")), "labels")
    while True:
        heard = both.join(label.select(F.col("node").alias("v"), "comp"), "v").groupBy("u").agg(F.min("comp").alias("near"))
        near = label.join(heard.withColumnRenamed("u", "node"), "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("next"))
        jump = near.join(label.select(F.col("node").alias("next"), F.col("comp").alias("far")), "next").select("node", "old", F.least("next", "far").alias("comp"))
        moved = scratch.stored(jump, "labels")
        if moved.filter("comp < old").limit(1).count() == 0:
            out = stored(moved.select("node", "comp"), "components")
            scratch.clear()
            return out
        label = moved.select("node", "comp")
