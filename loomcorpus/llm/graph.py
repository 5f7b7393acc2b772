"""Connected components by alternating large and small stars (Kiveris et al.), in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: With fewer edges no node is looked for that has many.
HOT = 5000


def components(edges: DataFrame, scratch: common.Scratch) -> DataFrame:
    """(node, label) of every node of the edges (u, v): the least node that it reaches. Repeated edges and loops count for nothing;
    without other edges there are no rows; null ends must be left out before, and columns beside u and v are not read.

    Each turn is written to the shared folder, so lineage stays short and a lost executor costs one turn at most; a
    hot node's edges are aggregated before they are shuffled, and joined back dealt over many tasks.
    """
    now = scratch.put(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        before = state
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = common.join_split if state[0] > HOT else lambda left, right, key, _: left.join(right, key)
        large = joined(both.where("v > u"), least, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.put(large, "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = joined(large, least, "u", "v").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = scratch.put(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
