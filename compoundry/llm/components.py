"""Connected components by alternating large and small stars, a few join rounds on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compoundry.llm.common import write_once


def _settled(edges: DataFrame) -> bool:
    """Every node hangs below one root, and no root hangs below another."""
    several = edges.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("w")).where("v <> w").select(F.lit(1).alias("x"))
    chained = edges.select("v").join(edges.select(F.col("u").alias("v")), "v", "left_semi").select(F.lit(1).alias("x"))
    return several.unionAll(chained).isEmpty()


def connect(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id`` and ``component`` (smallest id reachable) of every id in ``nodes``.

    ``links`` has columns a and b. Each round hangs every node below the smallest neighbour
    of its neighbours; the number of rounds is logarithmic. Minima are written before they
    are joined, so that the join of a hub with its many neighbours can be split.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = write_once(edges, "edges")
    while not _settled(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = write_once(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "low")
        large = write_once(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = write_once(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = write_once(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return nodes.join(edges.toDF("id", "component"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
