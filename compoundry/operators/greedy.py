"""Sequential greedy selections as a few rounds of distributed joins.

"Walk the rows in order, keep a row unless an earlier kept row is its neighbour" has
one answer: the order-first maximal independent set.  A row is decided as soon as no
undecided neighbour precedes it, so all such rows are decided in the same round; the
number of rounds is the longest chain of waiting rows, short for shuffled orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compoundry.session import reliable_checkpoint


def order_first_set(nodes: DataFrame, edges: DataFrame, order: str, max_rounds: int = 10_000) -> DataFrame:
    """ids kept by the walk.

    ``nodes``: id and a totally ordered column ``order``; ``edges``: a, b (undirected).
    """
    spark = nodes.sparkSession
    rank = lambda side: nodes.select(F.col("id").alias(side), F.col(order).alias(f"_{side}"))
    directed = edges.join(rank("a"), "a").join(rank("b"), "b").select(
        F.when(F.col("_a") < F.col("_b"), F.col("a")).otherwise(F.col("b")).alias("early"),
        F.when(F.col("_a") < F.col("_b"), F.col("b")).otherwise(F.col("a")).alias("late"))
    live_edges = reliable_checkpoint(directed)
    live = reliable_checkpoint(nodes.select("id"))
    kept = spark.createDataFrame([], live.schema)
    for _ in range(max_rounds):
        if live.isEmpty():
            return kept
        picked = live.join(live_edges.select(F.col("late").alias("id")), "id", "left_anti")
        picked = reliable_checkpoint(picked)
        removed = live_edges.join(picked, live_edges["early"] == picked["id"], "left_semi").select(F.col("late").alias("id"))
        live = reliable_checkpoint(live.join(picked, "id", "left_anti").join(removed, "id", "left_anti"))
        live_edges = reliable_checkpoint(
            live_edges.join(live.withColumnRenamed("id", "early"), "early", "left_semi")
            .join(live.withColumnRenamed("id", "late"), "late", "left_semi").select("early", "late"))
        kept = reliable_checkpoint(kept.unionAll(picked))
    raise RuntimeError("greedy selection did not settle")


def first_owner(kept: DataFrame, nodes: DataFrame, edges: DataFrame, order: str) -> DataFrame:
    """id, owner: the earliest kept neighbour of every other row; kept rows own themselves."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    heads = kept.join(nodes.select("id", order), "id")
    near = both.join(heads.select(F.col("id").alias("a"), F.col(order).alias("_o")), "a")
    own = near.groupBy(F.col("b").alias("id")).agg(F.min_by("a", "_o").alias("owner"))
    own = own.join(kept, "id", "left_anti")
    return own.unionByName(kept.select("id", F.col("id").alias("owner")))
