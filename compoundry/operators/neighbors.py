"""Exact nearest neighbours in feature space, block by block.

Reference rows are sliced along the direction of largest spread and packed into
bounded blocks.  Pass one compares each query with one block of its own slice, which
bounds the distance to its k-th neighbour.  Pass two visits only slices that this
bound can reach: a difference along one direction never exceeds the full distance.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from compoundry.functions import blocks
from compoundry.session import reliable_checkpoint

MAX_SLICES = 4096


def _distances(rows, k: int):
    """Sorted distances to the k nearest items for every query of a block pair."""
    q = np.array([i["x"] for i in rows.q_items], dtype=float)
    r = np.array([i["x"] for i in rows.r_items], dtype=float)
    out = np.empty((len(q), min(k, len(r))))
    # Differences, not the dot-product identity: equal rows must give exactly zero.
    step = max(1, 2_000_000 // max(1, len(r)))
    for s in range(0, len(q), step):
        total = np.zeros((len(q[s:s + step]), len(r)))
        for k_dim in range(q.shape[1]):
            gap = np.subtract.outer(q[s:s + step, k_dim], r[:, k_dim])
            total += gap * gap
        part = np.partition(total, out.shape[1] - 1, axis=1)[:, :out.shape[1]]
        out[s:s + step] = np.sqrt(np.sort(part, axis=1))
    return out


def _compare(pairs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                d = _distances(row, k)
                yield pd.DataFrame({"qid": [i["qid"] for i in row.q_items], "d": d.tolist()})

    return pairs.select("q_items", "r_items").mapInPandas(run, "qid bigint, d array<double>")


def _merge(parts: DataFrame, k: int) -> DataFrame:
    """Best k of the per-block lists; each list is at most k long."""
    return parts.groupBy("qid").agg(F.slice(F.array_sort(F.flatten(F.collect_list("d"))), 1, k).alias("d"))


def nearest_distances(query: DataFrame, query_id: str, reference: DataFrame, x: str, direction: np.ndarray,
                      k: int, block_rows: int = blocks.BLOCK_ROWS) -> DataFrame:
    """query_id, d: ascending distances to the ``k`` nearest reference rows.

    ``x`` is an array<double> column present on both sides; ``direction`` a unit vector.
    Of equal reference vectors only k copies can ever be among the k nearest, so a
    vector that repeats for a third of the table still fills one block only.
    """
    w = F.array(*[F.lit(float(v)) for v in direction])
    query, reference = query.withColumnRenamed(x, "x"), reference.withColumnRenamed(x, "x")
    project = F.aggregate(F.zip_with(F.col("x"), w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    distinct = reference.groupBy("x").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("_n"))
    ref = distinct.select("x", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_copy"))
    ref = ref.select("x", F.xxhash64("x", "_copy").alias("h"), project.alias("p"))
    n_ref = ref.count()
    n_slices = int(min(MAX_SLICES, max(1, n_ref // block_rows)))
    probs = [i / n_slices for i in range(1, n_slices)]
    cuts = sorted(set(ref.approxQuantile("p", probs, 0.25 / n_slices))) if probs else []
    cut_array = F.array(*[F.lit(float(c)) for c in cuts]) if cuts else F.array().cast("array<double>")
    slice_of = lambda v: F.size(F.filter(cut_array, lambda c: c <= v))
    ref = ref.withColumn("cell", slice_of(F.col("p")))
    bounds = ref.groupBy("cell").agg(F.min("p").alias("p_min"), F.max("p").alias("p_max"))
    packed = blocks.pack(ref, "cell", "h", ["x"], blocks.cell_sizes(ref, "cell", block_rows)).select(
        "cell", "sub", F.col("items").alias("r_items"))
    q = query.select(F.col(query_id).alias("qid"), "x", project.alias("p"))

    def pair_up(rows: DataFrame, reference_blocks: DataFrame) -> DataFrame:
        sizes = blocks.cell_sizes(rows, "cell", block_rows)
        mine = blocks.pack(rows, "cell", "qid", ["x"], sizes).select("cell", F.col("items").alias("q_items"))
        return mine.join(reference_blocks, "cell")

    if not cuts:
        return _merge(_compare(pair_up(q.withColumn("cell", F.lit(0)), packed), k), k).withColumnRenamed("qid", query_id)
    home = q.withColumn("cell", slice_of(F.col("p")))
    first = _merge(_compare(pair_up(home, packed.where(F.col("sub") == 0)), k), k)
    bound = F.when(F.size("d") >= k, F.element_at("d", -1)).otherwise(float("inf"))
    # Two numbers per query row, kept so that pass one is not computed twice.
    known = reliable_checkpoint(first.select("qid", bound.alias("ub")))
    reach = q.join(known, "qid", "left").withColumn("ub", F.coalesce("ub", F.lit(float("inf"))) * (1 + 1e-9))
    near = (F.col("p_min") <= F.col("p") + F.col("ub")) & (F.col("p_max") >= F.col("p") - F.col("ub"))
    # The slice directory has at most MAX_SLICES rows.
    visits = reach.join(F.broadcast(bounds), near).select("qid", "x", "cell")
    return _merge(_compare(pair_up(visits, packed), k), k).withColumnRenamed("qid", query_id)


def mean_distance(distances: DataFrame, k: int) -> DataFrame:
    """Mean over k neighbours.  The nearest is dropped only if it is a zero distance for
    *every* query row, as when a table is compared with itself."""
    has_more = F.size("d") > 1
    whole = distances.agg(F.bool_and(has_more & (F.element_at("d", 1) <= 1e-12)).alias("_self"))
    used = F.when(F.col("_self"), F.slice("d", 2, k)).otherwise(F.slice("d", 1, k))
    mean = F.aggregate(used, F.lit(0.0), lambda a, b: a + b) / F.size(used)
    return distances.crossJoin(F.broadcast(whole)).withColumn("knn_dist", mean).drop("_self", "d")


def feature_array(cols: list[str], mean: np.ndarray, std: np.ndarray) -> Column:
    """z-scaled feature vector."""
    return F.array(*[(F.col(f"`{c}`").cast("double") - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(cols, mean, std)])
