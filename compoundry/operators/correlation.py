"""Correlation screening of any number of columns, without a matrix on the driver.

Columns are cut into blocks of ``BLOCK``. A task sums the products of every block pair over its
rows and sends one small matrix per pair; the matrices of a pair are added where they meet, and
only pairs of columns above the threshold leave. Which columns stay is decided on those
pairs as an order-first independent set: a column stays unless an earlier one that stays
correlates with it. The driver holds names, means and deviations: one number each per column.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compoundry.operators import greedy

BLOCK = 128
HELD_BYTES = 64 << 20


def _products(mean: np.ndarray, sd: np.ndarray, block: int):
    """mapInArrow: products of scaled columns per block pair, sent whenever a task holds enough of them."""
    p = len(mean)
    cuts = [(lo, min(p, lo + block)) for lo in range(0, p, block)]

    def sent(held: dict) -> pa.RecordBatch:
        keys = list(held)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
                                           pa.array([held[k].tobytes() for k in keys], pa.binary())], ["a", "b", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        size = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                x = (np.stack([part.column(i).to_numpy(zero_copy_only=False) for i in range(p)], axis=1) - mean) / sd
                for i, (a, b) in enumerate(cuts):
                    for j in range(i, len(cuts)):
                        more = x[:, a:b].T @ x[:, cuts[j][0] : cuts[j][1]]
                        if (i, j) in held:
                            held[i, j] += more
                        else:
                            held[i, j] = more
                            size += more.nbytes
                        if size >= HELD_BYTES:
                            yield sent(held)
                            held, size = {}, 0
        if held:
            yield sent(held)
    return run


def _added(n: int, p: int, block: int, threshold: float):
    """applyInArrow on one block pair: the sum of its matrices, pairs of columns at or above the threshold."""
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, j = key[0].as_py(), key[1].as_py()
        width = min(p, (j + 1) * block) - j * block
        total = np.zeros((min(p, (i + 1) * block) - i * block, width))
        for batch in batches:
            for blob in batch.column("sums"):
                total += np.frombuffer(blob.as_py()).reshape(-1, width)
        r = np.clip(total / n, -1, 1)
        a, b = np.nonzero(np.abs(r) >= threshold - 1e-12)
        first, second = a + i * block, b + j * block
        keep = first < second
        yield pa.RecordBatch.from_arrays([pa.array(first[keep].astype(np.int64)), pa.array(second[keep].astype(np.int64)), pa.array(r[a, b][keep])], ["a", "b", "r"])
    return run


def correlated_columns(df: DataFrame, cols: list[str], threshold: float = 0.95, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """Pairs a < b of column numbers with |r| >= ``threshold`` over rows without missing values, and all variances.

    A constant column correlates with nothing; no row, no pair.
    """
    rows = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(cols)]).na.drop("any")
    stats = rows.agg(F.count(F.lit(1)), *[f(f"x{i}") for i in range(len(cols)) for f in (F.avg, F.var_pop)]).first()
    n, spark = int(stats[0]), df.sparkSession
    mean, variance = (np.array([float(v or 0.0) for v in stats[k::2]]) for k in (1, 2))
    if not n:
        return spark.createDataFrame([], "a long, b long, r double"), variance
    # a column without spread is divided by infinity: its products are nought
    sd = np.where(variance > 0, np.sqrt(variance), np.inf)
    sums = rows.mapInArrow(_products(mean, sd, block), "a int, b int, sums binary")
    return sums.groupBy("a", "b").applyInArrow(_added(n, len(cols), block, threshold), "a long, b long, r double"), variance


def high_correlation_columns(df: DataFrame, cols: list[str], threshold: float = 0.95, prefer: str = "variance", block: int = BLOCK) -> DataFrame:
    """feature, position, kept: a column goes when an earlier kept one correlates with it.

    "Earlier" is by falling variance (ties by position), or by position where ``prefer`` is anything else.
    """
    pairs, variance = correlated_columns(df, cols, threshold, block)
    order = np.argsort(-variance, kind="stable") if prefer == "variance" else np.arange(len(cols))
    place = np.empty(len(cols), np.int64)
    place[order] = np.arange(len(cols))
    nodes = df.sparkSession.createDataFrame([(i, c, int(place[i])) for i, c in enumerate(cols)], "id long, feature string, ord long")
    kept = greedy.order_first_set(nodes, pairs.select("a", "b"), "ord")
    return nodes.join(kept.withColumn("kept", F.lit(True)), "id", "left").select(
        "feature", F.col("id").alias("position"), F.coalesce("kept", F.lit(False)).alias("kept"))
