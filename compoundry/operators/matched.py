"""Matched pairs: structures that share a large common part and differ in the rest.

Pairs are looked at in row order (first row, then its partners) until the requested
number is found; that many rows come back in this order.  When fewer exist, all pairs are
compared and sorted by shared size.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from compoundry.chem import common
from compoundry.functions.missing import text
from compoundry.functions.skew import with_global_rank
from compoundry.session import reliable_checkpoint

SCHEMA = "index_a bigint, index_b bigint, transformation string, shared_heavy_atoms int, delta_property double"
MAX_BLOCK = 512


def _compare(a: Column, b: Column, min_atoms: int) -> Column:
    @F.pandas_udf("struct<n int, rest_a string, rest_b string>")
    def run(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        out = [common.matched(x, y, min_atoms) or (None, None, None) for x, y in zip(left, right)]
        return pd.DataFrame(out, columns=["n", "rest_a", "rest_b"]).astype({"n": "Int32"})

    return run(a, b)


def matched_pairs(df: DataFrame, smiles: str, ident: str, value: str | None = None, min_shared: int = 4, max_pairs: int = 500) -> DataFrame:
    """index_a, index_b, transformation ``A -> B``, shared atoms, property change (b - a)."""
    v = F.col(value).cast("double") if value else F.lit(None).cast("double")
    rows = df.select(F.col(ident).alias("_id"), text(F.col(smiles)).alias("_s"), v.alias("_v")).where(F.col("_s") != "")
    rows = reliable_checkpoint(with_global_rank(rows, "_id", "_id", "_i"))
    n, found, first, block, width = rows.count(), [], 1, 1, 256
    at = first + 1
    while first < n and len(found) < max_pairs:
        last = min(n, first + block - 1)
        stop = min(n, at + width - 1) if block == 1 else n
        # At most MAX_BLOCK rows on the small side; partners in a stretch of the table.
        heads = F.broadcast(rows.where(F.col("_i").between(first, last)).select(F.col("_i").alias("i"), F.col("_id").alias("index_a"),
                                                                               F.col("_s").alias("sa"), F.col("_v").alias("va")))
        part = rows.where(F.col("_i").between(at, stop)).join(heads, F.col("i") < F.col("_i"))
        part = part.withColumn("m", _compare(F.col("sa"), F.col("_s"), min_shared)).where(F.col("m.n").isNotNull())
        hits = part.select("i", "_i", "index_a", F.col("_id").alias("index_b"), F.concat("m.rest_a", F.lit(" -> "), "m.rest_b").alias("t"),
                           F.col("m.n").alias("n"), F.round(F.col("_v") - F.col("va"), 4).alias("d"))
        got = hits.orderBy("i", "_i").limit(max_pairs - len(found)).collect()
        found += [(r["index_a"], r["index_b"], r["t"], r["n"], r["d"]) for r in got]
        if stop < n:
            at, width = stop + 1, width * 4
        else:
            first, block = last + 1, min(MAX_BLOCK, block * 8)
            at, width = first + 1, 256
    out = df.sparkSession.createDataFrame(found, SCHEMA)
    if len(found) >= max_pairs:
        return out
    return out.orderBy(F.desc("shared_heavy_atoms"), F.abs(F.coalesce("delta_property", F.lit(0.0))), "index_a", "index_b")
