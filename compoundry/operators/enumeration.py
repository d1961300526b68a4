"""Reaction products of reactant pools: ordered, deduplicated, up to a requested number.

Combinations are numbered, so any stretch of the (never materialised) product of the
pools can be worked on by itself.  Stretches grow until enough products are found.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from compoundry.chem import reactions
from compoundry.functions.missing import text
from compoundry.functions.skew import with_global_rank
from compoundry.session import reliable_checkpoint

SCHEMA = "rule_name string, smirks string, reactants array<string>, product_smiles string, position bigint, place int"
MAX_RULES = 10_000


def products_of(rule: str, reactants: Column) -> Column:
    """array of product texts of one combination."""
    @F.pandas_udf("array<string>")
    def run(combos: pd.Series) -> pd.Series:
        return pd.Series([reactions.run(rule, list(c)) for c in combos], dtype=object)

    return run(reactants)


def indexed_pool(df: DataFrame, smiles: str, order: str) -> tuple[DataFrame, int]:
    """Non-empty texts of a pool numbered from 0 in input order."""
    rows = df.select(text(F.col(smiles)).alias("smi"), F.col(order).alias("_o")).where(F.col("smi") != "")
    ranked = with_global_rank(rows, "_o", "_o", "i").select((F.col("i") - 1).alias("i"), "smi")
    pool = reliable_checkpoint(ranked)
    return pool, pool.count()


def enumerate_products(pools: list[tuple[DataFrame, str, str]], rules: DataFrame, max_products: int = 1000,
                       unique: bool = True, stretch: int = 4096) -> DataFrame:
    """Products per rule, in the order the pools are walked (last rows first).

    ``pools`` are (table, structure column, whole-number order column); ``rules`` has name,
    smirks and a position.  Rules with more reactants than pools are skipped.
    """
    ready = [p for p in (indexed_pool(*p) for p in pools) if p[1] > 0]
    listed = rules.orderBy("position").limit(MAX_RULES + 1).collect()
    if len(listed) > MAX_RULES:
        raise ValueError(f"a rule table has at most {MAX_RULES} rows")
    todo = [(r["name"], r["smirks"]) for r in listed if reactions.readable(r["smirks"] or "")]
    spark = rules.sparkSession
    found: list[tuple] = []
    seen: set[tuple[str, str]] = set()
    for name, smirks in todo:
        k = len(reactions.compile_rule(smirks)[0])
        if not 1 <= k <= len(ready):
            continue
        total, start, width = 1, 0, stretch
        for _, n in ready[:k]:
            total *= n
        while start < total and len(found) < max_products:
            end = min(total, start + width)
            rows = _stretch(spark, ready[:k], smirks, start, end)
            if unique:
                rows = rows.groupBy("product_smiles").agg(F.min(F.struct("position", "place", "reactants")).alias("s")).select(
                    "product_smiles", "s.position", "s.place", "s.reactants")
                skip = [p for s, p in seen if s == smirks]
                if skip:
                    rows = rows.where(~F.col("product_smiles").isin(skip))
            # At most as many rows as are still wanted.
            for r in rows.orderBy("position", "place").limit(max_products - len(found)).collect():
                seen.add((smirks, r["product_smiles"]))
                found.append((name, smirks, list(r["reactants"]), r["product_smiles"], r["position"], r["place"]))
            start, width = end, width * 2
        if len(found) >= max_products:
            break
    return spark.createDataFrame(found, SCHEMA)


def _stretch(spark, pools, smirks: str, start: int, end: int) -> DataFrame:
    """Products of the combinations numbered start .. end - 1."""
    rows = spark.range(start, end).withColumnRenamed("id", "position")
    place = 1
    for level in range(len(pools) - 1, -1, -1):
        pool, n = pools[level]
        # Each pool is walked from its last row to its first, the last pool fastest.
        digit = F.lit(n - 1) - F.pmod(F.floor(F.col("position") / F.lit(place)), F.lit(n))
        rows = rows.withColumn("_d", digit.cast("bigint")).join(pool.select(F.col("i").alias("_d"), F.col("smi").alias(f"r{level}")), "_d").drop("_d")
        place *= n
    combo = F.array(*[F.col(f"r{level}") for level in range(len(pools))])
    done = rows.select("position", combo.alias("reactants"), products_of(smirks, combo).alias("p"))
    return done.select("position", "reactants", F.posexplode("p").alias("place", "product_smiles"))


def enumeration_summary(products: DataFrame) -> DataFrame:
    """Products per rule."""
    return products.groupBy("rule_name", "smirks").agg(F.count(F.lit(1)).alias("n_products"),
                                                       F.count_distinct("product_smiles").alias("n_distinct"))
