"""Scaffold counts, activity per scaffold and chemical series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compoundry.chem import kernels
from compoundry.chem.facts import by_text
from compoundry.functions.missing import finite
from compoundry.functions.skew import join_stats

NO_SCAFFOLD = "__no_scaffold__"


def annotate(df: DataFrame, smiles: str) -> DataFrame:
    """scaffold_status, murcko, generic per row, worked out per distinct text; acyclic rows carry the no-scaffold label."""
    s = by_text(df, smiles, lambda texts: texts.withColumn("_s", kernels.scaffolds(F.col(smiles))))
    name = lambda c: F.when(F.col("_s.status") == "acyclic", NO_SCAFFOLD).otherwise(F.col(f"_s.{c}"))
    return s.withColumns({"scaffold_status": F.col("_s.status"), "murcko": name("murcko"), "generic": name("generic")}).drop("_s")


def summary(df: DataFrame, kind: str = "murcko", include_acyclic: bool = True, top_n: int | None = None) -> DataFrame:
    """scaffold, count, fraction of valid rows; most frequent first."""
    counts = df.where(F.col(kind).isNotNull()).groupBy(F.col(kind).alias("scaffold")).agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("_t"))
    out = counts.crossJoin(F.broadcast(total)).withColumn("fraction", F.round(F.col("count") / F.col("_t"), 4)).drop("_t")
    if not include_acyclic:
        out = out.where(F.col("scaffold") != NO_SCAFFOLD)
    out = out.orderBy(F.desc("count"), "scaffold")
    return out.limit(top_n) if top_n else out


def activity_summary(df: DataFrame, scaffold: str, activity: str, log_scale: bool = False) -> DataFrame:
    """count, mean, best, worst, sample deviation per scaffold, rounded to 4."""
    v = finite(F.col(activity).cast("double"))
    best, worst = (F.max, F.min) if log_scale else (F.min, F.max)
    rows = df.where(F.col(scaffold).isNotNull() & v.isNotNull()).withColumn("_v", v)
    out = rows.groupBy(F.col(scaffold).alias("scaffold")).agg(
        F.count(F.lit(1)).alias("count"), F.round(F.avg("_v"), 4).alias("mean_activity"), F.round(best("_v"), 4).alias("best_activity"),
        F.round(worst("_v"), 4).alias("worst_activity"),
        F.round(F.when(F.count(F.lit(1)) > 1, F.stddev_samp("_v")).otherwise(0.0), 4).alias("std_activity"))
    first = F.desc("best_activity") if log_scale else F.asc("best_activity")
    return out.orderBy(first, F.desc("count"), "scaffold")


def series(df: DataFrame, scaffold: str, activity: str | None = None, log_scale: bool = False, min_size: int = 1) -> DataFrame:
    """Series rows: size, fraction and activity statistics per scaffold."""
    counts = summary(df.withColumnRenamed(scaffold, "_sc"), "_sc")
    if activity:
        stats = activity_summary(df, scaffold, activity, log_scale).withColumnRenamed("count", "n_activity")
        counts = counts.join(stats, "scaffold", "left")
    return counts.where(F.col("count") >= min_size)


def series_members(df: DataFrame, scaffold: str) -> DataFrame:
    """Every row with the size of its series."""
    sizes = df.where(F.col(scaffold).isNotNull()).groupBy(scaffold).agg(F.count(F.lit(1)).alias("series_size"))
    out = join_stats(df, sizes, [scaffold], "series_size")
    return out.withColumn("series_size", F.coalesce("series_size", F.lit(0)))


def series_summary(df: DataFrame, scaffold: str) -> DataFrame:
    """n_rows, valid, invalid, series, singletons, acyclic rows (one row)."""
    per = df.groupBy(F.col(scaffold).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    real = F.col("s").isNotNull()
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("bigint")
    return per.agg(total(F.lit(True)).alias("n_rows"), total(real).alias("n_valid_molecules"), total(~real).alias("n_invalid_molecules"),
                   F.count_if(real).alias("n_series"), F.count_if(real & (F.col("n") == 1)).alias("n_singleton_series"),
                   total(F.col("s") == NO_SCAFFOLD).alias("n_acyclic_rows"))


def common_core(df: DataFrame, smiles: str) -> str | None:
    """Most frequent ring scaffold (ties by text)."""
    row = summary(annotate(df, smiles), include_acyclic=False, top_n=1).first()
    return row["scaffold"] if row else None


def r_group_table(df: DataFrame, smiles: str, core: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(matched rows with their side-group map, unmatched valid rows)."""
    text = core or common_core(df, smiles)
    if not text:
        raise ValueError("no common core; give one")
    rows = df.withColumns({"groups": kernels.r_groups(F.col(smiles), text), "_ok": kernels.canonical(F.col(smiles)).isNotNull()})
    hit = F.col("groups").isNotNull()
    return (rows.where(hit).withColumn("core", F.lit(text)).drop("_ok"), rows.where(~hit & F.col("_ok")).drop("groups", "_ok"))
