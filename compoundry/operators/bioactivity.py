"""Bioactivity records: per-molecule aggregates, type summaries, property joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from compoundry.functions import units
from compoundry.functions.missing import text
from compoundry.functions.skew import join_stats


def molecule_key(c: Column) -> Column:
    return F.upper(text(c))


def mode_by_group(df: DataFrame, keys: list[str], value: str, order: str, name: str) -> DataFrame:
    """Most frequent non-empty text per group; the earliest seen wins a tie.

    Counts per (group, text) come first, so the second step sees distinct texts only.
    """
    seen = (df.where(text(F.col(value)) != "").groupBy(*keys, text(F.col(value)).alias("_t"))
            .agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first")))
    # Highest count, then earliest row: the smallest (-count, first row).
    best = F.min_by("_t", F.struct((-F.col("_n")).alias("n"), F.col("_first")))
    return seen.groupBy(*keys).agg(best.alias(name))


def aggregate_by_molecule(recs: DataFrame, numeric: dict[str, str], texts: list[str],
                          molecule: str = "molecule_id", order: str = "row_index") -> DataFrame:
    """One row per molecule: record count, numeric aggregates, most frequent texts.

    ``numeric`` maps a column to ``max`` (activity on the log scale and all others)
    or ``min`` (concentrations).
    """
    rows = recs.withColumn("_mol", molecule_key(F.col(molecule))).where(F.col("_mol") != "")
    pick = {"max": F.max, "min": F.min}
    out = rows.groupBy("_mol").agg(F.count(F.lit(1)).alias("bio_n"),
                                   *[pick[how](F.col(c).cast("double")).alias(c) for c, how in numeric.items()])
    for c in texts:
        modes = mode_by_group(rows, ["_mol"], c, order, c)
        out = out.join(modes, "_mol", "left").withColumn(c, F.coalesce(F.col(c), F.lit("")))
    return out.withColumnRenamed("_mol", molecule)


def activity_type_label(kind: Column, unit: Column) -> Column:
    k, u = text(kind), text(unit)
    return (F.when((k != "") & (u != ""), F.concat(k, F.lit(" ("), u, F.lit(")")))
            .when(k != "", k).otherwise("UNKNOWN"))


def activity_type_summary(recs: DataFrame, kind: Column, unit: Column, order: str, top_n: int = 12) -> DataFrame:
    """Most frequent activity types with count and percent; first seen wins a tie."""
    counts = recs.groupBy(activity_type_label(kind, unit).alias("key")).agg(
        F.count(F.lit(1)).alias("count"), F.min(order).alias("_first"))
    total = counts.agg(F.sum("count").alias("_total"))
    # The total is a single row.
    return (counts.crossJoin(F.broadcast(total))
            .withColumn("pct", 100.0 * F.col("count") / F.greatest(F.col("_total"), F.lit(1)))
            .orderBy(F.desc("count"), "_first", "key").limit(top_n).select("key", "count", "pct"))


def join_properties(left: DataFrame, props: DataFrame, left_id: str, prop_id: str) -> DataFrame:
    """Left join on the upper-cased trimmed id; expects one property row per id."""
    # An empty id is nobody's id; kept, it would meet every other row without one.
    right = props.withColumn("_k", molecule_key(F.col(prop_id))).drop(prop_id).where(F.col("_k") != "")
    joined = left.withColumn("_k", molecule_key(F.col(left_id))).join(right, "_k", "left")
    return joined.drop("_k")


def with_activity_counts(molecules: DataFrame, recs: DataFrame, mol_id: str, rec_id: str) -> DataFrame:
    """Number of activity records per molecule row, 0 where there are none."""
    counts = recs.groupBy(molecule_key(F.col(rec_id)).alias("_k")).agg(F.count(F.lit(1)).alias("bio_n"))
    keyed = molecules.withColumn("_k", molecule_key(F.col(mol_id)))
    joined = join_stats(keyed, counts, ["_k"], "bio_n")
    return joined.withColumn("bio_n", F.coalesce("bio_n", F.lit(0))).drop("_k")


# Property keys shown first.
PREFERRED_KEYS = ("full_mwt", "alogp", "psa", "hba", "hbd", "rtb", "qed_weighted")


def property_keys(df: DataFrame, props: str) -> DataFrame:
    """Distinct keys of a map column, sorted by name."""
    return (df.select(F.explode(F.map_keys(props)).alias("key")).where(text(F.col("key")) != "")
            .distinct().orderBy("key"))


def ordered_property_keys(df: DataFrame, props: str, max_keys: int | None = None) -> DataFrame:
    """Preferred keys first, then by name, with their position."""
    rank = F.array_position(F.array(*[F.lit(k) for k in PREFERRED_KEYS]), F.col("key"))
    keys = property_keys(df, props).withColumn("_p", F.when(rank > 0, rank).otherwise(99))
    # Distinct keys of a property map: a handful of names, not data rows.
    pos = F.row_number().over(Window.orderBy("_p", "key"))
    listed = keys.orderBy("_p", "key")
    return (listed if max_keys is None else listed.limit(max_keys)).withColumn("position", pos).select("position", "key")


def dedupe_molecules(rows: DataFrame, mol_id: str, smiles: str, order: str) -> DataFrame:
    """One row per molecule; the first non-empty structure text wins."""
    has = text(F.col(smiles)) != ""
    first = F.min_by(F.when(has, F.col(smiles)), F.when(has, F.col(order)))
    return rows.where(text(F.col(mol_id)) != "").groupBy(F.col(mol_id)).agg(
        F.coalesce(first, F.lit("")).alias(smiles), F.min(order).alias("first_row"))


def select_assays(rows: DataFrame, assay_id: str, confidence: str, kind: str, order: str,
                  min_confidence: int = 7, assay_type: str | None = None) -> DataFrame:
    """Assays with sufficient confidence (unknown passes), first row per assay."""
    ok = F.col(confidence).isNull() | (F.col(confidence) >= min_confidence)
    if assay_type:
        ok = ok & (F.upper(text(F.col(kind))) == assay_type.strip().upper())
    keep = [c for c in rows.columns if c != assay_id]
    return rows.where(ok).groupBy(assay_id).agg(F.min_by(F.struct(*keep), order).alias("_f")).select(assay_id, "_f.*")


def with_ic50_nm(df: DataFrame, value: str = "standard_value", unit: str = "standard_units") -> DataFrame:
    return df.withColumn("IC50_nM", units.to_nanomolar(F.col(value), F.col(unit)))


def with_scored_activity(df: DataFrame, value: str = "pchembl_value") -> DataFrame:
    """Numeric log activity; rows without one are dropped."""
    number = F.col(value).try_cast("double")
    return df.withColumn(value, number).where(number.isNotNull() & ~F.isnan(number))


def rank_targets(targets: DataFrame, query_text: str, order: str = "row_index", limit: int = 25) -> DataFrame:
    """First row per target, best match to the search text first.

    Expects target_id, pref_name, organism, target_type, aliases (array), score and the
    service order.  Exact matches beat whole words, those beat substrings; at each level
    a single protein goes first; species, score and service order break ties.
    """
    import re

    squeeze = lambda c: F.regexp_replace(F.lower(text(c)), r"\s+", " ")
    q = re.sub(r"\s+", " ", query_text.strip().lower())
    word = r"\b" + re.escape(q) + r"\b"
    keep = [c for c in targets.columns if c != "target_id"]
    rows = (targets.where(text(F.col("target_id")) != "").groupBy("target_id")
            .agg(F.min_by(F.struct(*keep), order).alias("_f")).select("target_id", "_f.*"))
    name, alias = squeeze(F.col("pref_name")), F.transform("aliases", squeeze)
    single = squeeze(F.col("target_type")) == "single protein"
    by_name = [name == q, name.rlike(word), name.contains(q)]
    by_alias = [F.array_contains(alias, q), F.exists(alias, lambda a: a.rlike(word)),
                F.exists(alias, lambda a: a.contains(q))]
    levels = [squeeze(F.col("target_id")) == q, by_name[0], by_alias[0] & single, by_alias[0]]
    for n, a in zip(by_name[1:], by_alias[1:]):
        levels += [n & single, a & single, n, a]
    levels += [single, squeeze(F.col("organism")) == "homo sapiens", F.coalesce(F.col("score"), F.lit(0.0))]
    return rows.orderBy(*[F.coalesce(x.cast("double"), F.lit(0.0)).desc() for x in levels], order).limit(limit)
