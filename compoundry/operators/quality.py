"""Molecule quality control on structure facts: issues, severity, partitions, counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from compoundry.functions.skew import join_stats
from compoundry.operators.rules import metric_rows


@dataclass(frozen=True)
class QualityConfig:
    max_weight: float = 900.0
    min_heavy_atoms: int = 3
    max_heavy_atoms: int = 90
    max_fragments: int = 1


def issue_rules(cfg: QualityConfig) -> list[tuple[Column, str, Column]]:
    """(condition, code, message) in report order, over the fact columns."""
    c, s = F.col, lambda name: F.col(name).cast("string")
    # Issue codes with their messages.
    return [
        (c("parse_warnings") != "", "PARSE_WARNING", F.lit("RDKit parse/sanitize warning present.")),
        (c("n_fragments") > cfg.max_fragments, "MULTI_FRAGMENT",
         F.concat(F.lit("Molecule has "), s("n_fragments"), F.lit(" disconnected fragments."))),
        (c("has_metal"), "METAL_PRESENT",
         F.lit("Molecule contains metal/metalloid atoms that may require special handling.")),
        (c("has_isotope"), "ISOTOPE_PRESENT", F.lit("Molecule contains isotope labels.")),
        (c("has_radical"), "RADICAL_PRESENT", F.lit("Molecule contains radical electrons.")),
        (c("formal_charge") != 0, "NET_FORMAL_CHARGE",
         F.concat(F.lit("Net formal charge is "), s("formal_charge"), F.lit("."))),
        (c("heavy_atoms") < cfg.min_heavy_atoms, "TOO_SMALL",
         F.lit(f"Heavy atom count is below {cfg.min_heavy_atoms}.")),
        (c("heavy_atoms") > cfg.max_heavy_atoms, "TOO_LARGE",
         F.lit(f"Heavy atom count is above {cfg.max_heavy_atoms}.")),
        (c("molecular_weight") > cfg.max_weight, "HIGH_MOLECULAR_WEIGHT",
         F.lit(f"Molecular weight is above {cfg.max_weight:.1f} Da.")),
        (c("molecular_weight").isNull(), "MOLECULAR_WEIGHT_COMPUTATION_FAILED", F.lit("The molecular weight is unknown.")),
        (c("unassigned_chiral_centers") > 0, "UNASSIGNED_CHIRAL_STEREO",
         F.concat(s("unassigned_chiral_centers"),
                  F.lit(" possible chiral center(s) have unspecified configuration."))),
        (c("unassigned_double_bond_stereo") > 0, "UNASSIGNED_DOUBLE_BOND_STEREO",
         F.concat(s("unassigned_double_bond_stereo"),
                  F.lit(" possible double bond stereo center(s) are unspecified."))),
        (c("unassigned_chiral_centers").isNull() | c("unassigned_double_bond_stereo").isNull(), "STEREO_COMPUTATION_FAILED",
         F.lit("The unassigned stereo centers are unknown.")),
    ]


# Facts that a table may lack as a column; their rule then never fires. A column with a null for a row
# means that the fact could not be computed there, which is an issue of its own.
FACT_DEFAULTS = {
    "parse_warnings": "", "n_fragments": 1, "has_metal": False, "has_isotope": False, "has_radical": False,
    "formal_charge": 0, "heavy_atoms": 3, "molecular_weight": 0.0, "unassigned_chiral_centers": 0,
    "unassigned_double_bond_stereo": 0}


def quality_control(facts: DataFrame, cfg: QualityConfig = QualityConfig(), ok: str = "ok_parse",
                    key: str = "duplicate_key", error: str = "parse_error") -> DataFrame:
    """Issue codes, messages, severity and status per molecule, with duplicate groups."""
    for name, default in FACT_DEFAULTS.items():
        if name not in facts.columns:
            facts = facts.withColumn(name, F.lit(default))
    keyed = facts.withColumn("_k", F.when(F.col(ok) & (F.col(key) != ""), F.col(key)))
    counts = keyed.where(F.col("_k").isNotNull()).groupBy("_k").agg(F.count(F.lit(1)).alias("duplicate_count"))
    rows = join_stats(keyed, counts, ["_k"], "duplicate_count").drop("_k")
    rows = rows.withColumn("duplicate_count", F.coalesce("duplicate_count", F.lit(1)).cast("bigint"))
    dup = F.concat(F.lit("Duplicate group contains "), F.col("duplicate_count").cast("string"), F.lit(" records."))
    found = [(F.col(ok) & F.coalesce(cond, F.lit(False)), code, msg) for cond, code, msg in issue_rules(cfg)]
    found.append((F.col("duplicate_count") > 1, "DUPLICATE_STRUCTURE", dup))
    invalid = (~F.col(ok), "INVALID_STRUCTURE",
               F.when(F.col(error) == "", "Invalid or missing molecular structure.").otherwise(F.col(error)))
    issues = F.array_compact(F.array(*[
        F.when(cond, F.struct(F.lit(code).alias("code"), msg.alias("text"))) for cond, code, msg in [invalid] + found]))
    rows = rows.withColumn("_issues", issues)
    n = F.size("_issues")
    codes = F.transform("_issues", lambda i: i["code"])
    flags = F.array_join(F.transform(codes, lambda x: F.lower(x)), " | ")
    return rows.withColumns({
        "issue_codes": F.array_join(codes, ";"),
        "issues": F.array_join(F.transform("_issues", lambda i: i["text"]), " | "),
        "n_issues": n,
        "severity": F.when(~F.col(ok), "ERROR").when(n > 0, "WARNING").otherwise("OK"),
        "status": F.when(~F.col(ok), "Invalid").when(n > 0, "Needs review").otherwise("Clean"),
        "qc_flags": flags,
        "dropped_reason": F.when(~F.col(ok), F.lower(F.col("_issues")[0]["code"])).otherwise(""),
    }).drop("_issues")


def partition(qc: DataFrame, which: str) -> DataFrame:
    """clean / problem / rejected view of a QC table."""
    severity = {"clean": "OK", "problem": "WARNING", "rejected": "ERROR"}[which]
    return qc.where(F.col("severity") == severity)


def quality_summary(qc: DataFrame, ok: str = "ok_parse", key: str = "duplicate_key") -> DataFrame:
    """One row of counts."""
    groups = qc.where((F.col("duplicate_count") > 1) & F.col(ok)).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    dup = groups.agg(F.count(F.lit(1)).alias("duplicate_groups"),
                     F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_records"))
    sev = F.col("severity")
    base = qc.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(sev == "OK").alias("clean"),
        F.count_if(sev != "OK").alias("problem"), F.count_if(~F.col(ok)).alias("invalid"),
        F.count_if(sev == "WARNING").alias("warnings"), F.count_if(sev == "ERROR").alias("errors"))
    return base.crossJoin(dup)


# QC metric names with their descriptions.
QUALITY_METRICS = {
    "total": ("total_records", "All input records."),
    "clean": ("clean_records", "Records without QC issues."),
    "problem": ("problem_records", "Records requiring review."),
    "invalid": ("invalid_records", "Records that could not be parsed."),
    "warnings": ("warning_records", "Records with warning-level issues."),
    "errors": ("error_records", "Records with error-level issues."),
    "duplicate_groups": ("duplicate_groups", "Duplicate groups by selected duplicate key."),
    "duplicate_records": ("duplicate_records", "Records belonging to duplicate groups."),
}


def quality_summary_rows(qc: DataFrame) -> DataFrame:
    """metric, value, description rows including one per issue code."""
    from compoundry.operators.contract import issue_counts

    one = quality_summary(qc).select(*[F.col(c).alias(n) for c, (n, _) in QUALITY_METRICS.items()])
    base = metric_rows(one, {n: d for n, d in QUALITY_METRICS.values()})
    issues = issue_counts(qc, "issue_codes").select(
        F.concat(F.lit("issue_"), "code").alias("metric"), F.col("count").alias("value"),
        F.concat(F.lit("Records/issues flagged as "), "code", F.lit(".")).alias("description"))
    return base.unionAll(issues)
