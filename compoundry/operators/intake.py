"""Import gate: duplicate annotation and accept / reject decisions of parsed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compoundry.functions.missing import text
from compoundry.functions.skew import with_group_rank
from compoundry.operators.rules import metric_rows


def annotate_import(df: DataFrame, key: str, ok: str, error: str, row_index: str = "row_index",
                    reject_duplicates: bool = False, key_label: str = "inchikey",
                    flag_duplicates: bool = True) -> DataFrame:
    """Duplicate count and position per structure key, acceptance and its reason.

    Failed rows are rejected with their error.  Rows without a key are their own
    group.  Repeats stay accepted unless ``reject_duplicates``.
    """
    failed_reason = F.when(text(F.col(error)) == "", "failed").otherwise(F.col(error))
    if not flag_duplicates:
        return df.withColumns({"accepted": F.col(ok), "rejection_reason": F.when(F.col(ok), "").otherwise(failed_reason)})
    grouped = F.col(ok) & (text(F.col(key)) != "")
    loose = df.where(~F.coalesce(grouped, F.lit(False))).withColumns(
        {"duplicate_count": F.lit(1).cast("bigint"), "duplicate_group_index": F.lit(1).cast("bigint")})
    ranked = with_group_rank(df.where(grouped), [key], row_index, "duplicate_group_index", "duplicate_count")
    rows = ranked.select(*df.columns, "duplicate_count", "duplicate_group_index").unionByName(
        loose.select(*df.columns, "duplicate_count", "duplicate_group_index"))
    repeat = F.lit(reject_duplicates) & F.col(ok) & (F.col("duplicate_group_index") > 1)
    dup = F.col(ok) & (F.col("duplicate_count") > 1)
    return rows.withColumns({
        "duplicate_key": F.when(F.col(ok), text(F.col(key))).otherwise(""),
        "duplicate_warning": F.when(dup, F.concat(
            F.lit("Duplicate structure "), F.col("duplicate_group_index").cast("string"), F.lit("/"),
            F.col("duplicate_count").cast("string"), F.lit(f" by {key_label}."))).otherwise(""),
        "accepted": F.col(ok) & ~repeat,
        "rejection_reason": F.when(~F.col(ok), failed_reason).when(repeat, "duplicate_structure").otherwise(""),
        "status": F.when(~F.col(ok), "failed").when(repeat, "duplicate_rejected").otherwise("ok"),
        "qc_flags": F.when(dup, "duplicate_structure").otherwise(""),
    })


def import_summary(rows: DataFrame, key: str = "duplicate_key", ok: str = "ok") -> DataFrame:
    """One row of counts, from per-key counts."""
    dup = F.col(ok) & (F.col("duplicate_count") > 1)
    per_key = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("n_ok"), F.count_if("accepted").alias("n_acc"),
        F.count_if(dup).alias("n_dup"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return per_key.agg(
        total("n").alias("total_records"), total("n_ok").alias("valid_records"),
        total(F.col("n") - F.col("n_ok")).alias("failed_records"), total("n_acc").alias("accepted_records"),
        total(F.col("n") - F.col("n_acc")).alias("rejected_records"),
        F.count_if((F.col("n_dup") > 0) & (F.col(key) != "")).alias("duplicate_groups"),
        total("n_dup").alias("duplicate_records"))


# Descriptions of the import metrics.
IMPORT_METRICS = {
    "total_records": "All input records.", "valid_records": "Records with a readable structure.",
    "failed_records": "Records without a readable structure.", "accepted_records": "Records passed on.",
    "rejected_records": "Records held back.", "duplicate_groups": "Structure keys with repeats.",
    "duplicate_records": "Records belonging to duplicate groups."}


def import_summary_rows(summary: DataFrame) -> DataFrame:
    return metric_rows(summary, IMPORT_METRICS)


def stage_summary_from_import(summary: DataFrame) -> DataFrame:
    """Stage status, blockers and next step from the import counts (one row)."""
    acc, rej, fail, dup = (F.col(c) for c in
                           ("accepted_records", "rejected_records", "failed_records", "duplicate_records"))
    return summary.select(
        F.lit("import").alias("stage"),
        F.when((acc > 0) & (rej == 0) & (fail == 0), "accepted").when(acc > 0, "needs_review").otherwise("blocked").alias("status"),
        "total_records", "accepted_records", "rejected_records", "failed_records",
        F.when(dup > 0, F.concat(dup.cast("string"), F.lit(" duplicate record(s) detected"))).otherwise("").alias("warnings"),
        F.when(acc > 0, "").otherwise("No valid accepted molecules").alias("blockers"),
        F.when(acc > 0, "Molecule QC Dashboard").otherwise("Fix input file or SMILES column").alias("recommended_next_step"))


def stage_summary_from_qc(summary: DataFrame, review_needs_clean: bool = False) -> DataFrame:
    """Stage status from QC counts total / clean / invalid / errors / warnings (one row).

    Without a clean record a stage with problem records needs review; with ``review_needs_clean`` it is blocked.
    """
    total, clean, invalid, errors, warn = (F.col(c) for c in ("total", "clean", "invalid", "errors", "warnings"))
    problem = F.greatest(F.lit(0), total - clean - invalid - errors)
    return summary.select(
        F.lit("qc").alias("stage"),
        F.when((clean == total) & (total > 0), "clean")
        .when((clean > 0) | ((problem > 0) & F.lit(not review_needs_clean)), "needs_review")
        .otherwise("blocked").alias("status"),
        total.alias("total_records"), (clean + problem).alias("accepted_records"), clean.alias("clean_records"),
        problem.alias("problem_records"), (invalid + errors).alias("rejected_records"),
        F.when(warn > 0, F.concat(warn.cast("string"), F.lit(" warning-level issue(s)"))).otherwise("").alias("warnings"),
        F.when(clean > 0, "").otherwise("No clean molecules available for QSAR-ready standardization").alias("blockers"),
        F.when(clean > 0, "Mol Standardizer with QSAR-ready profile").otherwise("Inspect Problem/Rejected outputs")
        .alias("recommended_next_step"))


# Standardisation profiles by later use.
QSAR_PROFILES = ("qsar_ready", "chembl_like")
DOCKING_PROFILES = ("docking_ready",)


def stage_summary_from_standardization(rows: DataFrame, profile: str, ok: str = "ok") -> DataFrame:
    good = F.col("accepted_records") > 0
    qsar, dock = F.lit(profile in QSAR_PROFILES), F.lit(profile in DOCKING_PROFILES)
    base = rows.agg(F.count(F.lit(1)).alias("total_records"), F.count_if(ok).alias("accepted_records"))
    return base.select(
        F.lit("standardization").alias("stage"),
        F.when(good & qsar, "qsar_ready").when(good & dock, "docking_ready").when(good, "standardized")
        .otherwise("blocked").alias("status"),
        "total_records", "accepted_records",
        (F.col("total_records") - F.col("accepted_records")).alias("failed_records"),
        F.when(qsar, F.col("accepted_records")).otherwise(0).alias("qsar_ready_records"),
        F.when(dock, F.col("accepted_records")).otherwise(0).alias("docking_ready_records"),
        F.when(good, "").otherwise("No molecules standardized successfully").alias("blockers"),
        F.when(good & qsar, "Descriptors / Fingerprints → QSAR Studio").when(good & dock, "Docking/pose workflow")
        .when(good, "Choose QSAR-ready profile for QSAR workflows")
        .otherwise("Inspect Standardization Report and failed molecules").alias("recommended_next_step"))


def with_standardization_stage(df: DataFrame, status: str, profile: str) -> DataFrame:
    """Curation fields of standardised rows by status and profile."""
    ok = F.lower(F.trim(F.coalesce(F.col(status), F.lit("")))) == "ok"
    qsar, dock = profile in QSAR_PROFILES, profile in DOCKING_PROFILES
    # Stage status, warning and next-step texts.
    good = "QSAR-ready" if qsar else "Docking-ready" if dock else "Standardized"
    step = ("Descriptors / Fingerprints → QSAR Studio" if qsar else "Docking/pose workflow" if dock
            else "Use QSAR-ready profile for QSAR workflows")
    pick = lambda yes, no: F.when(ok, F.lit(yes)).otherwise(F.lit(no))
    return df.withColumns({
        "curation_status": pick(good, "Blocked"), "curation_ready_for_qsar": pick(qsar, False),
        "curation_ready_for_docking": pick(dock and not qsar, False), "curation_blockers": pick("", "Standardization failed"),
        "curation_warnings": pick("" if qsar or dock else "Profile is not marked as QSAR-ready", ""),
        "curation_recommended_next_step": pick(step, "Inspect Standardization Report")})
