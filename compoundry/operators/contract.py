"""Provenance columns that travel with every molecule row, and their audit view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from compoundry.functions import texts
from compoundry.functions.missing import text
from compoundry.operators.rules import metric_rows

# Column names of the shared row contract.
STRUCTURE_FIELDS = ("SMILES", "input_smiles", "canonical_smiles", "standardized_smiles",
                    "SMILES_STD", "SMILES_ORIG", "INPUT_SMILES")
IDENTIFIER_FIELDS = ("mol_id", "Name", "id", "ID", "compound_id", "molecule_id", "inchikey", "inchi")
PROVENANCE_FIELDS = (
    "qc_status", "qc_severity", "qc_issue_codes", "qc_issues", "qc_n_issues", "qc_duplicate_key",
    "qc_duplicate_count", "qc_version", "standardization_status", "standardization_profile",
    "standardization_changed", "standardization_log", "standardization_input_smiles",
    "standardization_output_smiles", "standardization_version", "source_format", "source_row_index",
    "row_id", "transform_log", "dropped_reason", "qc_flags", "curation_stage", "curation_status",
    "curation_ready_for_qsar", "curation_ready_for_docking", "curation_blockers", "curation_warnings",
    "curation_recommended_next_step", "curation_version", "IMPORT_SOURCE_FORMAT", "IMPORT_ROW_INDEX",
    "IMPORT_WARNINGS", "STD_LOG", "STD_PROFILE", "STD_OK", "STD_INPUT_SMILES", "STD_OUTPUT_SMILES",
    "STD_CHANGED", "STD_STEPS",
)
META_FIELDS = STRUCTURE_FIELDS + IDENTIFIER_FIELDS + PROVENANCE_FIELDS


def is_meta_field(name: str) -> bool:
    low = name.strip().lower()
    return low in {f.lower() for f in META_FIELDS} or low.endswith(("_smiles", "_status"))


def _or(*cols: Column) -> Column:
    """First non-empty text."""
    return F.coalesce(*[F.when(text(c) != "", c.cast("string")) for c in cols], F.lit(""))


def fill_contract(df: DataFrame, source_format: str, row_index: str, smiles: str,
                  canonical: str | None = None, mol_id: str | None = None, name: str | None = None) -> DataFrame:
    """Fill the contract columns that are absent; existing values are kept."""
    have = set(df.columns)
    old = lambda c: F.col(c) if c in have else F.lit(None)
    canon = _or(old("canonical_smiles"), old("SMILES"), F.col(canonical) if canonical else F.col(smiles))
    given = _or(F.col(smiles), old("input_smiles"), canon)
    position = F.coalesce(old("source_row_index").cast("bigint"), F.col(row_index).cast("bigint"))
    ident = _or(F.col(mol_id) if mol_id else F.lit(None), old("mol_id"), old("compound_id"), old("molecule_id"),
                F.col(name) if name else F.lit(None), old("inchikey"),
                F.concat(F.lit("mol_"), F.col(row_index).cast("string")))
    fmt = _or(F.lit(source_format), old("source_format"), old("IMPORT_SOURCE_FORMAT"))
    return df.withColumns({
        "mol_id": _or(old("mol_id"), ident), "input_smiles": _or(old("input_smiles"), given),
        "canonical_smiles": canon, "source_format": fmt, "source_row_index": position,
        "row_id": _or(old("row_id"), texts.row_id(fmt, position, ident, given)),
        "transform_log": text(old("transform_log")), "qc_flags": text(old("qc_flags")),
        "dropped_reason": text(old("dropped_reason")),
    })


def add_step(df: DataFrame, step: str) -> DataFrame:
    return df.withColumn("transform_log", texts.append_step(F.col("transform_log"), F.lit(step)))


def add_flag(df: DataFrame, flag: Column) -> DataFrame:
    return df.withColumn("qc_flags", texts.append_token(F.col("qc_flags"), flag))


def set_dropped(df: DataFrame, reason: Column) -> DataFrame:
    return df.withColumn("dropped_reason", F.when(text(reason) != "", text(reason)).otherwise(F.col("dropped_reason")))


def annotate_stage(df: DataFrame, stage: str, status: Column, ready_for_qsar: Column, ready_for_docking: Column,
                   blockers: Column, warnings: Column, next_step: Column) -> DataFrame:
    """Curation stage columns; a blocked row with blockers is marked as dropped."""
    out = df.withColumns({
        "curation_stage": F.lit(stage), "curation_status": status, "curation_ready_for_qsar": ready_for_qsar,
        "curation_ready_for_docking": ready_for_docking, "curation_blockers": blockers,
        "curation_warnings": warnings, "curation_recommended_next_step": next_step})
    out = add_step(out, f"curation_{stage}")
    return set_dropped(out, F.when((F.lower(F.trim(status)) == "blocked") & (text(blockers) != ""), blockers))


def issue_counts(df: DataFrame, codes: str, sep: str = ";") -> DataFrame:
    """How often each issue code occurs in a separated text column."""
    code = F.explode(F.split(F.col(codes), sep)).alias("code")
    return df.where(text(F.col(codes)) != "").select(code).groupBy("code").agg(F.count(F.lit(1)).alias("count"))


def audit_view(df: DataFrame) -> DataFrame:
    """Audit columns of a table; ``source_``-prefixed columns stand in for absent ones."""
    have = set(df.columns)
    direct = ("row_id", "transform_log", "qc_flags", "dropped_reason")
    fallback = {"row_id": ("source_row_id", "source_row_ids"),
                "transform_log": ("source_transform_log", "source_transform_logs"),
                "qc_flags": ("source_qc_flags", "source_qc_flags_all"),
                "dropped_reason": ("source_dropped_reason", "source_dropped_reasons")}
    value = lambda c: text(F.col(c)) if c in have else F.lit("")
    sets = [{c: value(c) for c in direct}] + [{c: value(fallback[c][i]) for c in direct} for i in (0, 1)]
    any_of = lambda s: F.concat(*s.values()) != ""
    pick = {c: F.when(any_of(sets[0]), sets[0][c]).when(any_of(sets[1]), sets[1][c]).otherwise(sets[2][c])
            for c in direct}
    keep = [c for c in df.columns if c not in direct]
    out = df.select(*keep, *[e.alias(c) for c, e in pick.items()])
    steps = F.filter(F.split("transform_log", r"\|"), lambda x: x != "")
    dropped = F.col("dropped_reason") != ""
    return out.withColumns({
        "dropped": dropped, "flagged": (F.col("qc_flags") != "") | dropped,
        "provenance_missing": (F.col("row_id") == "") & (F.col("transform_log") == ""),
        "n_steps": F.size(steps)})


def audit_filter(view: DataFrame, mode: str = "all", token: str = "") -> DataFrame:
    """Audit modes all / flagged / dropped / missing_provenance plus a text search."""
    modes = {"flagged": F.col("flagged"), "dropped": F.col("dropped"),
             "missing_provenance": F.col("provenance_missing")}
    out = view.where(modes[mode]) if mode in modes else view
    needle = token.strip().lower()
    if needle:
        blob = F.lower(F.concat_ws(" ", "row_id", "transform_log", "qc_flags", "dropped_reason"))
        out = out.where(blob.contains(needle))
    return out


def audit_summary(view: DataFrame, filtered: DataFrame, order: str) -> DataFrame:
    """metric, value, description rows incl. the number of steps and the top step."""
    step = F.explode(F.filter(F.split("transform_log", r"\|"), lambda x: x != "")).alias("step")
    steps = view.select(step, order).groupBy("step").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("f"))
    best = F.min_by("step", F.struct((-F.col("n")).alias("n"), F.col("f"), F.col("step")))
    top = steps.agg(F.count(F.lit(1)).alias("unique_transform_steps"),
                    F.coalesce(best, F.lit("")).alias("top_transform_step"))
    base = view.agg(F.count(F.lit(1)).alias("total_rows"), F.count_if("flagged").alias("flagged_rows"),
                    F.count_if("dropped").alias("dropped_rows"),
                    F.count_if("provenance_missing").alias("missing_provenance_rows"))
    shown = filtered.agg(F.count(F.lit(1)).alias("filtered_rows"))
    # Descriptions of the audit metrics.  Each side is one row.
    return metric_rows(base.crossJoin(shown).crossJoin(top), {
        "total_rows": "Rows available on input.",
        "flagged_rows": "Rows with qc_flags or dropped_reason.",
        "dropped_rows": "Rows with a dropped_reason.",
        "missing_provenance_rows": "Rows missing both row_id and transform_log.",
        "filtered_rows": "Rows visible after the current filter.",
        "unique_transform_steps": "Distinct transform steps found in transform_log.",
        "top_transform_step": "Most frequent transform_log step."}, "string")
