"""Drug-likeness rules, scores and selections over molecule property columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def lipinski_violations(mw: float = 500, logp: float = 5, hbd: float = 5, hba: float = 10) -> Column:
    parts = [c("molecular_weight") > mw, c("logp") > logp, c("hbd") > hbd, c("hba") > hba]
    return sum((F.coalesce(p, F.lit(False)).cast("int") for p in parts), F.lit(0))


def veber_pass(rotb: float = 10, tpsa: float = 140) -> Column:
    return (c("rotatable_bonds") <= rotb) & (c("tpsa") <= tpsa)


def ghose_pass() -> Column:
    return (c("molecular_weight").between(160.0, 480.0) & c("logp").between(-0.4, 5.6)
            & c("molar_refractivity").between(40.0, 130.0) & c("heavy_atom_count").between(20.0, 70.0))


def egan_pass() -> Column:
    return (c("logp") <= 5.88) & (c("tpsa") <= 131.6)


def muegge_pass() -> Column:
    return (c("molecular_weight").between(200.0, 600.0) & c("logp").between(-2.0, 5.0)
            & (c("tpsa") <= 150.0) & (c("hbd") <= 5.0) & (c("hba") <= 10.0)
            & (c("rotatable_bonds") <= 15.0) & c("ring_count").between(1.0, 7.0)
            & (c("heavy_atom_count") >= 10.0))


def drug_score(qed: Column, violations: Column, pains: Column, veber: Column, reactive: Column) -> Column:
    """Drug-likeness less the penalties, never below zero; a missing start counts as zero."""
    start = F.coalesce(F.nanvl(qed, F.lit(0.0)), F.lit(0.0))
    penalty = lambda cond, by: F.when(cond, by).otherwise(0.0)
    return F.greatest(start - penalty(violations > 1, 0.2) - penalty(pains, 0.3)
                      - penalty(~veber, 0.1) - penalty(reactive, 0.2), F.lit(0.0))


def criteria_pass(rule: str, violations: Column, veber: Column) -> Column:
    checks = {"Lipinski": violations <= 1, "Veber": veber, "Lipinski + Veber": (violations <= 1) & veber}
    return checks.get((rule or "None").strip(), F.lit(True))


def select_by_criteria(df: DataFrame, passed: Column, mode: str = "Forward All Molecules") -> DataFrame:
    mode = (mode or "").strip()
    if mode == "Within Criteria":
        return df.where(passed)
    if mode == "Out of Criteria":
        return df.where(~passed)
    return df


def with_rules(df: DataFrame) -> DataFrame:
    """All rule outcomes of a property table, in one projection."""
    return df.withColumns({
        "lipinski_violations": lipinski_violations(), "lipinski_pass": lipinski_violations() <= 1,
        "veber_pass": veber_pass(), "ghose_pass": ghose_pass(),
        "egan_pass": egan_pass(), "muegge_pass": muegge_pass()})


RULES = ("lipinski_pass", "veber_pass", "ghose_pass", "egan_pass", "muegge_pass")


def flagged(df: DataFrame) -> DataFrame:
    """Rows that fail a rule, match an alert or are not valid molecules."""
    bad = F.lit(False)
    for r in RULES:
        bad = bad | ~F.coalesce(c(r), F.lit(False))
    for alert in ("pains_match", "brenk_match"):
        if alert in df.columns:
            bad = bad | F.coalesce(c(alert), F.lit(False))
    if "valid_molecule" in df.columns:
        bad = bad | ~c("valid_molecule")
    return df.where(bad)


def simple_filter(df: DataFrame, max_logp: float = 5.0, max_mw: float = 500.0) -> DataFrame:
    return df.where((c("logp") <= max_logp) & (c("molecular_weight") <= max_mw))


def rule_summary(df: DataFrame) -> DataFrame:
    """metric, value, description rows of the rule outcomes (one pass, then unpivot)."""
    # Metric names with their descriptions.
    metrics = {
        "n_rows": (F.count(F.lit(1)), "All input rows."),
        "n_valid_molecules": (F.count_if(c("valid_molecule")) if "valid_molecule" in df.columns
                              else F.count(F.lit(1)), "Rows with a valid parsed molecule."),
        "n_invalid_molecules": (F.count_if(~c("valid_molecule")) if "valid_molecule" in df.columns
                                else F.count_if(F.lit(False)), "Rows that could not be parsed as molecules."),
        "n_lipinski_pass": (F.count_if(c("lipinski_pass")), "Valid molecules passing Lipinski rule-of-five."),
        "n_veber_pass": (F.count_if(c("veber_pass")), "Valid molecules passing Veber rule."),
        "n_ghose_pass": (F.count_if(c("ghose_pass")), "Valid molecules passing Ghose filter."),
        "n_egan_pass": (F.count_if(c("egan_pass")), "Valid molecules passing Egan filter."),
        "n_muegge_pass": (F.count_if(c("muegge_pass")), "Valid molecules passing Muegge filter."),
        "n_pains_matches": (F.count_if(c("pains_match")), "Valid molecules matching at least one PAINS alert."),
        "n_brenk_matches": (F.count_if(c("brenk_match")), "Valid molecules matching at least one Brenk alert."),
    }
    return metric_rows(df.agg(*[e.alias(n) for n, (e, _) in metrics.items()]),
                       {n: d for n, (_, d) in metrics.items()})


def metric_rows(one_row: DataFrame, descriptions: dict[str, str], value_type: str = "bigint") -> DataFrame:
    """Turn a one-row aggregate into (metric, value, description) rows."""
    items = F.explode(F.array(*[
        F.struct(F.lit(n).alias("metric"), F.col(n).cast(value_type).alias("value"), F.lit(d).alias("description"))
        for n, d in descriptions.items()])).alias("m")
    return one_row.select(items).select("m.*")
