import math

import pytest
from pyspark.sql import functions as F

from compoundry.operators import binding, bioactivity, contract, curation, intake, profile, quality, validation
from compoundry.operators.curation import CurationConfig

SCHEMA = "row_index int, compound_id string, canonical_smiles string, standard_type string, standard_relation string, standard_value double, standard_units string"
ROWS = [
    (0, "A", "CCO", "IC50", "=", 100.0, "nM"), (1, "A", "CCO", "IC50", "=", 200.0, "nM"),
    (2, "B", "CCC", "IC50", ">", 50.0, "nM"), (3, "C", "CCN", "Ki", "=", 10.0, "nM"), (4, "D", "c1ccccc1", "IC50", "=", 5.0, "mg/mL")]


def config(**kw):
    return CurationConfig(smiles="canonical_smiles", activity="standard_value", name="compound_id", unit="standard_units",
                          relation="standard_relation", endpoint="standard_type", target_endpoint="IC50", **kw)


def test_measurements_to_compounds(spark):
    res = curation.curate(spark.createDataFrame(ROWS, SCHEMA), config())
    s = res.summary.first()
    assert (s["input_records"], s["prepared_compounds"], s["duplicate_groups"], s["rejected_records"]) == (5, 1, 1, 3)
    row = res.prepared.first()
    assert row["n_measurements"] == 2 and 6.6 < row["pActivity"] < 7.1 and row["duplicate_group"]
    reasons = {r["compound_id"]: r["reject_reasons"] for r in res.rejected.collect()}
    assert reasons == {"B": "non_exact_relation", "C": "endpoint_not_selected", "D": "unsupported_or_missing_unit"}
    assert res.report.where("accepted_before_aggregation").count() == 2


def test_inequalities_allowed(spark):
    res = curation.curate(spark.createDataFrame(ROWS, SCHEMA), config(relation_policy="allow_inequalities"))
    assert res.prepared.count() == 2


@pytest.mark.parametrize("method,want", [("mean", 6.8494850), ("min", 6.6989700), ("max", 7.0), ("first", 7.0), ("median", 6.8494850)])
def test_aggregation_methods(spark, method, want):
    res = curation.curate(spark.createDataFrame(ROWS, SCHEMA), config(aggregation=method))
    assert res.prepared.first()["pActivity"] == pytest.approx(want, abs=1e-6)


def test_provenance_is_folded_in_first_seen_order(spark):
    rows = [(0, "x", 1.0, "r2", "import | qc", "a"), (1, "x", 2.0, "r1", "import", "b | a"), (2, "x", 4.0, "r2", "import | qc", "")]
    df = spark.createDataFrame(rows, "row_index int, smi string, ic50 double, row_id string, transform_log string, qc_flags string")
    row = curation.curate(df, CurationConfig(smiles="smi", activity="ic50")).prepared.first()
    assert row["source_row_ids"] == "r2;r1" and row["source_transform_logs"] == "import | qc || import"
    assert row["source_qc_flags_all"] == "a | b" and row["source_dropped_reasons"] == "" and row["n_measurements"] == 3


def test_column_binding(spark):
    df = spark.createDataFrame(
        [(i, f"C{i}", ["CCO(C)", "c1ccccc1", "CC(=O)O"][i % 3], "IC50", "=", str(10.0 + i), "nM") for i in range(12)],
        "row_index int, compound string, struct_text string, kind string, rel string, reading string, u string")
    got = binding.bind_columns(df, "row_index")
    assert got["smiles"] == "struct_text" and got["unit"] == "u" and got["relation"] == "rel" and got["activity"] == "reading"
    assert got["smiles_method"] == "content" and got["suggested_unit"] == "nM"
    assert binding.detect_column(["My Units", "x"], ("units",)) == "My Units"


def test_bioactivity_aggregate(spark):
    rows = [(0, " m1", 120.0, 6.5, "="), (1, "M1 ", 80.0, 7.0, "<"), (2, "", 1.0, 1.0, "=")]
    df = spark.createDataFrame(rows, "row_index int, molecule_id string, standard_value double, pChEMBL double, standard_relation string")
    out = bioactivity.aggregate_by_molecule(df, {"pChEMBL": "max", "standard_value": "min"}, ["standard_relation"]).collect()
    assert len(out) == 1
    r = out[0]
    assert (r["molecule_id"], r["bio_n"], r["pChEMBL"], r["standard_value"], r["standard_relation"]) == ("M1", 2, 7.0, 80.0, "=")


def test_target_rank(spark):
    rows = [(0, "T1", "Tyrosine kinase family", "Homo sapiens", "PROTEIN FAMILY", 9.0, ["EGFR family"]),
            (1, "T2", "Epidermal growth factor receptor", "Homo sapiens", "SINGLE PROTEIN", 1.0, ["EGFR", "ERBB1"]),
            (2, "T3", "EGFR", "Mus musculus", "SINGLE PROTEIN", 0.5, []), (3, "T3", "again", "x", "y", 1.0, [])]
    df = spark.createDataFrame(rows, "row_index int, target_id string, pref_name string, organism string, target_type string, score double, aliases array<string>")
    assert [r["target_id"] for r in bioactivity.rank_targets(df, " egfr ").collect()] == ["T3", "T2", "T1"]


def test_import_gate(spark):
    rows = [(1, "k", True, ""), (2, "k", True, ""), (3, "", True, ""), (4, "z", False, "bad"), (5, "k", True, "")]
    df = spark.createDataFrame(rows, "row_index int, key string, ok boolean, error string")
    out = {r["row_index"]: r for r in intake.annotate_import(df, "key", "ok", "error", reject_duplicates=True).collect()}
    assert [out[i]["duplicate_group_index"] for i in (1, 2, 5)] == [1, 2, 3] and out[5]["duplicate_count"] == 3
    assert [out[i]["accepted"] for i in range(1, 6)] == [True, False, True, False, False]
    assert out[4]["rejection_reason"] == "bad" and out[2]["status"] == "duplicate_rejected"
    assert out[2]["duplicate_warning"] == "Duplicate structure 2/3 by inchikey."


def test_profile_counts(spark):
    rows = [(1.0, "CCO", "a", "s", True), (2.0, "CCO", "b", None, True), (None, "CCC", "c", "s", True), (3.0, "xx", "d", "s", False), (4.0, "CCN", "e", "s", True)]
    df = spark.createDataFrame(rows, "activity double, SMILES string, Name string, Series string, valid boolean")
    df = df.withColumns({c: F.lit(1.0) for c in ("molecular_weight", "logp", "hbd", "hba")})
    p = profile.profile_rows(df, "SMILES", "valid", ["activity", "SMILES", "Name", "Series"])
    s = profile.profile_summary(p, "SMILES", "valid").first()
    assert (s["n_rows"], s["n_valid_molecules"], s["n_invalid_molecules"], s["duplicate_smiles_count"], s["duplicate_smiles_groups"],
            s["rows_with_missing_values"]) == (5, 4, 1, 1, 1, 2)
    assert contract.issue_counts(p, "issue_codes").where("code = 'DUPLICATE_SMILES'").first()["count"] == 2


def test_roles(spark):
    df = spark.createDataFrame([("1,5", "x", "C", 3), ("?", "y", "N", 4)], "weight string, note string, smiles string, n int")
    roles = profile.infer_roles(df, class_column="n")
    assert roles == {"weight": "attribute", "note": "meta", "smiles": "meta", "n": "class"}
    typed = profile.with_roles(df, roles)
    assert [r["weight"] for r in typed.collect()] == [1.5, None]
    assert profile.role_summary(typed) == {"attribute": ["weight"], "class": ["n"], "meta": ["note", "smiles"]}
    assert profile.unique_names(["a", "a", "b", "a"]) == ["a", "a_2", "b", "a_3"]


def test_validation_aliases(spark):
    rows = [("m1", "train", 5.0, 5.1, 1, "high"), ("m2", "test", 6.0, 6.2, 0, "low"), ("m3", "test", 7.0, 6.9, 1, "medium")]
    df = spark.createDataFrame(rows, "molecule_id string, dataset string, actual_value double, predicted_pActivity double, ad_in_domain int, ad_confidence string")
    d = validation.residual_diagnostics(df)
    s = validation.validation_summary(d).first()
    assert s["n_outside_ad"] == 1 and s["n_low_ad_confidence"] == 1
    row = d.where("molecule_id = 'm2'").first()
    assert row["review_reason"] == "outside applicability domain; low AD confidence" and row["validation_severity"] == "critical"
    assert row["compound_id"] == "m2" and row["split"] == "test"
    assert {r["group"] for r in validation.metrics_by_split(d).collect()} == {"all", "train", "test"}


def test_residual_levels(spark):
    df = spark.createDataFrame([(float(i),) for i in range(4)], "r double")
    r = validation.residual_levels(df, "r").first()
    assert r["mean"] == 1.5 and r["std"] == pytest.approx(1.1180339887) and r["plus_2std"] == pytest.approx(1.5 + 2 * math.sqrt(1.25))


def test_empty_and_constant_predictions(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a")], "observed double, predicted double, split string")
    r = validation.metrics_by_split(df).where("group = 'all'").first()
    assert r["n"] == 1 and r["r2"] is None and r["slope"] is None and r["residual_sd"] == 0.0


def test_quality_of_plain_facts(spark):
    df = spark.createDataFrame([(1, True, "", "k", 2), (2, True, "", "k", 1), (3, False, "Empty SMILES.", "", 1)],
                               "id int, ok_parse boolean, parse_error string, duplicate_key string, n_fragments int")
    got = {r["id"]: r for r in quality.quality_control(df).collect()}
    assert got[1]["issue_codes"] == "MULTI_FRAGMENT;DUPLICATE_STRUCTURE" and got[3]["severity"] == "ERROR"
    assert got[3]["issues"] == "Empty SMILES." and got[3]["dropped_reason"] == "invalid_structure"


def test_provenance_of_a_large_group_is_whole(spark):
    n = 200_000
    accepted = spark.range(n).selectExpr("cast(id as int) row_index", "if(id < 3, 'small', 'hot') identity_key", "concat('r', id) source_row_id")
    prepared = accepted.select("identity_key").distinct()
    got = {r["identity_key"]: r["n"] for r in curation.with_provenance(prepared, accepted).selectExpr("identity_key", "size(split(source_row_ids, ';')) n").collect()}
    assert got == {"small": 3, "hot": n - 3}


def test_stage_without_clean_records(spark):
    counts = spark.createDataFrame([(10, 0, 2, 2, 6)], "total long, clean long, invalid long, errors long, warnings long")
    status = lambda **k: intake.stage_summary_from_qc(counts, **k).first()["status"]
    assert status() == "needs_review" and status(review_needs_clean=True) == "blocked"


def test_points_on_the_outline_are_outside(spark):
    # y = 42.6875 - 1.125 q lies on the slanting edge; 5.3 and 10.1 on the other two
    rows = [(1.5 * q + 0.25, (42687.5 - 1125 * q + d) / 1000) for q in range(1, 51) for d in (-0.01, 0.0, 0.01)] + [(15.25, 5.3), (10.1, 8.0), (20.0, 9.0)]
    df = spark.createDataFrame(rows, "f double, y double")
    got = {tuple(r) for r in df.where(validation.inside_polygon(F.col("f"), F.col("y"), [(10.1, 5.3), (50.1, 5.3), (10.1, 35.3)])).collect()}
    want = {(f, y) for f, y in rows if f > 10.1 and y > 5.3 and (f - 10.1) / 40.0 + (y - 5.3) / 30.0 < 1}
    assert got == want and (20.0, 9.0) in got and (15.25, 5.3) not in got
