import random

import pytest
from pyspark.sql import functions as F

from compoundry.chem import facts, graph, kernels, patterns
from compoundry.operators import quality, registry, scaffolds
from compoundry.sources import files, records, sinks

SAMPLES = ["OCC", "c1ccncc1", "Cc1ccccc1", "c1ccc2ccccc2c1", "[Na+].[O-]C(=O)C", "O=c1cc[nH]cc1", "FC(F)(F)c1ccc(cc1)C(=O)NCCN1CCOCC1",
           "Cn1cnc2c1c(=O)n(C)c(=O)n2C", "[O-][N+](=O)c1ccccc1", "C12CCC1CC2", "N#CCS(=O)(=O)N", "c1ccc(-c2ccccc2)cc1", "C1CC2CCC1CC2", "BrC(Cl)=CF"]


def shuffled(mol, rnd):
    """The same structure with its atoms in another order."""
    order = list(range(len(mol.el)))
    rnd.shuffle(order)
    place = {o: n for n, o in enumerate(order)}
    out = graph.Molecule()
    for o in order:
        out.add(mol.el[o], mol.arom[o], mol.chg[o], mol.iso[o], mol.h[o])
    for (a, b), o in mol.bonds.items():
        out.bond(place[a], place[b], o)
    return out


@pytest.mark.parametrize("text", SAMPLES)
def test_canonical_text_ignores_atom_order(text):
    rnd, mol = random.Random(0), graph.read(text)
    want = graph.write(mol)
    assert graph.write(graph.read(want)) == want
    for _ in range(6):
        assert graph.write(shuffled(mol, rnd)) == want


def test_kekule_and_aromatic_forms_agree():
    for a, b in (("C1=CC=NC=C1", "c1ccncc1"), ("C1=CC=C2C=CC=CC2=C1", "c1ccc2ccccc2c1"), ("C1=CNC=C1", "c1cc[nH]c1"), ("OCC", "CCO")):
        assert graph.write(graph.read(a)) == graph.write(graph.read(b))
    for bad in ("C1CC(", "xx", "C(C)(C)(C)(C)C", "C=", "(C)", "C1CC"):
        assert graph.cached(bad) is None


def test_scaffolds_of_known_cases():
    assert graph.write(graph.scaffold(graph.read("Cc1ccccc1"))) == "c1ccccc1"
    assert graph.write(graph.generic(graph.scaffold(graph.read("c1ccncc1")))) == "C1CCCCC1"
    assert graph.scaffold(graph.read("CCO")) is None


def test_connection_table_round_trip():
    for text in SAMPLES:
        mol = graph.read(text)
        assert graph.write(graph.from_molblock(graph.to_molblock(mol))) == graph.write(mol), text


def test_patterns():
    count = lambda smi, p: len(patterns.unique_matches(graph.read(smi), patterns.compile_pattern(p)))
    assert count("CCO", "[OX2H][CX4]") == 1 and count("Oc1ccccc1", "[OX2H]c") == 1
    assert count("CC(=O)O", "[CX3](=O)[OX2H1]") == 1 and count("CC(=O)OC", "[CX3](=O)[OX2H1]") == 0
    assert count("CC(=O)OC", "[#6][CX3](=O)[OX2H0][#6]") == 1
    assert count("[O-][N+](=O)C", "[$([NX3](=O)=O),$([N+](=O)[O-])]") == 1
    assert count("FC(F)Cl", "[F,Cl,Br,I]") == 3 and count("c1ccc2ccccc2c1", "a1aaaaa1") == 2
    assert count("C1CCCCC1C", "[R]") == 6 and count("CC", "[!#6]") == 0
    with pytest.raises(ValueError):
        patterns.compile_pattern("C(")


def test_quality_of_structures(spark):
    df = spark.createDataFrame([(1, "CCO"), (2, "CCO"), (3, "[Na+].[O-]C(=O)C"), (4, "")], "id int, smiles string")
    rows = facts.facts(facts.with_structure(df, "smiles")).withColumn("duplicate_key", F.coalesce(kernels.canonical(F.col("smiles")), F.lit("")))
    qc = quality.quality_control(rows)
    s = quality.quality_summary(qc).first()
    assert s["total"] == 4 and s["invalid"] == 1 and s["duplicate_records"] == 2
    codes = {r["id"]: r["issue_codes"].split(";") for r in qc.collect()}
    assert "DUPLICATE_STRUCTURE" in codes[1] and "MULTI_FRAGMENT" in codes[3] and "METAL_PRESENT" in codes[3] and codes[4] == ["INVALID_STRUCTURE"]


def test_facts(spark):
    df = spark.createDataFrame([("CC(=O)Oc1ccccc1C(=O)O",), ("C=CC",)], "smiles string")
    a, b = facts.facts(facts.with_structure(df, "smiles")).withColumn("formula", facts.formula(F.col("mol.atoms"))).collect()
    assert a["molecular_weight"] == pytest.approx(180.159, abs=0.01) and a["formula"] == "C9H8O4"
    assert (a["heavy_atoms"], a["n_rings"], a["hbd"], a["hba"], a["n_hetero_atoms"], a["aromatic_atoms"]) == (13, 1, 1, 4, 4, 6)
    assert b["possible_double_bond_stereo"] == 0 and b["fraction_csp3"] == pytest.approx(1 / 3)


def test_circular_bits_ignore_atom_order(spark):
    rnd = random.Random(2)
    rows = []
    for k, t in enumerate(SAMPLES):
        mol = graph.read(t)
        rows += [(k, t), (k, graph.write(mol))]
    df = facts.circular_bits(facts.with_structure(spark.createDataFrame(rows, "k int, smiles string"), "smiles"))
    assert df.groupBy("k").agg(F.count_distinct("bits").alias("n")).where("n > 1").count() == 0
    assert df.select("bits").distinct().count() == len(SAMPLES)
    del rnd


def test_path_fragments(spark):
    df = facts.with_structure(spark.createDataFrame([(1, "CCO")], "id int, smiles string"), "smiles")
    got = {r["fragment"]: r["count"] for r in facts.path_fragments(df, ["id"], min_atoms=1, max_atoms=3).collect()}
    assert got == {"C": 2, "O": 1, "C-C": 1, "C-O": 1, "C-C-O": 1}
    wide = facts.fragment_matrix(facts.path_fragments(df, ["id"]), ["C-C", "N-N"], "id").first()
    assert wide["C-C"] == 1 and wide["N-N"] == 0


def test_standardize(spark):
    df = spark.createDataFrame([("[Na+].[O-]C(=O)C",), ("C[NH3+].[Cl-]",), ("xx",), ("C[N+](C)(C)C",)], "s string")
    got = [r["o"] for r in df.select(kernels.standardize(F.col("s"), "QSAR-ready").alias("o")).collect()]
    canon = lambda t: graph.write(graph.read(t))
    assert got[0]["smiles"] == canon("CC(=O)O") and "Uncharger" in got[0]["log"] and got[0]["changed"]
    assert got[1]["smiles"] == canon("CN") and not got[2]["ok"] and got[3]["smiles"] == canon("C[N+](C)(C)C")
    keep = df.select(kernels.standardize(F.col("s"), "minimal").alias("o")).first()["o"]
    assert keep["smiles"] == canon("[Na+].[O-]C(=O)C") and not keep["changed"]


def test_scaffold_tables(spark):
    rows = [("c1ccccc1", 1.0), ("Cc1ccccc1", 5.0), ("Clc1ccccc1", 9.0), ("CCO", 2.0), ("bad(", 3.0)]
    df = scaffolds.annotate(spark.createDataFrame(rows, "smiles string, act double"), "smiles").cache()
    first = scaffolds.activity_summary(df, "murcko", "act").first()
    assert first["scaffold"] == "c1ccccc1" and first["count"] == 3 and first["best_activity"] == 1.0 and first["std_activity"] == 4.0
    s = scaffolds.series_summary(df, "murcko").first()
    assert (s["n_rows"], s["n_valid_molecules"], s["n_series"], s["n_acyclic_rows"]) == (5, 4, 2, 1)
    hit, miss = scaffolds.r_group_table(df.select("smiles"), "smiles")
    assert {r["smiles"]: r["groups"] for r in hit.collect()}["Clc1ccccc1"].values() == {"R1": "Cl"}.values() or hit.count() == 3
    assert [r["smiles"] for r in miss.collect()] == ["CCO"]


def test_registry(spark):
    rows = [(1, "pyridine", "x", "", False, 1, 1), (2, "benzyne dehydro", "x", "", False, 0, 1), (3, "cyclohexane", "carbocycle", "", False, 0, 0), (4, "amide", "", "Functional", True, 1, 1)]
    df = spark.createDataFrame(rows, "entry_id int, name string, family string, grp string, dehydro boolean, hetero int, rings int").withColumn("smarts", F.lit("C"))
    df = df.withColumn("section", registry.section(F.col("grp"), F.col("family"), F.col("name"), F.col("dehydro"), F.lit(False), F.col("hetero"), F.col("rings")))
    got = {r["entry_id"]: (r["section"], r["bit"]) for r in registry.with_bits(df).collect()}
    assert [got[i][0] for i in range(1, 5)] == ["heterocycle_registry", "aromaticity_dehydro", "carbocycle_registry", "functional_group_registry"]
    assert all(registry.SECTIONS[s][0] <= b < registry.SECTIONS[s][1] for s, b in got.values())


def test_smiles_lines(spark, tmp_path):
    p = tmp_path / "a.smi"
    p.write_text("# head\nCCO ethanol extra\n\nc1ccccc1\nbad( odd\n")
    rows = files.read_smiles_lines(spark, str(p)).orderBy("row_index").collect()
    assert [(r["row_index"], r["smiles"], r["name"]) for r in rows] == [(1, "CCO", "ethanol extra"), (2, "c1ccccc1", "mol_2"), (3, "bad(", "odd")]


def test_import_of_a_delimited_file(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("compound_id;smiles;note\nA;CCO;x\nB;OCC;y\nC;;z\nD;C1CC(;w\n")
    assert files.sniff_delimiter(spark, str(p))[0] == ";"
    rows = {r["name"]: r for r in files.import_molecules(spark, str(p), reject_duplicates=True).collect()}
    assert rows["A"]["accepted"] and not rows["B"]["accepted"] and rows["B"]["rejection_reason"] == "duplicate_structure"
    assert rows["C"]["error"] == "Empty SMILES." and rows["D"]["error"] == "Invalid SMILES." and rows["A"]["transform_log"] == "import"
    assert len(rows["A"]["row_id"]) == 16 and rows["A"]["note"] == "x"
    with pytest.raises(ValueError):
        files.detect_format("a.xyz")


def test_structure_record_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "CC(=O)O", "acid", "1.5"), (2, "c1ccncc1", "pyridine", None), (3, "", "none", "2")], "row_index int, smiles string, name string, value string")
    rec = sinks.export_records(df, "smiles", "name")
    out = str(tmp_path / "x.sdf")
    sinks.write_molecules(rec, out)
    back = {r["name"]: r for r in files.read_structure_records(spark, out).collect()}
    assert set(back) == {"acid", "pyridine"} and back["acid"]["props"] == {"value": "1.5"}
    assert graph.write(graph.read(back["acid"]["smiles"])) == graph.write(graph.read("CC(=O)O"))
    assert {r["metric"]: r["value"] for r in sinks.export_summary(rec).collect()} == {"total_records": 3, "written_records": 2, "failed_records": 1}
    (tmp_path / "bad.sdf").write_text("broken\n\n\n  x\nM  END\n$$$$\n")
    bad = files.read_structure_records(spark, str(tmp_path / "bad.sdf")).collect()
    assert len(bad) == 1 and not bad[0]["ok"]


def test_text_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "CCO", "e", "7")], "row_index int, smiles string, name string, b string")
    rec = sinks.export_records(df, "smiles", "name")
    sinks.write_molecules(rec, str(tmp_path / "o.csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "o.csv")).collect()[0].asDict() == {"SMILES": "CCO", "Name": "e", "b": "7"}
    sinks.write_molecules(rec, str(tmp_path / "o.smi"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "o.smi")).collect()] == ["CCO\te"]


def test_service_pages(spark):
    page = ('{"molecules":[{"molecule_chembl_id":"chembl1 ","pref_name":"N","molecule_structures":{"canonical_smiles":"CCO"},'
            '"molecule_properties":{"alogp":"1.5","note":"x"}}],"page_meta":{"offset":0,"total_count":1}}')
    pages = records.parse_pages(spark.createDataFrame([(page,)], "j string"), "j", records.MOLECULE_PAGE)
    mols = records.molecules(pages)
    r = records.numeric_properties(mols, "props", ["alogp", "note", "psa"]).first()
    assert r["molecule_id"] == "CHEMBL1" and r["smiles"] == "CCO" and (r["alogp"], r["note"], r["psa"]) == (1.5, None, None)
    assert records.total_count(pages).first()[0] == 1
    acts = '{"activities":[{"molecule_chembl_id":"M","standard_type":"ic50","standard_value":"2","standard_units":"uM"},{"standard_type":"Ki"}],"page_meta":{}}'
    a = records.activities(records.parse_pages(spark.createDataFrame([(acts,)], "j string"), "j", records.ACTIVITY_PAGE)).collect()
    assert len(a) == 1 and a[0]["ic50_nM"] == 2000
    t = '{"targets":[{"target_chembl_id":"T","target_components":[{"component_description":"d","target_component_synonyms":[{"component_synonym":"EGFR"}]},{"component_description":null}]}]}'
    assert records.targets(records.parse_pages(spark.createDataFrame([(t,)], "j string"), "j", records.TARGET_PAGE)).first()["aliases"] == ["d", "EGFR"]


def test_import_quality_standardise_curate(spark, tmp_path):
    from compoundry.operators.curation import CurationConfig, curate

    p = tmp_path / "w.csv"
    p.write_text("compound_id,name,smiles,standard_type,standard_relation,standard_value,standard_units\n"
                 "a,A,CCO,IC50,=,100,nM\nb,B,OCC,IC50,=,200,nM\nc,C,C(O)C,IC50,=,50,nM\nd,D,bad(,IC50,=,10,nM\n")
    rows = files.import_molecules(spark, str(p))
    assert rows.where("ok").count() == 3 and rows.where("not ok").count() == 1
    good = rows.where("ok").withColumn("std", kernels.standardize(F.col("smiles")))
    good = good.withColumn("smiles", F.col("std.smiles")).drop("std", "status", "accepted")
    res = curate(good, CurationConfig(smiles="smiles", activity="standard_value", name="compound_id", unit="standard_units",
                                      relation="standard_relation", endpoint="standard_type"))
    row = res.prepared.collect()
    assert len(row) == 1 and row[0]["n_measurements"] == 3 and len(row[0]["source_row_ids"].split(";")) == 3
    paths = sinks.write_curation(res, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(paths["qsar_ready"]).count() == 1


def test_reaction_rules():
    from compoundry.chem import reactions

    canon = lambda t: ".".join(graph.write(graph.read(p)) for p in t.split("."))
    run = lambda rule, *r: reactions.run(rule, list(r))
    assert run("[C:1][Br:2].[O:3][C:4]>>[C:1][O:3][C:4].[Br:2]", "CCBr", "OC") == [canon("CCOC.Br")]
    assert set(run("[C:1]=[C:2]>>[C:1][C:2]", "C=CC")) == {canon("CCC")}
    assert run("[C:1][Cl]>>[C:1][N+](=O)[O-]", "CCl") == [canon("C[N+](=O)[O-]")]
    assert run("[C:1](=[O:2])[OH].[N;H2:3]>>[C:1](=[O:2])[N:3]", "CC(=O)O", "NCC") == [canon("CC(=O)NCC")]
    assert set(run("[c:1][Br].[B][c:2]>>[c:1]-[c:2]", "Brc1ccccc1", "OB(O)c1ccccc1")) == {canon("c1ccc(-c2ccccc2)cc1")}
    assert run("[C:1][Br]>>[C:1][O]", "CC") == [] and not reactions.readable("no arrow")


def test_enumeration_walks_pools_from_the_end(spark):
    from compoundry.operators import enumeration

    a = spark.createDataFrame([(0, "CBr"), (1, ""), (2, "CCBr"), (3, "CC")], "o bigint, s string")
    b = spark.createDataFrame([(5, "OC"), (6, "OCC"), (7, "OC")], "o bigint, s string")
    rules = spark.createDataFrame([("bad", "xx", 0), ("ether", "[C:1][Br].[OH:3][C:4]>>[C:1][O:3][C:4]", 1), ("three", "[C:1].[C:2].[C:3]>>[C:1]", 2)],
                                  "name string, smirks string, position int")
    want, seen = [], set()
    from compoundry.chem import reactions
    for x in ["CC", "CCBr", "CBr"]:
        for y in ["OC", "OCC", "OC"]:
            for p in reactions.run("[C:1][Br].[OH:3][C:4]>>[C:1][O:3][C:4]", [x, y]):
                if p not in seen:
                    seen.add(p)
                    want.append((x, y, p))
    for limit in (2, 100):
        got = [(*r["reactants"], r["product_smiles"]) for r in enumeration.enumerate_products([(a, "s", "o"), (b, "s", "o")], rules, limit, stretch=2).collect()]
        assert got == want[:limit]


def test_common_part():
    from compoundry.chem import common

    assert common.matched("Cc1ccccc1", "Clc1ccccc1") == (6, "C", "Cl")
    assert common.matched("c1ccccc1", "Cc1ccccc1") == (6, "H", "C")
    assert common.matched("CCO", "CCN") is None
    assert common.matched("CCCCO", "CCCCO") is None
    # A chain never lies on a ring, and part of a ring does not count.
    assert common.matched("CCCCCC", "C1CCCCC1") is None
    n, a, b = common.matched("OCCc1ccccc1", "NCCc1ccccc1")
    assert n == 8 and (a, b) == ("O", "N")


@pytest.mark.parametrize("limit", [3, 100])
def test_matched_pairs(spark, limit):
    from compoundry.chem import common
    from compoundry.operators import matched

    rows = [(k * 2, s, float(k)) for k, s in enumerate(["Cc1ccccc1", "Clc1ccccc1", "", "CCO", "Brc1ccccc1", "OCCc1ccccc1", "NCCc1ccccc1", "x("])]
    df = spark.createDataFrame(rows, "id bigint, smiles string, p double")
    want = []
    for i, a in enumerate(rows):
        for b in rows[i + 1:]:
            m = common.matched(a[1], b[1]) if a[1] and b[1] else None
            if m:
                want.append((a[0], b[0], f"{m[1]} -> {m[2]}", m[0], b[2] - a[2]))
    got = [tuple(r) for r in matched.matched_pairs(df, "smiles", "id", "p", max_pairs=limit).collect()]
    if limit == 3:
        assert got == want[:3]
    else:
        assert sorted(got) == sorted(want) and [g[3] for g in got] == sorted([w[3] for w in want], reverse=True)


def test_structure_search(spark):
    from compoundry.operators import search

    df = spark.createDataFrame([(1, "CCO"), (2, "c1ccccc1O"), (3, "CC"), (4, "bad("), (5, "OCC")], "id int, smiles string")
    ids = lambda q, mode, **kw: sorted(r["id"] for r in search.search(df, "smiles", q, mode, **kw).collect())
    assert ids("C1=CC=CC=C1", "substructure") == [2] and ids("[OX2H]", "substructure") == [1, 2, 5]
    assert ids("OCC", "exact") == [1, 5] and ids("CCCO", "superstructure") == [1, 3, 5]
    assert ids("CCO", "similarity", threshold=0.99) == [1, 5]
    assert search.search(df, "smiles", "[OX2H]").orderBy("id").first()["highlight_atoms"] == "2"
    with pytest.raises(ValueError):
        search.read_query("xx(", "exact")


def test_table_naming_helpers(spark):
    from compoundry.operators import binding, intake

    assert binding.pair_columns(["Name A", "SMILES A", "SMILES B"]) == ("SMILES A", "SMILES B") and binding.pair_mode("SMILES A", "smiles_b") == "classic"
    assert binding.pair_columns(["smiles", "standardized_smiles"]) == ("smiles", "standardized_smiles")
    assert binding.pair_mode("smiles", "standardized_smiles") == "standardization" and binding.pair_columns(["a"]) == ("", "")
    df = spark.createDataFrame([("x", "1.5", 2)], "target string, pIC50 string, n int")
    assert binding.target_column(df) == "pIC50"
    out = intake.with_standardization_stage(spark.createDataFrame([("OK",), ("failed",)], "s string"), "s", "docking_ready").collect()
    assert out[0]["curation_status"] == "Docking-ready" and out[0]["curation_ready_for_docking"] and out[1]["curation_blockers"] == "Standardization failed"


def test_radicals_and_weights(spark):
    texts = {"CCO": (False, 46.069), "[CH3]": (True, 15.035), "C[N+](=O)[O-]": (False, 61.04), "F[Mn]F": (False, 92.934), "CS(=O)(=O)C": (False, 94.128), "[O]": (True, 15.999)}
    df = spark.createDataFrame([(t,) for t in texts], "smiles string")
    for r in facts.facts(facts.with_structure(df, "smiles")).collect():
        radical, mass = texts[r["smiles"]]
        assert r["has_radical"] == radical and r["molecular_weight"] == pytest.approx(mass, abs=1e-3)


def test_repeated_record_properties_keep_their_own_values(spark, tmp_path):
    from compoundry.sources.files import read_structure_records

    block = "name\n\n\n  1  0  0  0  0  0  0  0  0  0999 V2000\n    0.0000    0.0000    0.0000 C   0  0\nM  END\n"
    (tmp_path / "a.sdf").write_text(block + ">  <A>\n1\n\n>  <A>\n2\n\n>  <B>\n3\n\n$$$$\n")
    row = read_structure_records(spark, str(tmp_path / "a.sdf")).first()
    assert row["props"] == {"A": "1", "B": "3"}


def test_polar_surface_of_known_structures(spark):
    from compoundry.chem import facts

    known = {"CC(=O)Oc1ccccc1C(=O)O": 63.60, "CC(=O)Nc1ccc(O)cc1": 49.33, "Cn1cnc2c1c(=O)n(C)c(=O)n2C": 61.82, "C1CO1": 12.53, "C1CN1": 21.94,
             "O=[N+]([O-])c1ccccc1": 43.14, "[O-][n+]1ccccc1": 26.94, "c1cc[nH]c1": 15.79, "C[NH3+]": 27.64, "CC#N": 23.79, "O": 31.5, "N": 35.0, "CCO": 20.23, "CC": 0.0}
    df = spark.createDataFrame([(i, s) for i, s in enumerate([*known, "C1CC(", "", None])], "id long, smiles string")
    m = facts.with_polar_surface(facts.with_structure(df, "smiles"))
    got = {r["smiles"]: (r["tpsa"], r["tpsa_default_environments"]) for r in m.collect()}
    for text, value in known.items():
        assert abs(got[text][0] - value) < 1e-6, text
    assert got["O"][1] == ["O H2 ()"] and got["CCO"][1] == [] and got["C1CC("] == (None, None) and got[None] == (None, None)
    table = spark.createDataFrame([("C H3 (-)", 1.0), ("C H2 (--)", 0.5), ("O H1 (-)", -1.0)], "environment string, contribution double")
    sums = {r["id"]: (r["value"], r["unknown"]) for r in facts.contribution_sums(m, "id", table).collect()}
    assert sums[list(known).index("CCO")] == (0.5, []) and sums[list(known).index("CC")] == (2.0, [])
    assert sums[list(known).index("CC#N")] == (None, ["C H0 (-#)", "N H0 (#)"])


def test_record_keeps_atoms_without_inferable_hydrogens():
    from compoundry.chem import graph

    for text in ("[O-][N+](=O)", "[CH2]", "[O-][N+](=O)c1ccccc1", "C[NH3+]", "[Na+].[Cl-]", "CS(=O)(=O)C", "[NH4+]", "[C]", "OC[CH]C"):
        mol = graph.cached(text)
        back = graph.from_molblock(graph.to_molblock(mol, "x"))
        assert [h or 0 for h in back.h] == [h or 0 for h in mol.h], text


def test_pair_columns_by_roles():
    from compoundry.operators import binding

    cases = {
        ("canonical smiles", "std output smiles", "smiles"): ("canonical smiles", "std output smiles"),
        ("smiles", "raw_smiles", "smiles_std"): ("raw_smiles", "smiles_std"), ("smiles_std", "smiles"): ("smiles", "smiles_std"),
        ("smiles", "canonical_smiles"): ("canonical_smiles", "smiles"), ("raw smiles", "id", "smiles"): ("raw smiles", "smiles"),
        ("smiles_1", "smiles_2"): ("smiles_1", "smiles_2"), ("my smiles x", "id", "your smiles y"): ("my smiles x", "your smiles y"),
        ("SMILES-B", "smiles", "SMILES-A"): ("SMILES-A", "SMILES-B"), ("id", "smiles"): ("", ""), (): ("", ""),
    }
    for columns, want in cases.items():
        assert binding.pair_columns(list(columns)) == want, columns
    modes = {("smiles_a", "smiles_b"): "classic", ("x", "smiles_std"): "standardization", ("raw_smiles", ""): "transformation", ("", "smiles"): "transformation",
             ("x", "my smiles"): "transformation", ("", "my smiles"): "", ("a", "b"): ""}
    assert {k: binding.pair_mode(*k) for k in modes} == modes


def test_registry_print(spark, tmp_path):
    entries = spark.createDataFrame([(1, "carbocycle_registry", 3072, "C"), (2, "carbocycle_registry", 3072, "N"), (3, "heterocycle_registry", 2050, "O"),
                                     (4, "reserved", None, "P")], "entry_id long, section string, bit int, smarts string")
    rows = [("a", 1), ("a", 2), ("a", 1), ("a", 3), ("b", 3), ("b", 99), (None, 1), ("c", None), ("d", 4)] + [(f"m{i}", 3) for i in range(300)]
    sparse = registry.sparse_print(spark.createDataFrame(rows, "mol string, entry_id long"), entries, "mol")
    got = {(r["mol"], r["bit"]): (r["section"], r["n_entries"]) for r in sparse.collect()}
    assert got.pop(("a", 3072)) == ("carbocycle_registry", 2) and got.pop(("a", 2050)) == got.pop(("b", 2050)) == ("heterocycle_registry", 1)
    assert len(got) == 300
    support = {r["bit"]: (r["n_molecules"], r["n_collided"]) for r in registry.bit_support(sparse).collect()}
    assert support == {3072: (1, 1), 2050: (302, 0)}
    assert {r["bit"]: r["label"] for r in registry.bit_labels(entries.where("bit is not null")).collect()} == {
        3072: "carbocycle_registry_3072_1+1", 2050: "heterocycle_registry_2050_3"}
    more = spark.createDataFrame([("a", 5), ("a", 2050), ("z", 0), ("z", 9999)], "mol string, bit int")
    registry.write_print(sparse, "mol", str(tmp_path / "print"), more)
    dense = {r["mol"]: r for r in spark.read.parquet(str(tmp_path / "print")).collect()}
    on = lambda words: [64 * k + b for k, w in enumerate(words) for b in range(64) if w >> b & 1]
    assert len(dense) == 303 and on(dense["a"]["fp"]) == [5, 2050, 3072] and dense["a"]["n_on"] == 3 and on(dense["z"]["fp"]) == [0] and len(dense["a"]["fp"]) == 64
    empty = registry.sparse_print(spark.createDataFrame([], "mol string, entry_id long"), entries, "mol")
    assert empty.count() == registry.dense_print(empty, "mol").count() == 0
    bad = spark.createDataFrame([(1, "[C", "morgan"), (2, "C(N", "odd"), (3, None, None), (4, "[C]([N])", "morgan"), (5, "C", "morgan"), (5, "C", "morgan")],
                                "entry_id long, smarts string, section string")
    assert sorted(map(tuple, registry.registry_issues(bad).collect())) == [
        (1, "unbalanced_brackets"), (2, "unbalanced_parentheses"), (2, "unknown_section"), (3, "empty_pattern"), (3, "unknown_section"), (5, "duplicate_id")]


def test_unknown_stereo_is_an_issue(spark):
    rows = [(1, True, "a", "", 0), (2, True, "b", "", None), (3, True, "c", "", 2), (4, False, "", "broken", None)]
    df = spark.createDataFrame(rows, "id long, ok_parse boolean, duplicate_key string, parse_error string, unassigned_chiral_centers int")
    df = df.withColumn("molecular_weight", F.lit(100.0))
    got = {r["id"]: (r["issue_codes"], r["severity"]) for r in quality.quality_control(df).collect()}
    assert got == {1: ("", "OK"), 2: ("STEREO_COMPUTATION_FAILED", "WARNING"), 3: ("UNASSIGNED_CHIRAL_STEREO", "WARNING"), 4: ("INVALID_STRUCTURE", "ERROR")}
    without = quality.quality_control(df.drop("unassigned_chiral_centers"))
    assert without.where("ok_parse and severity <> 'OK'").count() == 0


def test_work_is_done_once_per_distinct_text(spark):
    from pyspark.sql import functions as F

    from compoundry.chem import facts

    rows = [(i, t) for i, t in enumerate(["CCO", "c1ccccc1", "CCO", None, "", "CCO", None, "C1CC("])]
    df = spark.createDataFrame(rows, "id long, smiles string")
    met = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def length(t):
        met.add(1)
        return None if t is None else len(t)

    out = facts.by_text(df, "smiles", lambda texts: texts.withColumn("n", length("smiles")))
    assert out.columns == ["id", "smiles", "n"]
    assert {r["id"]: r["n"] for r in out.collect()} == {i: None if t is None else len(t) for i, t in rows} and met.value == 5
    texts = facts.with_structure(facts.texts_of(df, "smiles"), "smiles")
    once = facts.fragment_vocabulary(facts.path_fragments(texts, ["smiles", "n_rows"]), 1, "n_rows")
    assert once.collect() == facts.fragment_vocabulary(facts.path_fragments(facts.with_structure(df, "smiles"), ["id"]), 1).collect()


def test_equal_tables_are_read_once(monkeypatch):
    from compoundry.chem import graph

    graph._table_text.cache_clear()
    read = []
    monkeypatch.setattr(graph, "from_molblock", lambda b, f=graph.from_molblock: (read.append(b), f(b))[1])
    texts = ["CCO", "c1ccccc1C(=O)O", "[Na+].[Cl-]", "c1cc[nH]c1"]
    for n in range(5):
        for text in texts:
            block = f"molecule {n}" + graph.table_of(text) + f"\n> <n>\n{n}\n\n"
            assert graph.block_text(block) == graph.canonical(text) == graph.write(graph.read(text))
            assert block.startswith(graph.to_molblock(graph.read(text), f"molecule {n}"))
    assert len(read) == len(texts)
    for bad in ("", "a\nb\nc", "a\nb\nc\n  2  1\nM  END\n", "a\n\n\nM  END\n"):
        assert graph.block_text(bad) is None


def test_tasks_of_the_print_follow_its_rows(spark, monkeypatch):
    from compoundry.functions import skew
    from compoundry.operators import registry

    rows = [(i % 300, (7 * i) % 41) for i in range(6000)] + [(5, 3)] * 500 + [(None, 1), (9, 99)]
    matches = spark.createDataFrame(rows, "m int, entry_id int").repartition(4)
    entries = spark.createDataFrame([(e, "morgan", e % 10) for e in range(41)], "entry_id int, section string, bit int")
    want = {}
    for m, e in set(rows):
        if m is not None and e < 41:
            want[m, e % 10] = want.get((m, e % 10), 0) + 1
    monkeypatch.setattr(registry, "TASK_ROWS", 100)
    for limit in (1_000_000, 10):
        monkeypatch.setattr(registry, "hot_key_table", lambda c, k, n, limit=limit: skew.hot_key_table(c, k, n, limit))
        got = registry.sparse_print(matches, entries, "m")
        assert {(r["m"], r["bit"]): r["n_entries"] for r in got.collect()} == want
        assert got.rdd.getNumPartitions() >= 60
