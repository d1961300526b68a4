import json
import random

from compoundry import cli
from compoundry.sources import paged


def test_paged_service(spark, tmp_path):
    for offset in (0, 2, 4):
        acts = [{"molecule_chembl_id": f"M{offset + k}", "standard_type": "IC50" if k else "Ki", "standard_value": "1", "standard_units": "nM"} for k in range(2)]
        (tmp_path / f"p2_{offset}.json").write_text(json.dumps({"activities": acts, "page_meta": {"offset": offset, "total_count": 6}}))
    (tmp_path / "p1_0.json").write_text(json.dumps({"page_meta": {"total_count": 6}}))
    url = f"file://{tmp_path}/p{{limit}}_{{offset}}.json"
    assert paged.total_count(url) == 6
    rows = paged.activities_with_fallback(spark, url, "", "ic50", limit=2).orderBy("row_index").collect()
    assert [(r["row_index"], r["molecule_chembl_id"]) for r in rows] == [(1, "M1"), (3, "M3"), (5, "M5")]


def test_curate_and_qc_commands(spark, tmp_path, capsys):
    p = tmp_path / "a.csv"
    p.write_text("compound_id,smiles,standard_value,standard_units\nA,CCO(C),10,nM\nA,CCO(C),30,nM\nB,c1ccccc1,x,nM\n")
    assert cli.main(["curate", str(p), str(tmp_path / "out")], spark) == 0
    paths = json.loads(capsys.readouterr().out)
    assert spark.read.option("header", True).csv(paths["qsar_ready"]).count() == 1 and spark.read.option("header", True).csv(paths["rejected"]).count() == 1
    assert cli.main(["qc", str(p), str(tmp_path / "qc")], spark) == 0
    paths = json.loads(capsys.readouterr().out)
    assert spark.read.option("header", True).csv(paths["problem"]).count() == 2


def test_model_commands(spark, tmp_path, capsys):
    rnd = random.Random(0)
    lines = ["compound_id,w,x,y"] + [f"c{i},{(w := rnd.random()):.4f},{rnd.random():.4f},{3 * w + 1:.4f}" for i in range(40)]
    p = tmp_path / "t.csv"
    p.write_text("\n".join(lines) + "\n")
    assert cli.main(["train", str(p), str(tmp_path / "m"), "--target", "y"], spark) == 0
    paths = json.loads(capsys.readouterr().out)
    assert cli.main(["domain", str(p), str(tmp_path / "d"), "--reference", str(p)], spark) == 0
    assert cli.main(["report", str(p), str(tmp_path / "r")], spark) == 0
    assert (tmp_path / "r.report.md").exists()
