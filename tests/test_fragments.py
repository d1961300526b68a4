import hashlib
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from compoundry.chem import fragments, graph
from compoundry.operators import details

TEXTS = ["CC(=O)Oc1ccccc1C(=O)O", "c1ccc2ccccc2c1", "CCO", " CCO ", "CCO", "C", "[Na+].[Cl-]", "C1CC2CCC1CC2", "", None, "C1CC(", "N#CCS(=O)(=O)N"]
LABELS = {1.0: "-", 1.5: ":", 2.0: "=", 3.0: "#"}


@pytest.fixture(scope="module")
def classes(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, smiles string")
    return fragments.structure_classes(rows, "id", "smiles")


def shortest(mol):
    """All topological distances by breadth-first search."""
    out = {}
    for start in range(len(mol.el)):
        out[start], todo = {start: 0}, [start]
        for at in todo:
            for x in mol.nbr[at]:
                if x not in out[start]:
                    out[start][x] = out[start][at] + 1
                    todo.append(x)
    return out


def triplets_by_hand(text, low, high):
    mol = graph.read(text)
    far, found = shortest(mol), Counter()
    for i, j, k in combinations(range(len(mol.el)), 3):
        d = [far[i].get(j, 99), far[j].get(k, 99), far[i].get(k, 99)]
        if max(d) <= high and max(d) >= low:
            found[".".join(sorted(mol.el[x] for x in (i, j, k))) + "-" + ".".join(map(str, sorted(d)))] += 1
    return found


def paths_by_hand(text, bonds):
    mol = graph.read(text)
    label = [e.lower() if a else e for e, a in zip(mol.el, mol.arom)]
    found = set()

    def grow(path, shown):
        if len(path) > 1:
            found.add(min("".join(shown), "".join(reversed(shown))))
        if len(path) <= bonds:
            for x in mol.nbr[path[-1]]:
                if x not in path:
                    grow([*path, x], [*shown, LABELS[mol.bonds[min(path[-1], x), max(path[-1], x)]], label[x]])

    for i in range(len(mol.el)):
        grow([i], [label[i]])
    return sorted({int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % 2048 for t in found})


def test_classes_hold_equal_texts_once(classes):
    assert {r["_class"]: r["n"] for r in classes.parsed.collect()}["CCO"] == 3
    assert classes.parsed.count() == 7


@pytest.mark.parametrize(("low", "high"), [(2, 4), (1, 2), (3, 3)])
def test_triplets(classes, low, high):
    got = {}
    for r in fragments.triplets(classes, low, high).collect():
        got.setdefault(r["_class"], Counter())[r["fragment"]] = r["count"]
    for text in {t.strip() for t in TEXTS if t and t.strip() and t != "C1CC("}:
        assert got.get(text, Counter()) == triplets_by_hand(text, low, high), text


def test_large_structures_have_triplets_only_without_the_limit(classes):
    limited = {r["_class"] for r in fragments.triplets(classes, max_atoms=5).select("_class").distinct().collect()}
    assert limited == {"CCO"}
    assert fragments.triplets(classes, max_atoms=None).select("_class").distinct().count() == 5


def test_support_counts_rows(classes):
    support = {r["fragment"]: r["support"] for r in fragments.class_vocabulary(fragments.triplets(classes), classes, 3).collect()}
    assert support["C.C.O-1.1.2"] == 4 and all(n >= 3 for n in support.values())


@pytest.mark.parametrize("bonds", [2, 7])
def test_path_bits(classes, bonds):
    for r in fragments.path_bits(classes, bonds).collect():
        assert r["bits"] == paths_by_hand(r["_class"], bonds), r["_class"]


def test_no_rows(spark):
    none = fragments.structure_classes(spark.createDataFrame([], "id int, smiles string"), "id", "smiles")
    assert fragments.triplets(none).count() == 0 and fragments.path_bits(none).count() == 0


HIT = "id int, category string, key string, name string, smarts string, atoms array<int>, match_count int, family string, superclass string, source string"


def test_motifs(spark):
    hits = spark.createDataFrame([
        (1, "functional_group", "b", "Amine", "N", [3, 2], 1, None, None, "s"), (1, "functional_group", "a", "amine", "[N]", [2, 3, 3], 2, None, None, "s"),
        (1, "heterocycle", "p", "Pyridine", "n1ccccc1", [0, 1], 1, "", None, "s"), (1, "heterocycle", "q", "Azine", "n", [1, 0], 1, "azines", None, "s"),
        (1, "heterocycle", "q", "Azine", "n", [0, 1], 1, "azines", None, "s"), (1, "functional_group", "c", "Nothing", "X", [], 1, None, None, "s"),
        (None, "functional_group", "c", "Lost", "X", [1], 1, None, None, "s"), (2, "functional_group", "c", "Acid", "O", [5, 6, 7], 1, None, None, None)], HIT)
    got = details.motif_table(details.distinct_motifs(hits, "id"), "id").orderBy("id", "place").collect()
    assert [(r["id"], r["place"], r["key"], r["matched_atoms"]) for r in got] == [(1, 1, "q", "0, 1"), (1, 2, "a", "2, 3"), (2, 1, "c", "5, 6, 7")]
    assert got[1]["family"] == "" and got[2]["source"] == "" and got[2]["matched_atom_count"] == 3.0
    assert details.distinct_motifs(hits.where("1 = 0"), "id").count() == 0


def test_profiles_and_their_readers(spark):
    hits = spark.createDataFrame([(1, "z", "k1", "Beta", "", [0], 1, None, None, "s"), (1, "a", "k2", "Alpha", "N", [1], 1, None, None, "s")], HIT)
    motifs = details.distinct_motifs(hits, "id")
    compounds = spark.createDataFrame([(1, " CCN ", "", None), (2, None, None, None)], "id int, smiles string, murcko string, generic string")
    p = details.search_profiles(compounds, "id", hits.withColumn("smiles", F.lit("C")), motifs, 4)
    one, two = p.orderBy("id").collect()
    assert (one["smiles"], one["fragment_names"], one["fragment_smarts"], one["coverage"]) == ("CCN", "Alpha|Beta", "N|C", 0.5)
    assert (one["motif_names"], one["motif_smarts"]) == ("Alpha|Beta", "N")
    assert (two["smiles"], two["fragment_names"], two["n_fragments"], two["motif_names"]) == ("", "", 0.0, "")
    back = details.profile_queries(p.withColumn("similarity_threshold", F.lit("bad")).withColumn("motif_logic", F.lit(" ")), "id").first()
    assert back["similarity_threshold"] == 0.35 and back["motif_logic"] == "or"
    q = spark.createDataFrame([(1, " c ", "x"), (2, "", "y"), (3, None, None)], "id int, smarts string, smiles string")
    assert [(r["id"], r["pattern"]) for r in details.query_patterns(q, ["id"]).orderBy("id").collect()] == [(1, "c"), (2, "y")]


def test_pattern_tables(spark):
    t = spark.createDataFrame([("", "Primary Amine ", "N", "functional_groups", None), ("x", "Acid", "O", " Functional_Group", "own"), ("y", "Ring", "c", "rings", None),
                               ("z", "", "c", "functional_group", None), (None, "No", None, "functional_group", None)],
                              "pattern_id string, name string, smarts string, category string, source string")
    assert sorted((r["key"], r["name"], r["source"]) for r in details.functional_patterns(t).collect()) == [("primary_amine", "Primary Amine", ""), ("x", "Acid", "own")]
    h = spark.createDataFrame([(True, "p", "Pyridine", "n", None, "azine"), (False, "b", "Benzene", "c", None, None), (None, "c", "X", "c", None, None),
                               (True, None, "Furan", "o", "furans", "z")],
                              "is_true_heterocycle boolean, pattern_id string, name string, smarts string, heterocycle_family_normalized string, heterocycle_family string")
    assert sorted((r["key"], r["family"], r["superclass"]) for r in details.heterocycle_patterns(h).collect()) == [("Furan", "furans", ""), ("p", "azine", "")]
