"""Arrow functions over structure texts.

Each function asks the graph helper for one thing and returns plain arrays or texts;
counting, filtering, grouping and joining happen in Spark.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from compoundry.chem import graph, patterns

STRUCTURE = """struct<ok boolean, error string,
  atoms array<struct<el string, arom boolean, chg int, iso int, h int, deg int, ring boolean, chiral boolean>>,
  bonds array<struct<a int, b int, ord double, ring boolean, marked boolean>>, ring_sizes array<int>>"""

# Metals that are cut off and flagged.
METALS = frozenset("Li Be Na Mg Al K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Cs Ba La Ce "
                   "Pr Nd Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi".split())


def _each(smiles: pd.Series, fn, bad=None) -> list:
    """Apply ``fn`` to each parsed structure; equal texts of a batch are worked on once."""
    codes, texts = pd.factorize(smiles, use_na_sentinel=True)
    done = []
    for text in texts:
        mol = graph.cached(text.strip())
        done.append(bad if mol is None else fn(mol))
    return [bad if c < 0 else done[c] for c in codes]


def structure(smiles: Column) -> Column:
    """ok, error, atoms, bonds, ring sizes."""
    def one(mol):
        rings = mol.rings()
        ring_atoms = {i for r in rings for i in r}
        ring_bonds = {(min(a, b), max(a, b)) for r in rings for a, b in zip(r, r[1:] + r[:1])}
        return {
            "ok": True, "error": "", "ring_sizes": [len(r) for r in rings],
            "atoms": [{"el": mol.el[i], "arom": mol.arom[i], "chg": mol.chg[i], "iso": mol.iso[i], "h": mol.h[i] or 0,
                       "deg": len(mol.nbr[i]), "ring": i in ring_atoms, "chiral": mol.chiral[i]} for i in range(len(mol.el))],
            "bonds": [{"a": a, "b": b, "ord": o, "ring": (a, b) in ring_bonds,
                       "marked": any((min(c, x), max(c, x)) in mol.marked for c in (a, b) for x in mol.nbr[c])}
                      for (a, b), o in mol.bonds.items()]}

    @F.pandas_udf(STRUCTURE)
    def parse(s: pd.Series) -> pd.DataFrame:
        rows = []
        for text, got in zip(s, _each(s, one)):
            if got is None:
                empty = text is None or not text.strip()
                got = {"ok": False, "error": "Empty SMILES." if empty else "Invalid SMILES.", "atoms": [], "bonds": [], "ring_sizes": []}
            rows.append(got)
        return pd.DataFrame(rows, columns=["ok", "error", "atoms", "bonds", "ring_sizes"])

    return parse(smiles)


def canonical(smiles: Column) -> Column:
    """Canonical text, null where unreadable."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        codes, texts = pd.factorize(s, use_na_sentinel=True)
        done = [graph.canonical(text.strip()) for text in texts]
        return pd.Series([None if c < 0 else done[c] for c in codes], dtype=object)

    return run(smiles)


def scaffolds(smiles: Column) -> Column:
    """struct(status, murcko, generic): ok / acyclic / invalid."""
    def one(mol):
        core = graph.scaffold(mol)
        if core is None:
            return ("acyclic", "", "")
        return ("ok", graph.write(core), graph.write(graph.generic(core)))

    @F.pandas_udf("struct<status string, murcko string, generic string>")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(_each(s, one, ("invalid", None, None)), columns=["status", "murcko", "generic"])

    return run(smiles)


def pattern_hits(smiles: Column, names: list[str], texts: list[str]) -> Column:
    """array<struct(pattern, count, atoms)> of the patterns that occur."""
    compiled = [patterns.compile_pattern(t) for t in texts]
    del compiled

    def one(mol):
        out = []
        for name, text in zip(names, texts):
            found = patterns.unique_matches(mol, patterns.compile_pattern(text))
            if found:
                out.append({"pattern": name, "count": len(found), "atoms": sorted({i for m in found for i in m})})
        return out

    @F.pandas_udf("array<struct<pattern string, count int, atoms array<int>>>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(_each(s, one, []), dtype=object)

    return run(smiles)


def has_pattern(smiles: Column, text: str) -> Column:
    """True where the pattern occurs."""
    patterns.compile_pattern(text)

    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        p = patterns.compile_pattern(text)
        return pd.Series(_each(s, lambda m: next(patterns.matches(m, p), None) is not None, False))

    return run(smiles)


def contained_in(smiles: Column, whole: str) -> Column:
    """True where the row's structure occurs inside ``whole`` (superstructure search)."""
    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        big = graph.cached(whole)
        return pd.Series([big is not None and _within(t, big) for t in s])

    def _within(text, big) -> bool:
        try:
            return bool(text) and next(patterns.matches(big, patterns.compile_pattern(text)), None) is not None
        except (ValueError, IndexError):
            return False

    return run(smiles)


def r_groups(smiles: Column, core: str) -> Column:
    """map of attachment label -> side group for rows that contain the core, else null."""
    def one(mol):
        hit = next(patterns.matches(mol, patterns.compile_pattern(core)), None)
        if hit is None:
            return None
        inside, out = set(hit), {}
        for k, i in enumerate(hit):
            for j in sorted(mol.nbr[i]):
                if j in inside:
                    continue
                seen, todo = set(), [j]
                while todo:
                    a = todo.pop()
                    if a not in seen and a not in inside:
                        seen.add(a)
                        todo += mol.nbr[a]
                label = f"R{k + 1}"
                text = graph.write(mol.part(seen))
                out[label] = f"{out[label]}.{text}" if label in out else text
        return out

    @F.pandas_udf("map<string,string>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(_each(s, one), dtype=object)

    return run(smiles)


# Standardisation steps per profile.
STEPS = ("MetalDisconnector", "LargestFragmentChooser", "Uncharger")
PROFILES = {
    "minimal": (), "qsar_ready": STEPS, "chembl_like": STEPS, "drug_discovery_default": STEPS,
    "docking_ready": STEPS[:2], "fingerprint_canonical": STEPS[:2], "preserve_salts": STEPS[:1], "docking_pose_safe": ()}
PROFILE_LABELS = {"Minimal": "minimal", "QSAR-ready": "qsar_ready", "ChEMBL-like": "chembl_like", "Docking-ready": "docking_ready"}


def _disconnect(mol):
    cut = [k for k, o in mol.bonds.items() if any(mol.el[i] in METALS for i in k)]
    if not cut:
        return mol
    for a, b in cut:
        o = int(mol.bonds.pop((a, b)))
        mol.nbr[a].remove(b)
        mol.nbr[b].remove(a)
        metal, other = (a, b) if mol.el[a] in METALS else (b, a)
        mol.chg[metal] += o
        mol.chg[other] -= o
    return mol


def _largest(mol):
    parts = mol.fragments()
    if len(parts) == 1:
        return mol
    weight = lambda f: (sum(mol.el[i] != "H" for i in f), any(mol.el[i] == "C" for i in f), graph.write(mol.part(f)))
    return mol.part(max(parts, key=weight))


def _uncharge(mol):
    for i, q in enumerate(mol.chg):
        fixed = any(mol.chg[j] * q < 0 for j in mol.nbr[i])
        if fixed or mol.el[i] in METALS:
            continue
        if q < 0 and mol.el[i] in ("O", "S", "N"):
            mol.h[i], mol.chg[i] = mol.h[i] - q, 0
        elif q > 0 and mol.h[i] >= q:
            mol.h[i], mol.chg[i] = mol.h[i] - q, 0
    return mol


def standardize(smiles: Column, profile: str = "qsar_ready") -> Column:
    """struct(ok, smiles, log, changed) by a named profile."""
    steps = PROFILES.get(PROFILE_LABELS.get(profile, profile), STEPS)
    work = {"MetalDisconnector": _disconnect, "LargestFragmentChooser": _largest, "Uncharger": _uncharge}

    def one(text: str):
        try:
            mol = graph.read((text or "").strip())
        except (ValueError, RecursionError):
            return (False, "", "", False)
        first = before = graph.write(mol)
        log = []
        for step in steps:
            mol = work[step](mol)
            after = graph.write(mol)
            if after != before:
                log.append(f"{step}: {before} → {after}")
            before = after
        return (True, before, "\n".join(log), before != first)

    @F.pandas_udf("struct<ok boolean, smiles string, log string, changed boolean>")
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(t) for t in s], columns=["ok", "smiles", "log", "changed"])

    return run(smiles)
