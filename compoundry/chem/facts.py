"""Structure facts as column expressions over the atom and bond arrays.

A row holds one structure, so every expression works inside the row: no shuffle, no
explode unless the result itself is one row per fragment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from compoundry.chem.kernels import METALS, structure
from compoundry.functions.blocks import tasks_for
from compoundry.functions.once import with_once
from compoundry.functions.skew import join_stats
from compoundry.session import reliable_checkpoint

# Standard atomic weights.
_WEIGHTS = """H 1.008 He 4.0026 Li 6.94 Be 9.0122 B 10.81 C 12.011 N 14.007 O 15.999 F 18.998 Ne 20.180 Na 22.99 Mg 24.305 Al 26.982 Si 28.085 P 30.974 S 32.06 Cl 35.45 Ar 39.95
 K 39.098 Ca 40.078 Sc 44.956 Ti 47.867 V 50.942 Cr 51.996 Mn 54.938 Fe 55.845 Co 58.933 Ni 58.693 Cu 63.546 Zn 65.38 Ga 69.723 Ge 72.630 As 74.922 Se 78.971 Br 79.904 Kr 83.798
 Rb 85.468 Sr 87.62 Y 88.906 Zr 91.224 Nb 92.906 Mo 95.95 Tc 97 Ru 101.07 Rh 102.91 Pd 106.42 Ag 107.868 Cd 112.41 In 114.82 Sn 118.71 Sb 121.76 Te 127.60 I 126.904 Xe 131.29
 Cs 132.91 Ba 137.33 La 138.91 Ce 140.12 Pr 140.91 Nd 144.24 Pm 145 Sm 150.36 Eu 151.96 Gd 157.25 Tb 158.93 Dy 162.50 Ho 164.93 Er 167.26 Tm 168.93 Yb 173.05 Lu 174.97
 Hf 178.49 Ta 180.95 W 183.84 Re 186.21 Os 190.23 Ir 192.22 Pt 195.084 Au 196.97 Hg 200.592 Tl 204.38 Pb 207.2 Bi 208.98 Po 209 At 210 Rn 222
 Fr 223 Ra 226 Ac 227 Th 232.04 Pa 231.04 U 238.03 Np 237 Pu 244 Am 243 Cm 247 Bk 247 Cf 251 Es 252 Fm 257 Md 258 No 259 Lr 262"""
WEIGHTS = {e: float(x) for e, x in zip(_WEIGHTS.split()[::2], _WEIGHTS.split()[1::2], strict=True)}


def with_structure(df: DataFrame, smiles: str, name: str = "mol") -> DataFrame:
    return df.withColumn(name, structure(F.col(smiles)))


def texts_of(df: DataFrame, smiles: str) -> DataFrame:
    """The distinct texts of ``smiles`` with ``n_rows``, dealt over tasks by number, as work on them is far more than their bytes."""
    return df.groupBy(smiles).agg(F.count(F.lit(1)).alias("n_rows")).repartition(tasks_for(df))


def by_text(df: DataFrame, smiles: str, work) -> DataFrame:
    """``work``, a function of the texts alone, done once per distinct text and written; every row gets the columns of its text.

    ``work`` takes and gives a table with ``smiles`` and ``n_rows``, one row per text. A text with many rows is salted.
    """
    return join_stats(df, reliable_checkpoint(work(texts_of(df, smiles))), [smiles], "n_rows").drop("n_rows")


def _count(items: Column, test) -> Column:
    return F.size(F.filter(items, test))


def _sum(items: Column, value) -> Column:
    return F.aggregate(F.transform(items, value), F.lit(0.0), lambda a, b: a + b)


def weight(atoms: Column) -> Column:
    """Molecular weight; null where an element is unknown."""
    table = F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv])
    one = lambda a: F.coalesce(F.when(a["iso"] > 0, a["iso"].cast("double")), F.try_element_at(table, a["el"]))
    return _sum(atoms, lambda a: one(a) + a["h"] * WEIGHTS["H"])


# Bonds of an uncharged atom, lowest first.
VALENCES = {"B": [3], "C": [4], "N": [3, 5], "O": [2], "F": [1], "Si": [4], "P": [3, 5], "S": [2, 4, 6], "Cl": [1], "Br": [1], "I": [1, 3, 5]}


def has_radical(atoms: Column, bonds: Column) -> Column:
    """An atom outside aromatic rings whose bonds and hydrogens fit none of its valences and stay below the highest."""
    table = F.create_map(*[x for el, v in VALENCES.items() for x in (F.lit(el), F.array(*[F.lit(float(n)) for n in v]))])

    def open_shell(a: Column, i: Column) -> Column:
        mine = F.filter(bonds, lambda b: (b["a"] == i) | (b["b"] == i))
        total = _sum(mine, lambda b: b["ord"]) + a["h"]
        # a charge takes a bond from carbon and silicon, and its sign adds to or takes from the others
        charge = F.when(a["el"].isin("C", "Si"), -F.abs(a["chg"])).when(a["el"] == "B", -a["chg"]).otherwise(a["chg"])
        fits = F.transform(F.try_element_at(table, a["el"]), lambda v: v + charge)
        return F.coalesce(~a["arom"] & ~F.array_contains(fits, total.cast("double")) & (total < F.array_max(fits)), F.lit(False))

    return F.exists(F.transform(atoms, open_shell), lambda x: x)


def fragment_sizes(mol: str = "mol", smiles: str = "smiles") -> Column:
    """Heavy atoms of each dot-separated part of the text."""
    atom = r"\[[^\]]*\]|Br|Cl|[BCNOSPFIbcnosp*]"
    part = lambda t: F.size(F.filter(F.regexp_extract_all(t, F.lit(f"({atom})"), F.lit(1)), lambda a: ~a.rlike(r"^\[\d*H[+-]?\]$")))
    return F.transform(F.split(F.trim(F.col(smiles)), r"\."), part)


def facts(df: DataFrame, smiles: str = "smiles", mol: str = "mol") -> DataFrame:
    """Compact descriptors and quality facts of a parsed table."""
    atoms, bonds = F.col(f"{mol}.atoms"), F.col(f"{mol}.bonds")
    heavy = F.filter(atoms, lambda a: a["el"] != "H")
    metals = F.array(*[F.lit(m) for m in sorted(METALS)])
    ok = F.col(f"{mol}.ok")
    at = lambda i: F.element_at(atoms, i + 1)
    saturated = F.filter(F.transform(atoms, lambda a, i: F.struct(a["el"].alias("el"), a["arom"].alias("arom"), i.alias("i"))),
                         lambda a: (a["el"] == "C") & ~a["arom"] & ~F.exists(bonds, lambda b: ((b["a"] == a["i"]) | (b["b"] == a["i"])) & (b["ord"] != 1.0)))
    open_double = F.filter(bonds, lambda b: (b["ord"] == 2.0) & ~b["ring"] & (at(b["a"])["deg"] > 1) & (at(b["b"])["deg"] > 1))
    n_frag = F.size(F.split(F.trim(F.col(smiles)), r"\."))
    n_c = _count(atoms, lambda a: a["el"] == "C")
    sizes = fragment_sizes(mol, smiles)
    cols = {
        "heavy_atoms": F.size(heavy), "molecular_weight": weight(atoms),
        "formal_charge": _sum(atoms, lambda a: a["chg"].cast("double")).cast("int"),
        "n_fragments": n_frag, "largest_fragment_atoms": F.array_max(sizes),
        "n_rings": F.size(bonds) - F.size(atoms) + n_frag,
        "n_hetero_atoms": _count(heavy, lambda a: a["el"] != "C"),
        "aromatic_atoms": _count(atoms, lambda a: a["arom"]),
        "hbd": _count(atoms, lambda a: a["el"].isin("N", "O") & (a["h"] > 0)),
        "hba": _count(atoms, lambda a: a["el"].isin("N", "O")),
        "rotatable_bonds": _count(bonds, lambda b: (b["ord"] == 1.0) & ~b["ring"] & (at(b["a"])["deg"] > 1) & (at(b["b"])["deg"] > 1)),
        "fraction_csp3": F.when(n_c > 0, F.size(saturated) / n_c).otherwise(0.0),
        "has_metal": F.exists(atoms, lambda a: F.array_contains(metals, a["el"])),
        "has_radical": has_radical(atoms, bonds),
        "has_isotope": F.exists(atoms, lambda a: a["iso"] > 0),
        "unassigned_double_bond_stereo": _count(open_double, lambda b: ~b["marked"]),
        "possible_double_bond_stereo": F.size(open_double),
    }
    return df.withColumns({k: F.when(ok, v) for k, v in cols.items()}).withColumns({"ok_parse": ok, "parse_error": F.col(f"{mol}.error")})


# Polar surface by atom environment (published fragment contributions). Element in lower case where
# aromatic, charge, hydrogens, bonds to heavy atoms in the order - : = #, and 3 for a ring of three.
POLAR_SURFACE = {
    "N H0 (---)": 3.24, "N H0 (-=)": 12.36, "N H0 (#)": 23.79, "N H0 (-==)": 11.68, "N H0 (=#)": 13.60, "N H0 (---) 3": 3.01,
    "N H1 (--)": 12.03, "N H1 (--) 3": 21.94, "N H1 (=)": 23.85, "N H2 (-)": 26.02,
    "N+ H0 (----)": 0.00, "N+ H0 (--=)": 3.01, "N+ H0 (-#)": 4.36, "N+ H1 (---)": 4.44, "N+ H1 (-=)": 13.97,
    "N+ H2 (--)": 16.61, "N+ H2 (=)": 25.59, "N+ H3 (-)": 27.64,
    "n H0 (::)": 12.89, "n H0 (:::)": 4.41, "n H0 (-::)": 4.93, "n H0 (::=)": 8.39, "n H1 (::)": 15.79,
    "n+ H0 (:::)": 4.10, "n+ H0 (-::)": 3.88, "n+ H1 (::)": 14.14,
    "O H0 (--)": 9.23, "O H0 (--) 3": 12.53, "O H0 (=)": 17.07, "O H1 (-)": 20.23, "O- H0 (-)": 23.06, "o H0 (::)": 13.14,
}
# For other environments, base, less this for each neighbour, more this for each hydrogen; never below zero.
POLAR_DEFAULTS = {"N": (30.5, 8.2, 1.5), "O": (28.5, 8.6, 1.5)}


def atom_environments(mol: str = "mol") -> Column:
    """One environment key per atom: element, charge, hydrogens, bond multiset, three-ring flag."""
    atoms, bonds = F.col(f"{mol}.atoms"), F.col(f"{mol}.bonds")
    signs = F.create_map(*[F.lit(x) for pair in {1.0: "-", 1.5: ":", 2.0: "=", 3.0: "#"}.items() for x in pair])
    order = F.create_map(*[F.lit(x) for pair in {1.0: 0, 1.5: 1, 2.0: 2, 3.0: 3}.items() for x in pair])
    touches = lambda b, i: (b["a"] == i) | (b["b"] == i)
    other = lambda b, i: F.when(b["a"] == i, b["b"]).otherwise(b["a"])

    def key(a: Column, i: Column) -> Column:
        mine = F.filter(bonds, lambda b: touches(b, i))
        sorted_ = F.transform(F.array_sort(F.transform(mine, lambda b: F.struct(F.try_element_at(order, b["ord"]).alias("o"), b["ord"].alias("ord")))),
                              lambda b: F.coalesce(F.try_element_at(signs, b["ord"]), F.lit("?")))
        near = F.transform(mine, lambda b: other(b, i))
        three = F.exists(bonds, lambda b: ~touches(b, i) & F.array_contains(near, b["a"]) & F.array_contains(near, b["b"]))
        charge = F.when(a["chg"] == 0, "").when(a["chg"] == 1, "+").when(a["chg"] == -1, "-").otherwise(a["chg"].cast("string"))
        return F.concat(F.when(a["arom"], F.lower(a["el"])).otherwise(a["el"]), charge, F.lit(" H"), a["h"].cast("string"),
                        F.lit(" ("), F.array_join(sorted_, ""), F.lit(")"), F.when(three, " 3").otherwise(""))

    return F.transform(atoms, key)


def with_polar_surface(df: DataFrame, mol: str = "mol", name: str = "tpsa", issue: str = "tpsa_default_environments") -> DataFrame:
    """Topological polar surface of nitrogen and oxygen, and the environments that took the default rule.

    All inside the row: the table is a fixed one. Null where the structure is not readable.
    """
    atoms, bonds = F.col(f"{mol}.atoms"), F.col(f"{mol}.bonds")
    table = F.create_map(*[F.lit(x) for pair in POLAR_SURFACE.items() for x in pair])
    out = with_once(df, {"_env": F.transform(F.arrays_zip(atoms.alias("a"), atom_environments(mol).alias("k")),
                                             lambda z, i: F.struct(z["a"]["el"].alias("el"), z["a"]["h"].alias("h"), i.alias("i"), z["k"].alias("k")))})
    polar = F.filter("_env", lambda e: e["el"].isin(*POLAR_DEFAULTS))

    def default(e: Column) -> Column:
        n = F.size(F.filter(bonds, lambda b: (b["a"] == e["i"]) | (b["b"] == e["i"])))
        rule = lambda r: F.greatest(F.lit(r[0]) - n * r[1] + e["h"] * r[2], F.lit(0.0))
        return F.when(e["el"] == "N", rule(POLAR_DEFAULTS["N"])).otherwise(rule(POLAR_DEFAULTS["O"]))

    ok = F.col(f"{mol}.ok")
    value = _sum(polar, lambda e: F.coalesce(F.try_element_at(table, e["k"]), default(e)))
    unlisted = F.array_sort(F.array_distinct(F.filter(F.transform(polar, lambda e: e["k"]), lambda k: F.try_element_at(table, k).isNull())))
    return out.withColumns({name: F.when(ok, value), issue: F.when(ok, unlisted)}).drop("_env")


def contribution_sums(df: DataFrame, ident: str, table: DataFrame, mol: str = "mol") -> DataFrame:
    """ident, value, unknown: a supplied table (environment, contribution) summed per readable structure.

    An additive property such as logP: atoms meet the table by their environment key, counted per structure
    first; any environment the table lacks makes the value null and is listed in ``unknown``.
    """
    rows = df.where(F.col(f"{mol}.ok")).select(F.col(ident).alias("_id"), F.explode(atom_environments(mol)).alias("environment"))
    counts = rows.groupBy("_id", "environment").agg(F.count(F.lit(1)).alias("n"))
    known = counts.join(table.select("environment", F.col("contribution").cast("double").alias("c")).dropDuplicates(["environment"]), "environment", "left")
    return known.groupBy("_id").agg(
        F.when(F.count_if(F.col("c").isNull()) == 0, F.sum(F.col("n") * F.col("c"))).alias("value"),
        F.array_sort(F.collect_set(F.when(F.col("c").isNull(), F.col("environment")))).alias("unknown")).withColumnRenamed("_id", ident)


def formula(atoms: Column) -> Column:
    """Elements with counts: C, H, then by name."""
    hydrogens = _sum(atoms, lambda a: a["h"].cast("double")).cast("int") + _count(atoms, lambda a: a["el"] == "H")
    names = F.array_sort(F.array_distinct(F.transform(atoms, lambda a: a["el"])))
    part = lambda e, n: F.concat(e, F.when(n > 1, n.cast("string")).otherwise(""))
    carbon = _count(atoms, lambda a: a["el"] == "C")
    others = F.transform(F.filter(names, lambda e: ~e.isin("C", "H")), lambda e: part(e, _count(atoms, lambda a: a["el"] == e)))
    return F.concat(F.when(carbon > 0, part(F.lit("C"), carbon)).otherwise(""),
                    F.when(hydrogens > 0, part(F.lit("H"), hydrogens)).otherwise(""), F.array_join(others, ""))


def _refine(bonds: Column, ids: Column):
    """One refinement round: own identifier hashed with the sorted bonded neighbours."""
    def step(value: Column, i: Column) -> Column:
        mine = F.filter(bonds, lambda b: (b["a"] == i) | (b["b"] == i))
        other = lambda b: F.element_at(ids, F.when(b["a"] == i, b["b"]).otherwise(b["a"]) + 1)
        return F.xxhash64(value, F.array_sort(F.transform(mine, lambda b: F.xxhash64(b["ord"], other(b)))))

    return step


def circular_bits(df: DataFrame, mol: str = "mol", name: str = "bits", radius: int = 2, n_bits: int = 2048) -> DataFrame:
    """Circular fingerprint: atom identifiers refined ``radius`` times over their neighbours.

    Sorted distinct bit numbers; built with array functions, one column per round.
    """
    atoms, bonds = F.col(f"{mol}.atoms"), F.col(f"{mol}.bonds")
    # Each round is computed once; inlined into the next it would be redone per atom.
    out = with_once(df, {"_id0": F.transform(atoms, lambda a: F.xxhash64(a["el"], a["arom"], a["chg"], a["h"], a["deg"], a["ring"]))})
    for r in range(1, radius + 1):
        out = with_once(out, {f"_id{r}": F.transform(f"_id{r - 1}", _refine(bonds, F.col(f"_id{r - 1}")))})
    ids = F.concat(*[F.col(f"_id{r}") for r in range(radius + 1)])
    bits = F.array_sort(F.array_distinct(F.transform(ids, lambda h: F.pmod(h, F.lit(n_bits)).cast("int"))))
    return out.withColumn(name, F.when(F.col(f"{mol}.ok"), bits)).drop(*[f"_id{r}" for r in range(radius + 1)])


def path_fragments(df: DataFrame, keep: list[str], mol: str = "mol", min_atoms: int = 2, max_atoms: int = 4) -> DataFrame:
    """keep, fragment, count: linear atom-bond sequences of each structure, long form.

    Paths grow by one atom per round inside the row; a path and its reverse count once.
    """
    atoms, bonds = F.col(f"{mol}.atoms"), F.col(f"{mol}.bonds")
    sym = {1.0: "-", 1.5: ":", 2.0: "=", 3.0: "#"}
    table = F.create_map(*[x for k, v in sym.items() for x in (F.lit(k), F.lit(v))])
    label = lambda a: F.when(a["arom"], F.lower(a["el"])).otherwise(a["el"])
    at = lambda i: label(F.element_at(atoms, i + 1))
    start = F.transform(atoms, lambda a, i: F.struct(F.array(i).alias("p"), F.array(label(a)).alias("t")))
    out = with_once(df.select(*keep, F.col(mol)).where(F.col(f"{mol}.ok")), {"_paths0": start})
    every = ["_paths0"]
    for _ in range(max_atoms - 1):
        def longer(path: Column) -> Column:
            last = F.element_at(path["p"], -1)
            steps = F.filter(bonds, lambda b: ((b["a"] == last) & ~F.array_contains(path["p"], b["b"])) | ((b["b"] == last) & ~F.array_contains(path["p"], b["a"])))
            nxt = lambda b: F.when(b["a"] == last, b["b"]).otherwise(b["a"])
            return F.transform(steps, lambda b: F.struct(
                F.array_append(path["p"], nxt(b)).alias("p"),
                F.concat(path["t"], F.array(F.element_at(table, b["ord"]), at(nxt(b)))).alias("t")))
        every.append(f"_paths{len(every)}")
        out = with_once(out, {every[-1]: F.flatten(F.transform(every[-2], longer))})
    one = out.select(*keep, F.explode(F.concat(*every)).alias("p"))
    n = F.size("p.p")
    one = one.where((n >= min_atoms) & ((n == 1) | (F.element_at("p.p", 1) < F.element_at("p.p", -1))))
    text = F.array_join("p.t", "")
    return one.select(*keep, F.least(text, F.array_join(F.reverse("p.t"), "")).alias("fragment")).groupBy(*keep, "fragment").agg(
        F.count(F.lit(1)).alias("count"))


def shell_fragments(df: DataFrame, keep: list[str], mol: str = "mol") -> DataFrame:
    """Atom-centred fragments of radius one: centre and its sorted bonded neighbours."""
    atoms, bonds = F.col(f"{mol}.atoms"), F.col(f"{mol}.bonds")
    sym = F.create_map(*[x for k, v in {1.0: "-", 1.5: ":", 2.0: "=", 3.0: "#"}.items() for x in (F.lit(k), F.lit(v))])
    label = lambda a: F.when(a["arom"], F.lower(a["el"])).otherwise(a["el"])

    def shell(a: Column, i: Column) -> Column:
        mine = F.filter(bonds, lambda b: (b["a"] == i) | (b["b"] == i))
        near = F.transform(mine, lambda b: F.concat(F.element_at(sym, b["ord"]), label(F.element_at(atoms, F.when(b["a"] == i, b["b"]).otherwise(b["a"]) + 1))))
        return F.concat(label(a), F.lit("("), F.array_join(F.array_sort(near), ""), F.lit(")"))

    return df.where(F.col(f"{mol}.ok")).select(*keep, F.explode(F.transform(atoms, shell)).alias("fragment")).groupBy(*keep, "fragment").agg(
        F.count(F.lit(1)).alias("count"))


def fragment_vocabulary(fragments: DataFrame, min_support: int = 1, n_rows: str | None = None) -> DataFrame:
    """fragment, support: in how many structures it occurs (``n_rows``: a column with the rows a line stands for), kept from ``min_support``."""
    support = F.count(F.lit(1)) if n_rows is None else F.sum(n_rows)
    return fragments.groupBy("fragment").agg(support.alias("support")).where(F.col("support") >= min_support).orderBy("fragment")


def fragment_matrix(fragments: DataFrame, vocabulary: list[str], ident: str) -> DataFrame:
    """Wide count table over a fixed vocabulary (absent = 0)."""
    wide = fragments.where(F.col("fragment").isin(vocabulary)).groupBy(ident).pivot("fragment", vocabulary).agg(F.sum("count"))
    return wide.na.fill(0, vocabulary)


def low_variance_bits(df: DataFrame, bits: str, threshold: float = 0.01) -> DataFrame:
    """bit, n_on, variance of the bits worth keeping (at least the most variable one)."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    on = df.select(F.explode(bits).alias("bit")).groupBy("bit").agg(F.count(F.lit(1)).alias("n_on")).crossJoin(F.broadcast(n))
    p = F.col("n_on") / F.col("_n")
    var = on.select("bit", "n_on", (p * (1 - p)).alias("variance"))
    top = var.agg(F.max("variance").alias("_m"))
    return var.crossJoin(F.broadcast(top)).where((F.col("variance") >= threshold) | ((F.col("_m") < threshold) & (F.col("variance") == F.col("_m")))).drop("_m")
