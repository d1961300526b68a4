"""Topological distances, triplets and path prints over exploded atom and bond rows.

Everything is worked out once per distinct structure: rows that share a text share its class, so a
text that fills a third of the table costs as much as any other. A class is bounded by its structure.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compoundry.chem import facts
from compoundry.session import reliable_checkpoint


@dataclass(frozen=True)
class Classes:
    """Distinct readable structures: parsed rows, and which row belongs to which."""

    parsed: DataFrame  # _class, n (rows), mol
    members: DataFrame  # ident, _class


def structure_classes(df: DataFrame, ident: str, smiles: str) -> Classes:
    """One class per distinct trimmed text; unreadable, empty and null texts belong to none."""
    texts = df.select(F.col(ident), F.trim(F.col(smiles)).alias("_class")).where("_class <> ''")
    sizes = texts.groupBy("_class").agg(F.count(F.lit(1)).alias("n"))
    parsed = reliable_checkpoint(facts.with_structure(sizes, "_class").where("mol.ok"))
    return Classes(parsed, texts)


def bond_rows(parsed: DataFrame, key: str = "_class", mol: str = "mol") -> DataFrame:
    """key, a, b: every bond in both directions."""
    one = parsed.select(key, F.explode(f"{mol}.bonds").alias("e")).select(key, F.col("e.a").alias("a"), F.col("e.b").alias("b"))
    return one.unionByName(one.select(key, F.col("b").alias("a"), F.col("a").alias("b")))


def distances(parsed: DataFrame, longest: int, key: str = "_class", mol: str = "mol") -> DataFrame:
    """key, a, b, d: shortest bond counts from 1 to ``longest`` between different atoms, both directions.

    A frontier of pairs moves one bond per round; pairs seen before leave it, so a pair is met once per
    neighbour of its end and never twice in the result. Atoms that no path joins have no row.
    """
    bonds = bond_rows(parsed, key, mol)
    step = bonds.select(key, F.col("a").alias("b"), F.col("b").alias("_next"))
    seen = bonds.withColumn("d", F.lit(1))
    frontier = seen
    for d in range(2, longest + 1):
        reached = frontier.join(step, [key, "b"]).where("a <> _next").select(key, "a", F.col("_next").alias("b")).distinct()
        frontier = reliable_checkpoint(reached.join(seen, [key, "a", "b"], "left_anti").withColumn("d", F.lit(d)))
        seen = seen.unionByName(frontier)
    return seen


def triplets(classes: Classes, shortest: int = 2, longest: int = 4, max_atoms: int | None = 60) -> DataFrame:
    """_class, fragment, count: three atoms by their sorted elements and sorted distances.

    Every distance is at most ``longest`` and one is at least ``shortest``. Structures of more than
    ``max_atoms`` atoms have no triplets (the rule of the descriptor; None lifts it). The rows grow with the
    third power of the atoms within reach, not of the structure: pairs beyond ``longest`` are never made.
    """
    parsed = classes.parsed if max_atoms is None else classes.parsed.where(F.size("mol.atoms") <= max_atoms)
    d = distances(parsed, longest).where("a < b")
    el = parsed.select("_class", F.posexplode("mol.atoms").alias("i", "atom")).select("_class", "i", F.col("atom.el").alias("el"))
    name = lambda at, out: el.select("_class", F.col("i").alias(at), F.col("el").alias(out))
    named = d.join(name("a", "ea"), ["_class", "a"]).join(name("b", "eb"), ["_class", "b"])
    first = named.select("_class", "a", F.col("b").alias("j"), F.col("d").alias("d1"), "ea", F.col("eb").alias("e1"))
    second = named.select("_class", "a", F.col("b").alias("k"), F.col("d").alias("d2"), F.col("eb").alias("e2"))
    third = d.select("_class", F.col("a").alias("j"), F.col("b").alias("k"), F.col("d").alias("d3"))
    met = first.join(second, ["_class", "a"]).where("j < k").join(third, ["_class", "j", "k"])
    met = met.where(F.greatest("d1", "d2", "d3") >= shortest)
    text = F.concat(F.array_join(F.array_sort(F.array("ea", "e1", "e2")), "."), F.lit("-"),
                    F.array_join(F.transform(F.array_sort(F.array("d1", "d2", "d3")), lambda x: x.cast("string")), "."))
    return met.groupBy("_class", text.alias("fragment")).agg(F.count(F.lit(1)).alias("count"))


def class_vocabulary(fragments: DataFrame, classes: Classes, min_support: int = 1) -> DataFrame:
    """fragment, support: in how many rows a fragment occurs, from class sizes, kept from ``min_support``."""
    return fragments.join(classes.parsed.select("_class", "n"), "_class").groupBy("fragment").agg(F.sum("n").alias("support")).where(
        F.col("support") >= min_support)


def path_bits(classes: Classes, max_bonds: int = 7, n_bits: int = 2048) -> DataFrame:
    """_class, bits: sorted distinct bits of all linear paths of one to ``max_bonds`` bonds.

    A bit is the first 32 bits of the path text's md5, modulo ``n_bits``; the numbers are this package's own.
    Readable structures without a bond have an empty list.
    """
    paths = facts.path_fragments(classes.parsed, ["_class"], min_atoms=2, max_atoms=max_bonds + 1)
    bit = F.pmod(F.conv(F.substring(F.md5(F.col("fragment")), 1, 8), 16, 10).cast("long"), F.lit(n_bits)).cast("int")
    bits = paths.groupBy("_class").agg(F.array_sort(F.collect_set(bit)).alias("bits"))
    return classes.parsed.select("_class").join(bits, "_class", "left").select(
        "_class", F.coalesce("bits", F.array().cast("array<int>")).alias("bits"))
