"""Detail tables of compounds: pattern tables, motifs without repeats, query tables and search profiles.

A hit is a row (ident, category, key, name, smarts, atoms, match_count, family, superclass, source): one pattern
that occurs in one structure. The hits of a structure are bounded by the pattern table; all tables are made for every
compound at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HETEROCYCLE, FUNCTIONAL = "heterocycle", "functional_group"
ATTRIBUTES = ("key", "category", "name", "smarts", "family", "superclass", "source")
# What a search profile holds where nothing was chosen.
THRESHOLD, LOGIC, MODE = 0.35, "or", "hybrid"


def _text(name: str) -> Column:
    return F.coalesce(F.trim(F.col(name).cast("string")), F.lit(""))


def _known(df: DataFrame, name: str, default: str = "") -> Column:
    return F.coalesce(F.nullif(_text(name), F.lit("")), F.lit(default)) if name in df.columns else F.lit(default)


def functional_patterns(table: DataFrame) -> DataFrame:
    """key, category, name, smarts, source of the functional groups of a supplied pattern table.

    Rows of other categories and rows without a name or pattern are left out; a missing key is the name in
    lower case with underscores.
    """
    rows = table.where(F.lower(_text("category")).isin("functional_groups", FUNCTIONAL) & (_text("smarts") != "") & (_text("name") != ""))
    slug = F.replace(F.lower(_text("name")), F.lit(" "), F.lit("_"))
    key = F.coalesce(F.nullif(_known(table, "pattern_id"), F.lit("")), slug)
    return rows.select(key.alias("key"), F.lit(FUNCTIONAL).alias("category"), _text("name").alias("name"), _text("smarts").alias("smarts"),
                       _known(table, "source").alias("source"))


def heterocycle_patterns(table: DataFrame) -> DataFrame:
    """key, category, name, smarts, family, superclass of the true heterocycles of a supplied registry table."""
    rows = table.where(F.coalesce(F.col("is_true_heterocycle").cast("boolean"), F.lit(False)) & (_text("smarts") != "") & (_text("name") != ""))
    family = F.coalesce(F.nullif(_known(table, "heterocycle_family_normalized"), F.lit("")), _known(table, "heterocycle_family"))
    key = F.coalesce(F.nullif(_known(table, "pattern_id"), F.lit("")), _text("name"))
    return rows.select(key.alias("key"), F.lit(HETEROCYCLE).alias("category"), _text("name").alias("name"), _text("smarts").alias("smarts"),
                       family.alias("family"), _known(table, "heterocycle_superclass").alias("superclass"))


def _precedence() -> Column:
    """Heterocycles first, then hits with a family, many atoms, many matches, by name and key."""
    return F.struct((F.col("category") != HETEROCYCLE).alias("a"), (_text("family") == "").alias("b"), (-F.size("atoms")).alias("c"),
                    (-F.col("match_count")).alias("d"), F.lower("name").alias("e"), F.lower("key").alias("f"),
                    F.col("name").alias("g"), F.col("key").alias("h"), F.col("smarts").alias("i"))


def distinct_motifs(hits: DataFrame, ident: str) -> DataFrame:
    """The best hit for each category and atom set of a compound, with its place among the compound's motifs.

    Atoms are compared as sorted sets. Equal hits count once; hits without atoms or without an id are left out.
    """
    sets = hits.where(F.col(ident).isNotNull() & (F.size("atoms") > 0)).withColumn("atoms", F.array_sort(F.array_distinct("atoms")))
    rest = [c for c in hits.columns if c not in (ident, "category", "atoms")]
    best = sets.groupBy(ident, "category", "atoms").agg(F.min_by(F.struct(*rest), _precedence()).alias("_best"))
    best = best.select(ident, "category", "atoms", *[F.col("_best")[c].alias(c) for c in rest])
    return best.withColumn("place", F.row_number().over(Window.partitionBy(ident).orderBy(_precedence()))).select(*hits.columns, "place")


def motif_table(motifs: DataFrame, ident: str) -> DataFrame:
    """Motifs as a flat table: counts as numbers, atoms as one text, unknown attributes as empty texts."""
    return motifs.select(ident, "place", *[_text(c).alias(c) for c in ATTRIBUTES], F.col("match_count").cast("double").alias("match_count"),
                         F.size("atoms").cast("double").alias("matched_atom_count"), F.array_join("atoms", ", ").alias("matched_atoms"))


def query_patterns(table: DataFrame, keep: list[str]) -> DataFrame:
    """keep, pattern: the pattern of each row of a query table, or its structure text; rows with neither are left out."""
    pattern = F.coalesce(F.nullif(_known(table, "smarts"), F.lit("")), _known(table, "smiles"))
    return table.select(*keep, pattern.alias("pattern")).where("pattern <> ''")


def _joined(rows: DataFrame, ident: str, order: Column, texts: dict[str, Column], count: str | None = None) -> DataFrame:
    """One row per compound: each text of its rows in order, joined by a bar."""
    listed = F.array_sort(F.collect_list(F.struct(order.alias("o"), *[v.alias(k) for k, v in texts.items()])))
    out = rows.groupBy(ident).agg(listed.alias("_l"))
    cols = [F.array_join(F.col("_l")[k], "|").alias(k) for k in texts]  # nulls are left out of a join
    return out.select(ident, *cols, *([F.size("_l").alias(count)] if count else []))


def search_profiles(compounds: DataFrame, ident: str, fragments: DataFrame, motifs: DataFrame, n_patterns: int,
                    threshold: float = THRESHOLD, logic: str = LOGIC, mode: str = MODE) -> DataFrame:
    """One profile per compound (ident, smiles, murcko, generic): bar-joined fragments and chosen motifs, coverage.

    ``fragments`` holds one row per (compound, fragment) with ``name``, ``category``, ``key``, ``smarts`` and
    ``smiles``; ``motifs`` the chosen rows of ``distinct_motifs``. Compounds without either have empty lists.
    """
    order = F.struct(F.lower("category").alias("a"), F.lower("name").alias("b"), F.col("key").alias("c"))
    shown = F.coalesce(F.nullif(_text("smarts"), F.lit("")), _known(fragments, "smiles"))
    f = _joined(fragments, ident, order, {"fragment_names": _text("name"), "fragment_smarts": shown}, "n_fragments")
    smarts = F.nullif(_text("smarts"), F.lit(""))
    m = _joined(motifs, ident, F.struct("place"), {"motif_names": _text("name"), "motif_smarts": smarts})
    out = compounds.select(ident, *[_text(c).alias(c) for c in ("smiles", "murcko", "generic")]).join(f, ident, "left").join(m, ident, "left")
    n = F.coalesce("n_fragments", F.lit(0))
    return out.select(ident, "smiles", "murcko", "generic", F.lit(float(threshold)).alias("similarity_threshold"), n.cast("double").alias("n_fragments"),
                      (n / F.lit(n_patterns) if n_patterns else F.lit(0.0)).alias("coverage"),
                      *[F.coalesce(c, F.lit("")).alias(c) for c in ("fragment_names", "fragment_smarts", "motif_names", "motif_smarts")],
                      F.lit(logic).alias("motif_logic"), F.lit(mode).alias("search_mode"))


def profile_queries(profiles: DataFrame, ident: str) -> DataFrame:
    """Profiles read back: texts trimmed, a missing threshold or logic takes its fixed value."""
    number = F.coalesce(F.col("similarity_threshold").try_cast("double"), F.lit(THRESHOLD))
    return profiles.select(ident, *[_text(c).alias(c) for c in ("smiles", "murcko", "generic")], number.alias("similarity_threshold"),
                           _known(profiles, "motif_logic", LOGIC).alias("motif_logic"))
