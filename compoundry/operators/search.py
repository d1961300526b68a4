"""Structure search of a table with one query text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compoundry.chem import graph, kernels, patterns

# Marks that only occur in patterns, not in plain structure texts.
PATTERN_MARKS = ("[#", ";", "!", "&", ",", "~", "@", "*", "$(")
MODES = ("substructure", "superstructure", "exact", "similarity")


def looks_like_pattern(query: str) -> bool:
    return any(m in (query or "").strip() for m in PATTERN_MARKS)


def read_query(query: str, mode: str) -> str:
    """Checked query text: patterns stay as they are, structures become canonical for exact search."""
    q = (query or "").strip()
    if not q:
        raise ValueError("Empty query.")
    mol = graph.cached(q)
    if mode in ("similarity", "exact", "superstructure"):
        if mol is None:
            raise ValueError("Invalid SMILES query.")
        return graph.write(mol)
    if mol is not None and not looks_like_pattern(q):
        return _structure_pattern(q)
    try:
        patterns.compile_pattern(q)
    except (ValueError, IndexError) as exc:
        raise ValueError("Invalid query (neither SMILES nor SMARTS).") from exc
    return q


def _structure_pattern(text: str) -> str:
    """A structure text works as a pattern once kekulé rings are written aromatic."""
    out = graph.write(graph.read(text))
    try:
        patterns.compile_pattern(out)
        return out
    except (ValueError, IndexError):
        return text


def search(df: DataFrame, smiles: str, query: str, mode: str = "substructure", threshold: float = 0.7) -> DataFrame:
    """Rows that contain, are contained in, equal or resemble the query."""
    if mode not in MODES:
        raise ValueError(f"unknown search mode: {mode!r}")
    q = read_query(query, mode)
    if mode == "substructure":
        hits = kernels.pattern_hits(F.col(smiles), ["query"], [q])
        out = df.withColumn("_h", hits).where(F.size("_h") > 0)
        return out.withColumn("highlight_atoms", F.array_join(F.transform(F.col("_h")[0]["atoms"], lambda i: i.cast("string")), ",")).drop("_h")
    if mode == "superstructure":
        from compoundry.chem.facts import by_text

        return by_text(df, smiles, lambda texts: texts.withColumn("_in", kernels.contained_in(F.col(smiles), q))).where("_in").drop("_in")
    if mode == "exact":
        return df.where(kernels.canonical(F.col(smiles)) == F.lit(q))
    from compoundry.chem.facts import circular_bits, with_structure
    from compoundry.operators.similarity import tanimoto_sets

    one = df.sparkSession.createDataFrame([(q,)], "q string")
    # The query is a single row.
    bits = circular_bits(with_structure(one, "q", "_qm"), "_qm", "_qb").select("_qb")
    rows = circular_bits(with_structure(df, smiles, "_m"), "_m", "_b").crossJoin(F.broadcast(bits))
    out = rows.withColumn("similarity", tanimoto_sets(F.col("_b"), F.col("_qb"))).where(F.col("_b").isNotNull())
    return out.where(F.col("similarity") >= threshold).drop("_m", "_b", "_qb")
