"""Molecule and activity files: delimited tables, SMILES lines, structure records."""

from __future__ import annotations

from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from compoundry.chem import graph
from compoundry.functions.missing import text

# File endings per format.
FORMATS = {".csv": "csv", ".txt": "csv", ".tsv": "tsv", ".tab": "tsv", ".smi": "smi", ".smiles": "smi", ".sdf": "sdf", ".sd": "sdf"}
# Column names looked for in molecule tables, best first.
SMILES_COLUMNS = ("smiles", "canonical smiles", "standardized smiles", "mol smiles", "structure")
NAME_COLUMNS = ("name", "compound name", "title", "compound id", "molecule id", "mol id", "chembl id", "id")


def detect_format(path: str) -> str:
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
    if suffix not in FORMATS:
        raise ValueError(f"unsupported molecule file: {path}")
    return FORMATS[suffix]


def sniff_delimiter(spark: SparkSession, path: str) -> tuple[str, str]:
    """(separator, warning): the candidate that splits the first lines evenly, else a comma."""
    head = [r["value"] for r in spark.read.text(path).limit(20).collect()]
    sample = "\n".join(head)[:4096].split("\n")
    best, most = ",", 0
    for sep in (",", "\t", ";"):
        counts = {line.count(sep) for line in sample if line.strip()}
        if len(counts) == 1 and max(counts) > most:
            best, most = sep, max(counts)
    return best, "" if most else f"Could not auto-detect delimiter for '{PurePosixPath(path).name}'. Falling back to ','."


def with_row_index(df: DataFrame, name: str = "row_index", start: int = 1) -> DataFrame:
    """Dense position in file order.

    ``df`` must come straight from a file scan with the columns ``_file`` and ``_block``
    (see `located`).  Each split counts its rows; the running sum over splits (a table of
    one row per split) gives the offsets.
    """
    seq = df.withColumn("_m", F.monotonically_increasing_id())
    per = seq.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_lo"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offset = per.select("_file", "_block", "_lo", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    out = seq.join(offset, ["_file", "_block"])
    return out.withColumn(name, F.col("_off") + F.col("_m") - F.col("_lo") + start).drop("_file", "_block", "_m", "_lo", "_off")


def located(df: DataFrame) -> DataFrame:
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))


def read_delimited(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Header table with text columns and the 1-based row_index."""
    sep = {"\\t": "\t"}.get(sep or "", sep) or ("\t" if detect_format(path) == "tsv" else sniff_delimiter(spark, path)[0])
    return with_row_index(located(spark.read.option("header", True).option("sep", sep).csv(path)))


def read_smiles_lines(spark: SparkSession, path: str) -> DataFrame:
    """row_index, smiles, name: first token and rest of each line; blank and # lines skipped."""
    lines = located(spark.read.text(path))
    t = F.trim("value")
    rows = with_row_index(lines.where((t != "") & ~t.startswith("#")))
    parts = F.split(F.trim("value"), r"\s+", 2)
    name = F.coalesce(F.trim(F.try_element_at(parts, F.lit(2))), F.lit(""))
    return rows.select("row_index", parts[0].alias("smiles"),
                       F.when(name == "", F.concat(F.lit("mol_"), F.col("row_index").cast("string"))).otherwise(name).alias("name"))


def _block_smiles(block: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([graph.block_text(t) for t in s], dtype=object)

    return run(block)


def read_structure_records(spark: SparkSession, path: str, name_prop: str | None = None,
                           keep_props: list[str] | None = None, max_records: int | None = None) -> DataFrame:
    """row_index, name, smiles, ok, error, props of a structure-record file.

    A record that cannot be read stays as a row with ok = false.
    """
    raw = located(spark.read.option("lineSep", "$$$$").text(path))
    raw = with_row_index(raw.where(F.trim(F.regexp_replace("value", r"\s", "")) != ""))
    body = F.regexp_replace(F.regexp_replace("value", "\r", ""), r"^\n", "")
    rows = raw.select("row_index", body.alias("block"))
    keys = F.regexp_extract_all("block", F.lit(r"(?m)^>[^<\n]*<([^>\n]+)>"), F.lit(1))
    values = F.regexp_extract_all("block", F.lit(r"(?m)^>[^<\n]*<[^>\n]+>[^\n]*\n((?:[^\n>][^\n]*\n?)*)"), F.lit(1))
    named = F.arrays_zip(keys.alias("k"), F.transform(values, lambda v: F.trim(F.regexp_replace(v, r"\n+$", ""))).alias("v"))
    # of a repeated key the first value stays, as its key does
    first = F.filter(named, lambda e, i: F.array_position(keys, e["k"]) == i + 1)
    props = F.map_from_arrays(F.transform(first, lambda e: e["k"]), F.transform(first, lambda e: e["v"]))
    rows = rows.withColumns({"props": props, "smiles": _block_smiles(F.col("block")), "_title": F.trim(F.split_part("block", F.lit("\n"), F.lit(1)))})
    if keep_props is not None:
        rows = rows.withColumn("props", F.map_filter("props", lambda k, v: k.isin(keep_props)))
    ok = F.col("smiles").isNotNull()
    named = F.try_element_at("props", F.lit(name_prop)) if name_prop else F.lit(None)
    out = rows.select("row_index", F.coalesce(F.nullif(text(named), F.lit("")), F.nullif("_title", F.lit("")),
                                              F.concat(F.lit("mol_"), F.col("row_index").cast("string"))).alias("name"),
                      F.coalesce("smiles", F.lit("")).alias("smiles"), ok.alias("ok"),
                      F.when(ok, "").otherwise("Could not read the structure record.").alias("error"), "props")
    return out.orderBy("row_index").limit(max_records) if max_records else out


def find_column(columns: list[str], preferred: str | None, candidates: tuple[str, ...]) -> str:
    """Named column (must exist) or the first candidate present, else an empty text."""
    if preferred:
        hit = next((c for c in columns if c.strip().lower() == preferred.strip().lower()), None)
        if hit is None:
            raise ValueError(f"Column '{preferred}' was not found. Available columns: {', '.join(columns)}")
        return hit
    key = lambda c: c.strip().lower().replace("_", " ").replace("-", " ")
    by = {key(c): c for c in columns}
    return next((by[c] for c in candidates if c in by), "")


def import_molecules(spark: SparkSession, path: str, smiles_column: str | None = None, name_column: str | None = None,
                     sep: str | None = None, key: str = "canonical", reject_duplicates: bool = False) -> DataFrame:
    """Read any supported file, parse structures and apply the import gate."""
    from compoundry.chem import kernels
    from compoundry.operators.contract import add_step, fill_contract
    from compoundry.operators.intake import annotate_import

    fmt = detect_format(path)
    if fmt == "smi":
        rows = read_smiles_lines(spark, path)
    elif fmt == "sdf":
        rows = read_structure_records(spark, path).drop("ok", "error")
    else:
        table = read_delimited(spark, path, sep)
        smiles, name = find_column(table.columns, smiles_column, SMILES_COLUMNS), find_column(table.columns, name_column, NAME_COLUMNS)
        if not smiles:
            raise ValueError("No SMILES column found.")
        label = text(F.col(name)) if name else F.lit("")
        rows = table.select("*", text(F.col(smiles)).alias("_smi"), label.alias("_name")).drop(*{smiles, name} - {""})
        rows = rows.withColumnsRenamed({"_smi": "smiles", "_name": "name"})
    parsed = rows.withColumn("canonical_smiles", kernels.canonical(F.col("smiles")))
    ok = F.col("canonical_smiles").isNotNull()
    parsed = parsed.withColumns({"ok": ok, "error": F.when(ok, "").when(text(F.col("smiles")) == "", "Empty SMILES.").otherwise("Invalid SMILES."),
                                 "canonical_smiles": F.coalesce("canonical_smiles", F.lit(""))})
    parsed = fill_contract(parsed, fmt, "row_index", "smiles", name="name").drop("qc_flags")
    gated = annotate_import(parsed, "canonical_smiles", "ok", "error", reject_duplicates=reject_duplicates, key_label="canonical_smiles")
    return add_step(gated, "import")
