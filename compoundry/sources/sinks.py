"""Writers: delimited tables, SMILES lines, structure records, result folders."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from compoundry.chem import graph
from compoundry.functions.missing import text
from compoundry.operators.rules import metric_rows

EXPORT_FORMATS = {".csv": "csv", ".tsv": "tsv", ".txt": "tsv", ".smi": "smi", ".smiles": "smi", ".sdf": "sdf"}


def detect_export_format(path: str, explicit: str | None = None) -> str:
    if explicit and explicit.lower() != "auto":
        return explicit.lower().lstrip(".")
    for end, fmt in EXPORT_FORMATS.items():
        if path.lower().rstrip("/").endswith(end):
            return fmt
    raise ValueError(f"unsupported export format: {path}")


def export_records(df: DataFrame, smiles: str, name: str | None = None, canonical: str | None = None,
                   use_canonical: bool = True, row_index: str = "row_index") -> DataFrame:
    """Export view: output structure, name, the other columns as a text map, and a status.

    A row without a structure text is not written and says so.
    """
    out = F.col(smiles)
    if canonical and use_canonical:
        out = F.coalesce(F.nullif(text(F.col(canonical)), F.lit("")), out)
    label = F.coalesce(F.nullif(text(F.col(name)), F.lit("")) if name else F.lit(None).cast("string"),
                       F.concat(F.lit("mol_"), F.col(row_index).cast("string")))
    rest = sorted(c for c in df.columns if c not in {smiles, name, canonical, row_index})
    props = F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in rest]), F.array(*[F.col(c).cast("string") for c in rest])),
                         lambda k, v: v.isNotNull()) if rest else F.create_map().cast("map<string,string>")
    good = text(out) != ""
    return df.select(F.col(row_index).alias("row_index"), text(out).alias("SMILES"), label.alias("Name"), props.alias("props"),
                     F.when(good, "written").otherwise("failed").alias("status"),
                     F.when(good, "").otherwise("No structure to export.").alias("error"))


def export_report(records: DataFrame) -> DataFrame:
    """Per-row report with the properties as JSON text."""
    return records.select("row_index", "Name", "SMILES", "status", "error", F.to_json("props").alias("props_json"))


def export_summary(records: DataFrame) -> DataFrame:
    one = records.agg(F.count(F.lit(1)).alias("total_records"), F.count_if(F.col("status") == "written").alias("written_records"),
                      F.count_if(F.col("status") != "written").alias("failed_records"))
    return metric_rows(one, {"total_records": "All input records.", "written_records": "Records written.", "failed_records": "Records not written."})


def property_columns(records: DataFrame) -> list[str]:
    """Sorted union of the property keys (a list of column names)."""
    return [r["k"] for r in records.select(F.explode(F.map_keys("props")).alias("k")).distinct().orderBy("k").collect()]


def _molblock(smiles: Column, name: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for text_, label in zip(s, n):
            table = graph.table_of(text_)
            out.append(None if table is None else label + table)
        return pd.Series(out, dtype=object)

    return run(smiles, name)


def write_molecules(records: DataFrame, path: str, fmt: str | None = None, mode: str = "overwrite") -> str:
    """Write the rows with status ``written`` as a folder of csv, tsv, smi or sdf parts."""
    fmt = detect_export_format(path, fmt)
    rows = records.where(F.col("status") == "written")
    if fmt == "smi":
        rows.select(F.concat_ws("\t", "SMILES", "Name").alias("value")).write.mode(mode).text(path)
    elif fmt in ("csv", "tsv"):
        props = [F.try_element_at("props", F.lit(k)).alias(k) for k in property_columns(records)]
        rows.select("SMILES", "Name", *props).write.mode(mode).option("header", True).option("sep", "," if fmt == "csv" else "\t").csv(path)
    elif fmt == "sdf":
        lines = F.array_join(F.transform(F.map_entries("props"), lambda e: F.concat(F.lit("> <"), e["key"], F.lit(">\n"), e["value"], F.lit("\n\n"))), "")
        block = F.concat(_molblock(F.col("SMILES"), F.col("Name")), F.lit("\n"), lines, F.lit("$$$$"))
        rows.select(block.alias("value")).where(F.col("value").isNotNull()).write.mode(mode).text(path)
    else:
        raise ValueError(f"unsupported export format: {fmt}")
    return path


def flat(df: DataFrame) -> DataFrame:
    """Arrays and maps as text, so that delimited files can hold them."""
    cols = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        cols.append((F.concat_ws(" | ", c.cast("array<string>")) if kind == "array" else F.to_json(c) if kind in ("map", "struct") else c).alias(f.name))
    return df.select(*cols)


def write_tables(tables: dict[str, DataFrame], prefix: str, fmt: str = "csv", summary: dict | None = None, mode: str = "overwrite") -> dict[str, str]:
    """One folder per result table next to each other, plus an optional JSON summary."""
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{prefix}.{name}"
        writer = flat(df).write.mode(mode) if fmt == "csv" else df.write.mode(mode)
        writer.option("header", True).csv(paths[name]) if fmt == "csv" else writer.format(fmt).save(paths[name])
    if summary is not None:
        spark = next(iter(tables.values())).sparkSession
        paths["summary_json"] = f"{prefix}.summary_json"
        spark.createDataFrame([(json.dumps(summary, default=str),)], "value string").coalesce(1).write.mode(mode).text(paths["summary_json"])
    return paths


def write_curation(result, prefix: str, fmt: str = "csv") -> dict[str, str]:
    """qsar_ready, rejected, curation_report and summary tables with the column binding."""
    tables = {"qsar_ready": result.prepared, "rejected": result.rejected, "curation_report": result.report, "summary": result.summary}
    tables |= {f"provenance_{source}": long for source, long in result.links.items()}
    return write_tables(tables, prefix, fmt, result.columns)


def cached_table(df: DataFrame, folder: str, key: str, ttl_hours: float = 24.0) -> DataFrame:
    """Reuse a written result younger than the limit, keyed by a hash; else write it."""
    import hashlib

    spark = df.sparkSession
    path = f"{folder.rstrip('/')}/{hashlib.sha256(key.encode()).hexdigest()}"
    stamp = f"{path}.ts"
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{stamp}/_SUCCESS")
    age = None
    if there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there):
        age = spark.read.parquet(stamp).select(((F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("ts")) / 3600).alias("h")).first()["h"]
    if age is None or age > ttl_hours:
        df.write.mode("overwrite").parquet(path)
        spark.range(1).select(F.current_timestamp().alias("ts")).write.mode("overwrite").parquet(stamp)
    return spark.read.parquet(path)
