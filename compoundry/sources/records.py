"""Nested service records (JSON) as flat DataFrames with an explicit schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from compoundry.functions.missing import text
from compoundry.functions.units import record_to_nanomolar

# Page layouts: one JSON object per page, records in one array.
ACTIVITY_PAGE = """
  activities array<struct<molecule_chembl_id string, canonical_smiles string, target_chembl_id string,
    assay_chembl_id string, standard_type string, standard_relation string, standard_value string,
    standard_units string, pchembl_value string>>,
  page_meta struct<limit bigint, offset bigint, next string, total_count bigint>"""
MOLECULE_PAGE = """
  molecules array<struct<molecule_chembl_id string, pref_name string,
    molecule_structures struct<canonical_smiles string>, molecule_properties map<string,string>>>,
  page_meta struct<limit bigint, offset bigint, next string, total_count bigint>"""
TARGET_PAGE = """
  targets array<struct<target_chembl_id string, pref_name string, organism string, target_type string,
    score double, target_components array<struct<component_description string,
      target_component_synonyms array<struct<component_synonym string>>>>>>,
  page_meta struct<limit bigint, offset bigint, next string, total_count bigint>"""
ASSAY_PAGE = """
  assays array<struct<assay_chembl_id string, assay_type string, confidence_score int, description string,
    target_chembl_id string>>,
  page_meta struct<limit bigint, offset bigint, next string, total_count bigint>"""


def read_pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Saved service pages, one JSON object per line."""
    return spark.read.schema(schema).json(path)


def parse_pages(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Pages held as JSON text in a column; unreadable pages become null fields."""
    return df.select(F.from_json(column, schema).alias("page")).select("page.*")


def _records(pages: DataFrame, field: str) -> DataFrame:
    """One row per record with its service order (page offset, place in the page)."""
    at = F.coalesce(F.col("page_meta.offset"), F.lit(0)).alias("_offset")
    rows = pages.select(at, F.posexplode(field).alias("_place", "r"))
    return rows.select((F.col("_offset") + F.col("_place")).alias("row_index"), "r.*")


def activities(pages: DataFrame, standard_type: str | None = "IC50", target: str | None = None) -> DataFrame:
    """Activity records with numeric values and the nM concentration.

    The type filter is repeated locally: a page fetched without it gives the same rows.
    """
    rows = _records(pages, "activities")
    if standard_type:
        rows = rows.where(F.upper(text(F.col("standard_type"))) == standard_type.strip().upper())
    if target:
        rows = rows.where(F.upper(text(F.col("target_chembl_id"))) == target.strip().upper())
    number = lambda c: F.col(c).try_cast("double")
    return rows.withColumns({
        "standard_value": number("standard_value"), "pchembl_value": number("pchembl_value"),
        "ic50_nM": record_to_nanomolar(F.col("standard_value"), F.col("standard_units"))})


def targets(pages: DataFrame) -> DataFrame:
    """Targets with the flat alias list that target search ranks on."""
    rows = _records(pages, "targets")
    described = F.transform("target_components", lambda c: c["component_description"])
    synonyms = F.flatten(F.transform("target_components", lambda c: F.coalesce(
        F.transform(c["target_component_synonyms"], lambda s: s["component_synonym"]), F.array().cast("array<string>"))))
    aliases = F.filter(F.concat(described, synonyms), lambda a: text(a) != "")
    return rows.select("row_index", F.trim("target_chembl_id").alias("target_id"), "pref_name", "organism",
                       "target_type", "score", F.coalesce(aliases, F.array().cast("array<string>")).alias("aliases"))


def assays(pages: DataFrame) -> DataFrame:
    return _records(pages, "assays")


def molecules(pages: DataFrame) -> DataFrame:
    """Molecules with structure text and the property map."""
    return _records(pages, "molecules").select(
        "row_index", F.upper(text(F.col("molecule_chembl_id"))).alias("molecule_id"), "pref_name",
        text(F.col("molecule_structures.canonical_smiles")).alias("smiles"),
        F.col("molecule_properties").alias("props"))


def clean_ids(df: DataFrame, column: str, order: str) -> DataFrame:
    """Distinct upper-case ids by first occurrence."""
    key = F.upper(text(F.col(column)))
    return df.select(key.alias(column), order).where(F.col(column) != "").groupBy(column).agg(F.min(order).alias(order))


def property_value(props: str, key: str) -> Column:
    return F.try_element_at(F.col(props), F.lit(key)).try_cast("double")


def numeric_properties(df: DataFrame, props: str, keys: list[str]) -> DataFrame:
    """One number column per requested property key; absent or text gives null."""
    return df.withColumns({k: property_value(props, k) for k in keys})


def total_count(pages: DataFrame) -> DataFrame:
    return pages.agg(F.max("page_meta.total_count").alias("total_count"))
