"""Dataset profile: missing values, duplicates, rule outcomes and column roles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from compoundry.functions.missing import finite, is_missing, to_double
from compoundry.functions.skew import join_stats
from compoundry.operators.rules import lipinski_violations


def missing_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, missing_count, missing_fraction: one aggregate, then an unpivot."""
    columns = columns or df.columns
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(is_missing(F.col(c))).alias(c) for c in columns])
    items = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing_count")) for c in columns]))
    frac = F.col("missing_count") / F.greatest(F.col("_n"), F.lit(1))
    return one.select("_n", items.alias("i")).select("_n", "i.*").withColumn("missing_fraction", frac).drop("_n")


def with_missing_fields(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Names of the missing columns of each row and their number."""
    columns = columns or df.columns
    names = F.array_compact(F.array(*[F.when(is_missing(F.col(c)), F.lit(c)) for c in columns]))
    return df.withColumn("missing_fields", names).withColumn("missing_value_count", F.size("missing_fields"))


def descriptor_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """descriptor, count, mean, minimum, maximum over finite values, long form."""
    aggs = []
    for c in columns:
        v = finite(F.col(c).cast("double"))
        aggs.append(F.struct(F.lit(c).alias("descriptor"), F.count(v).alias("count"), F.avg(v).alias("mean"),
                             F.min(v).alias("minimum"), F.max(v).alias("maximum")).alias(f"_{c}"))
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*[F.col(f"_{c}") for c in columns])).alias("d")).select("d.*")


def profile_rows(df: DataFrame, key: str, valid: str, columns: list[str], with_rules: bool = True) -> DataFrame:
    """Per-row profile: missing fields, duplicate group size, rule outcome, issues."""
    rows = with_missing_fields(df, columns)
    keyed = rows.withColumn("_k", F.when(F.col(valid) & (F.col(key) != ""), F.col(key)))
    counts = keyed.where(F.col("_k").isNotNull()).groupBy("_k").agg(F.count(F.lit(1)).alias("duplicate_group_size"))
    rows = join_stats(keyed, counts, ["_k"], "duplicate_group_size").drop("_k")
    size = F.coalesce("duplicate_group_size", F.lit(0)).cast("bigint")
    vio = lipinski_violations() if with_rules else F.lit(0)
    ok = F.col(valid)
    pains = F.col("pains_match") if "pains_match" in df.columns else F.lit(False)
    codes = F.array_compact(F.array(
        F.when(~ok, "INVALID_STRUCTURE"), F.when(ok & (size > 1), "DUPLICATE_SMILES"),
        F.when(ok & (vio > 1), "LIPINSKI_RULE_OF_FIVE_FAILED"), F.when(ok & pains, "PAINS_MATCH")))
    return rows.withColumns({
        "duplicate_group_size": size, "duplicate_smiles": size > 1,
        "lipinski_violations": F.when(ok, vio), "lipinski_pass": ok & (vio <= 1),
        "pains_match": ok & pains,
        "issue_codes": F.array_join(codes, ";"), "status": F.when(ok, "Valid").otherwise("Invalid")})


def problematic(profiled: DataFrame, valid: str) -> DataFrame:
    return profiled.where(~F.col(valid) | F.col("duplicate_smiles") | (F.col("missing_value_count") > 0)
                          | (F.col("issue_codes") != ""))


def profile_summary(profiled: DataFrame, key: str, valid: str) -> DataFrame:
    """One row of profile counts."""
    ok = F.col(valid)
    base = profiled.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(ok).alias("n_valid_molecules"),
        F.count_if(~ok).alias("n_invalid_molecules"),
        F.count_if(F.col("missing_value_count") > 0).alias("rows_with_missing_values"),
        F.count_if(ok & F.col("lipinski_pass")).alias("n_lipinski_pass"),
        F.count_if(ok & ~F.col("lipinski_pass")).alias("n_lipinski_fail"),
        F.count_if("pains_match").alias("n_pains_matches"))
    groups = profiled.where(ok & (F.col(key) != "")).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    dups = groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_smiles_count"),
                      F.count_if(F.col("n") > 1).alias("duplicate_smiles_groups"))
    return base.crossJoin(dups)


# Names that stay descriptive columns.
META_NAMES = (
    "smiles", "input_smiles", "canonical_smiles", "standardized_smiles", "canonical_smiles_std", "mol_smiles",
    "structure", "name", "title", "compound", "compound_name", "compound_id", "molecule_id", "id", "identifier",
    "chembl_id", "inchi", "inchikey", "identity_key", "identity_status", "source", "source_name", "source_format",
    "row_id", "transform_log", "dropped_reason", "qc_flags", "import_source_format", "import_row_index",
    "import_delimiter", "import_warnings", "unit", "units", "standard_units", "activity_unit", "relation",
    "standard_relation", "endpoint", "standard_type", "activity_type", "conversion_status", "reject_reasons",
    "aggregation_method", "row_index", "activity_value", "pactivity_raw", "pactivity_min", "pactivity_max",
    "pactivity_std", "n_measurements", "duplicate_group", "curation_stage", "curation_status",
    "curation_ready_for_qsar", "curation_ready_for_docking", "curation_blockers", "curation_warnings",
    "curation_recommended_next_step", "curation_version")


def looks_like_meta(name: str) -> bool:
    low = name.strip().lower()
    return low in META_NAMES or low.endswith(("_id", "_ids", "_name", "_smiles")) or low.startswith("import_")


def infer_roles(df: DataFrame, class_column: str | None = None, meta: tuple[str, ...] = (),
                attributes: tuple[str, ...] = ()) -> dict[str, str]:
    """Role per column: attribute, class or meta; text columns are tested in one pass."""
    roles: dict[str, str] = {}
    open_text = []
    for f in df.schema.fields:
        if f.name == class_column:
            roles[f.name] = "class"
        elif f.name in meta or (f.name not in attributes and looks_like_meta(f.name)):
            roles[f.name] = "meta"
        elif isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            roles[f.name] = "attribute"
        elif isinstance(f.dataType, T.StringType):
            open_text.append(f.name)
        else:
            roles[f.name] = "meta"
    if open_text:
        present = lambda c: ~is_missing(F.col(c))
        row = df.agg(*[F.count_if(present(c)).alias(f"n_{i}") for i, c in enumerate(open_text)],
                     *[F.count_if(present(c) & to_double(F.col(c)).isNull()).alias(f"x_{i}")
                       for i, c in enumerate(open_text)]).first()
        for i, c in enumerate(open_text):
            roles[c] = "attribute" if row[f"n_{i}"] and not row[f"x_{i}"] else "meta"
    return {c: roles[c] for c in df.columns}


def unique_names(names: list[str]) -> list[str]:
    """Repeated names get the suffixes _2, _3, ..."""
    seen: set[str] = set()
    out = []
    for name in names:
        new, i = name, 2
        while new in seen:
            new, i = f"{name}_{i}", i + 1
        seen.add(new)
        out.append(new)
    return out


def with_roles(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Cast attributes and class to double and keep each role in the column metadata."""
    cols = []
    for c in df.columns:
        role = roles[c]
        e = to_double(F.col(c)) if role != "meta" else F.col(c)
        cols.append(e.alias(c, metadata={"role": role}))
    return df.select(*cols)


def role_summary(df: DataFrame) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {"attribute": [], "class": [], "meta": []}
    for f in df.schema.fields:
        out[f.metadata.get("role", "meta")].append(f.name)
    return out


def format_role_summary(summary: dict[str, list[str]], max_items: int = 6) -> str:
    def part(label: str, names: list[str]) -> str:
        shown = ", ".join(names[:max_items]) + (", …" if len(names) > max_items else "")
        return f"{label} ({len(names)}): {shown or '-'}"
    return "; ".join(part(r, summary[r]) for r in ("attribute", "class", "meta"))


def modeling_columns(df: DataFrame, target: str | None = None) -> DataFrame:
    """Numeric modelling columns only: audit, provenance and QC columns are dropped."""
    keep = [f.name for f in df.schema.fields
            if f.name == target or (isinstance(f.dataType, T.NumericType) and not looks_like_meta(f.name)
                                    and not f.name.lower().startswith(("source_", "qc_", "curation_", "std_")))]
    return df.select(*keep)
