"""Domain views over the given tables, in Spark and (for the checks) in SQL.

Every view is a narrow projection of one table, so its size follows that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows over the cores when a small file arrives in fewer splits than cores.

    Large tables bring many splits and are left as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


UNITS = ("nM", "uM", "µM", "mM", "M", "pM", "mg/ml")
RELATIONS = ("=", "=", "<", "'='", ">", "", "=")


def _pick(values: tuple, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), index)


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as raw activity measurements: one row per line, compound = part."""
    li = spread(table(spark, sf_dir, "lineitem"))
    line = F.col("l_linenumber")
    step = F.col("l_orderkey") + F.col("l_partkey")
    order = ((F.col("l_orderkey") * 8 + line).cast("decimal(25,0)") * F.lit(10**9).cast("decimal(12,0)")
             + F.col("l_suppkey")).cast("decimal(38,0)")
    return li.select(
        order.alias("row_index"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("compound_id"),
        F.when(step % 97 != 0, F.concat(F.lit("S"), F.col("l_partkey").cast("string"))).alias("smiles"),
        F.when(F.col("l_returnflag") == "A", "IC50").when(F.col("l_returnflag") == "N", "Ki").otherwise("EC50")
        .alias("standard_type"),
        _pick(RELATIONS, line).alias("standard_relation"),
        F.when(step % 53 == 0, F.lit(None)).when(step % 59 == 0, F.lit(-1.0))
        .otherwise(F.col("l_extendedprice")).alias("standard_value"),
        _pick(UNITS, line).alias("standard_units"),
        F.concat(F.lit("r"), (F.col("l_suppkey") % 10).cast("string")).alias("row_id"),
    )


ACTIVITIES_SQL = """
activities as (
  select (l_orderkey * 8 + l_linenumber)::decimal(38,0) * 1000000000 + l_suppkey as row_index,
    'P' || l_partkey as compound_id,
    case when (l_orderkey + l_partkey) % 97 <> 0 then 'S' || l_partkey end as smiles,
    case l_returnflag when 'A' then 'IC50' when 'N' then 'Ki' else 'EC50' end as standard_type,
    (['=', '=', '<', '''=''', '>', '', '='])[l_linenumber] as standard_relation,
    case when (l_orderkey + l_partkey) % 53 = 0 then null when (l_orderkey + l_partkey) % 59 = 0 then -1.0
         else l_extendedprice end as val,
    (['nM', 'uM', 'µM', 'mM', 'M', 'pM', 'mg/ml'])[l_linenumber] as standard_units,
    ([1e-9, 1e-6, 1e-6, 1e-3, 1.0, 1e-12, null])[l_linenumber] as factor,
    'r' || (l_suppkey % 10) as row_id
  from lineitem),
annotated as (
  select *, coalesce(smiles, '') as key,
    case when val is not null and factor is not null and val * factor > 0 then -log10(val * factor) end as pact,
    concat_ws(';',
      case when smiles is null then 'missing_smiles' end,
      case when standard_relation not in ('', '=', '''=''') then 'non_exact_relation' end,
      case when val is null then 'activity_not_numeric'
           when factor is null then 'unsupported_or_missing_unit'
           when val * factor <= 0 then 'activity_not_positive' end) as reasons
  from activities)
"""

# Ring, linker length, end group and salt chosen by the part: real structure texts
# with many repeats, so identity groups, scaffolds and searches have work to do.
RINGS = ("c1ccccc1", "c1ccncc1", "C1CCCCC1", "c1ccc2ccccc2c1", "C1CCNCC1", "c1ccoc1", "")
ENDS = ("O", "N", "C(=O)O", "F", "Cl", "C#N", "S(=O)(=O)N", "[N+](=O)[O-]", "Br", "OC", "C=CC", "C(C)(C)O")
SALTS = (".[Na+].[Cl-]", ".O", ".[13CH4]")


def molecules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as a molecule table: row_index, name, smiles, series, activity."""
    k = F.col("p_partkey")
    ring = _pick(RINGS, (k % 7 + 1).cast("int"))
    end = _pick(ENDS, ((F.floor(k / 7)) % 12 + 1).cast("int"))
    chain = F.repeat(F.lit("C"), (F.col("p_size") % 6).cast("int"))
    salt = F.when(k % 23 == 0, _pick(SALTS, (k % 3 + 1).cast("int"))).otherwise("")
    smiles = F.concat(end_first(end), chain, ring, salt)
    return table(spark, sf_dir, "part").select(
        k.alias("row_index"), F.concat(F.lit("cpd_"), k.cast("string")).alias("name"),
        F.when(k % 41 == 0, "").when(k % 43 == 0, "C1CC(").otherwise(smiles).alias("smiles"),
        F.col("p_brand").alias("series"), (F.col("p_retailprice") / 100).alias("activity"))


def end_first(end):
    """End groups are written before the chain, so multi-atom ends keep valence."""
    back = {"C(=O)O": "OC(=O)", "C#N": "N#C", "S(=O)(=O)N": "NS(=O)(=O)", "[N+](=O)[O-]": "[O-][N+](=O)",
            "OC": "CO", "C=CC": "CC=C", "C(C)(C)O": "CC(C)(O)"}
    out = None
    for text, reverse in back.items():
        out = F.when(end == text, reverse) if out is None else out.when(end == text, reverse)
    return out.otherwise(end)


MOLECULES_SQL = """
molecules as (
  select p_partkey as row_index, 'cpd_' || p_partkey as name,
    case when p_partkey % 41 = 0 then '' when p_partkey % 43 = 0 then 'C1CC(' else
      (['O','N','OC(=O)','F','Cl','N#C','NS(=O)(=O)','[O-][N+](=O)','Br','CO','CC=C','CC(C)(O)'])[(p_partkey // 7) % 12 + 1]
      || repeat('C', p_size % 6)
      || (['c1ccccc1','c1ccncc1','C1CCCCC1','c1ccc2ccccc2c1','C1CCNCC1','c1ccoc1',''])[p_partkey % 7 + 1]
      || case when p_partkey % 23 = 0 then (['.[Na+].[Cl-]','.O','.[13CH4]'])[p_partkey % 3 + 1] else '' end
    end as smiles,
    p_brand as series, p_retailprice / 100 as activity
  from part)
"""


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a numeric descriptor table with an observed and a predicted value."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"),
        F.col("l_quantity").alias("MW"), (F.col("l_discount") * 50).alias("LogP"),
        (F.col("l_tax") * 1000).alias("TPSA"), F.col("l_extendedprice").alias("observed"),
        (F.col("l_quantity") * 1500 + 250).alias("predicted"), F.col("l_returnflag").alias("split"))


def rule_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as molecule property facts for the rule filters."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("l_quantity") * 15).alias("molecular_weight"),
        (F.col("l_discount") * 80 - 1).alias("logp"),
        (F.col("l_partkey") % 9).cast("double").alias("hbd"),
        (F.col("l_suppkey") % 14).cast("double").alias("hba"),
        (F.col("l_tax") * 2000).alias("tpsa"),
        (F.col("l_partkey") % 17).cast("double").alias("rotatable_bonds"),
        (F.col("l_quantity") * 3).alias("molar_refractivity"),
        (F.col("l_partkey") % 8).cast("double").alias("ring_count"),
        F.col("l_quantity").alias("heavy_atom_count"),
        (F.col("l_discount") * 9).alias("qed_score"),
        (F.col("l_returnflag") == "R").alias("pains_match"),
        ((F.col("l_linenumber") == 7) & (F.col("l_linestatus") == "O")).alias("brenk_match"))


RULE_FACTS_SQL = """
facts as (
  select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 15 as mw, l_discount * 80 - 1 as logp,
    (l_partkey % 9)::double as hbd, (l_suppkey % 14)::double as hba, l_tax * 2000 as tpsa,
    (l_partkey % 17)::double as rotb, l_quantity * 3 as mr, (l_partkey % 8)::double as rings,
    l_quantity as heavy, l_discount * 9 as qed, l_returnflag = 'R' as pains,
    l_linenumber = 7 and l_linestatus = 'O' as brenk
  from lineitem),
rules as (
  select *, (mw > 500)::int + (logp > 5)::int + (hbd > 5)::int + (hba > 10)::int as lip,
    rotb <= 10 and tpsa <= 140 as veber,
    mw between 160 and 480 and logp between -0.4 and 5.6 and mr between 40 and 130 and heavy between 20 and 70 as ghose,
    logp <= 5.88 and tpsa <= 131.6 as egan,
    mw between 200 and 600 and logp between -2 and 5 and tpsa <= 150 and hbd <= 5 and hba <= 10
      and rotb <= 15 and rings between 1 and 7 and heavy >= 10 as muegge
  from facts)
"""
