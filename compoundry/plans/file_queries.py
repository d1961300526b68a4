"""Written and re-read files: every format against the table it was written from."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from compoundry.chem import kernels
from compoundry.operators import reporting
from compoundry.plans import inputs
from compoundry.plans.inputs import MOLECULES_SQL
from compoundry.plans.model_queries import rounded
from compoundry.plans.registry import query
from compoundry.session import shared_folder
from compoundry.sources import files, sinks


def _written(spark, sf: str, kind: str) -> str:
    """The molecule table written in a format below the shared folder."""
    m = inputs.molecules(spark, sf).withColumn("activity", F.col("activity").cast("string"))
    path = f"{shared_folder(spark).rstrip('/')}/compoundry/{uuid.uuid4().hex}.{kind}"
    return sinks.write_molecules(sinks.export_records(m, "smiles", "name"), path, kind)


@query("src2_delimited_round_trip", f"with {MOLECULES_SQL} select name, smiles, series, activity from molecules where smiles <> ''")
def delimited_round_trip(spark, sf):
    back = files.read_delimited(spark, _written(spark, sf, "csv"), ",")
    return back.select(F.col("Name").alias("name"), F.col("SMILES").alias("smiles"), "series", F.col("activity").cast("double").alias("activity"))


@query("src3_smiles_line_round_trip", f"with {MOLECULES_SQL} select name, smiles from molecules where smiles <> ''")
def smiles_round_trip(spark, sf):
    return files.read_smiles_lines(spark, _written(spark, sf, "smi")).select("name", "smiles")


@query("src4_record_round_trip", f"with {MOLECULES_SQL} select name, series, activity, true as same_structure from molecules where smiles not in ('', 'C1CC(')")
def record_round_trip(spark, sf):
    back = files.read_structure_records(spark, _written(spark, sf, "sdf")).where("ok")
    value = lambda k: F.try_element_at("props", F.lit(k))
    both = back.select("name", "smiles", value("series").alias("series"), value("activity").cast("double").alias("activity")).join(
        inputs.molecules(spark, sf).select("name", F.col("smiles").alias("written")), "name")
    return both.select("name", "series", "activity", (kernels.canonical(F.col("smiles")) == kernels.canonical(F.col("written"))).alias("same_structure"))


@query("agg17_prediction_profile", """with p as (select l_extendedprice as y, l_extendedprice * (1 - l_discount) as f from lineitem)
 select count(*) as n, round(1 - sum((y - f) ** 2) / (var_pop(y) * count(*)), 6) as r2, round(sqrt(avg((y - f) ** 2)), 4) as rmse, round(avg(abs(y - f)), 4) as mae from p""")
def prediction_profile(spark, sf):
    p = inputs.table(spark, sf, "lineitem").select(F.col("l_extendedprice").alias("observed"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("predicted"))
    out = reporting.prediction_profile(p)
    return out.select("n", F.round("r2", 6).alias("r2"), F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"))


@query("agg17_domain_profile", "select round(avg((l_quantity <= 40)::int), 6) as coverage, count(*) filter (l_quantity > 40) as out_of_domain_count from lineitem")
def domain_profile(spark, sf):
    d = inputs.table(spark, sf, "lineitem").select((F.col("l_quantity") <= 40).alias("in_domain"))
    return rounded(reporting.domain_profile(d))
