"""Curation, bioactivity and scalar-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from compoundry.functions import texts, units
from compoundry.functions.missing import is_missing, to_double
from compoundry.operators import bioactivity, curation
from compoundry.operators.curation import CurationConfig
from compoundry.plans import inputs
from compoundry.plans.inputs import ACTIVITIES_SQL, table
from compoundry.plans.registry import query


def config(**kw) -> CurationConfig:
    return CurationConfig(smiles="smiles", activity="standard_value", name="compound_id", unit="standard_units",
                          relation="standard_relation", endpoint="standard_type", **kw)


AGG_COLUMNS = ("identity_key", "compound_id", "pActivity", "n_measurements", "pActivity_min",
               "pActivity_max", "pActivity_std", "duplicate_group")


def compound_table(spark, sf, method):
    rows = curation.annotate_activities(inputs.activities(spark, sf), config(aggregation=method))
    accepted = rows.where(F.col("reject_reasons") == "")
    out = curation.aggregate_measurements(accepted, method, carry=["compound_id"])
    r6 = lambda c: F.round(c, 6).alias(c)
    return out.select("identity_key", "compound_id", r6("pActivity"), "n_measurements", r6("pActivity_min"),
                      r6("pActivity_max"), r6("pActivity_std"), F.col("duplicate_group").cast("int").alias("duplicate_group"))


def compound_sql(expr):
    return f"""with {ACTIVITIES_SQL}
      select key as identity_key, arg_min(compound_id, row_index) as compound_id, round({expr}, 6) as "pActivity",
        count(*) as n_measurements, round(min(pact), 6) as "pActivity_min", round(max(pact), 6) as "pActivity_max",
        round(case when count(*) > 1 then stddev_pop(pact) else 0 end, 6) as "pActivity_std",
        (count(*) > 1)::int as duplicate_group
      from annotated where reasons = '' group by key"""


for _method, _expr in (("median", "median(pact)"), ("mean", "avg(pact)"), ("min", "min(pact)"),
                       ("max", "max(pact)"), ("first", "arg_min(pact, row_index)")):
    query(f"agg1_measurement_{_method}", compound_sql(_expr))(
        lambda spark, sf, m=_method: compound_table(spark, sf, m))


@query("flt15_activity_acceptance", f"""with {ACTIVITIES_SQL}
  select compound_id, standard_type as endpoint, standard_relation as relation, standard_units as activity_unit,
    round(pact, 6) as "pActivity_raw", reasons as reject_reasons, count(*) as n
  from annotated group by all""")
def activity_acceptance(spark, sf):
    rows = curation.annotate_activities(inputs.activities(spark, sf), config())
    return rows.groupBy("compound_id", "endpoint", "relation", "activity_unit",
                        F.round("pActivity_raw", 6).alias("pActivity_raw"), "reject_reasons").agg(
        F.count(F.lit(1)).alias("n"))


@query("flt15_selected_endpoint_window", f"""with {ACTIVITIES_SQL}
  select reason, count(*) as n_rows from (
    select unnest(string_split(concat_ws(';',
      case when smiles is null then 'missing_smiles' end,
      case when standard_type <> 'IC50' then 'endpoint_not_selected' end,
      case when val is null then 'activity_not_numeric' when factor is null then 'unsupported_or_missing_unit'
           when val * factor <= 0 then 'activity_not_positive' end,
      case when pact < 1 then 'below_min_pactivity' end, case when pact > 7 then 'above_max_pactivity' end), ';')) as reason
    from annotated) where reason <> '' group by reason""")
def selected_endpoint(spark, sf):
    cfg = config(target_endpoint="ic50", relation_policy="allow_inequalities", min_activity=1.0, max_activity=7.0)
    return curation.reject_reason_counts(curation.annotate_activities(inputs.activities(spark, sf), cfg))


@query("agg1_curation_summary", f"""with {ACTIVITIES_SQL},
  k as (select key, count(*) n, count(*) filter (reasons = '') ok from annotated group by key)
  select sum(n)::bigint as input_records, sum(ok)::bigint as accepted_measurements_before_aggregation,
    sum(n - ok)::bigint as rejected_records, count(*) filter (ok > 0) as prepared_compounds,
    count(*) filter (ok > 1) as duplicate_groups from k""")
def curation_counts(spark, sf):
    return curation.curation_summary(curation.annotate_activities(inputs.activities(spark, sf), config()))


@query("agg1_compound_provenance", f"""with {ACTIVITIES_SQL},
  t as (select key, row_id, min(row_index) f from annotated where reasons = '' group by all)
  select key as identity_key, string_agg(row_id, ';' order by f) as source_row_ids from t group by key""")
def compound_provenance(spark, sf):
    rows = curation.annotate_activities(inputs.activities(spark, sf), config())
    accepted = rows.where(F.col("reject_reasons") == "")
    return curation.with_provenance(accepted.select("identity_key").distinct(), accepted).select("identity_key", "source_row_ids")


@query("sc20_unit_to_molar", f"""with {ACTIVITIES_SQL}
  select standard_units, count(*) as n, round(sum(log10(val * factor)), 4) as log_molar_sum
  from annotated where val > 0 group by standard_units""")
def unit_to_molar(spark, sf):
    a = inputs.activities(spark, sf)
    v = to_double(F.col("standard_value"))
    return a.where(v > 0).groupBy("standard_units").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(F.log10(units.to_molar(v, F.col("standard_units")))), 4).alias("log_molar_sum"))


@query("sc21_log_activity", f"""with {ACTIVITIES_SQL}
  select case when val is null then 'activity_not_numeric' when factor is null then 'unsupported_or_missing_unit'
      when val * factor <= 0 then 'activity_not_positive' else 'converted_from_concentration' end as conversion_status,
    count(*) as n, round(avg(pact), 6) as mean_activity from annotated group by 1""")
def log_activity(spark, sf):
    a = inputs.activities(spark, sf)
    value, status = units.log_activity(F.col("standard_value"), F.col("standard_units"), "nM")
    return a.groupBy(status.alias("conversion_status")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean_activity"))


@query("sc22_frame_nanomolar", f"""with {ACTIVITIES_SQL}
  select standard_units, count(val * f) as n_converted, round(min(val * f), 6) as low, round(max(val * f), 6) as high from (
    select *, case standard_units when 'M' then 1e9 when 'µM' then 1e3 when 'uM' then 1e3 when 'nM' then 1
      when 'pM' then 1e-3 end as f from annotated) group by standard_units""")
def frame_nanomolar(spark, sf):
    nm = units.to_nanomolar(F.col("standard_value"), F.col("standard_units"))
    return inputs.activities(spark, sf).groupBy("standard_units").agg(
        F.count(nm).alias("n_converted"), F.round(F.min(nm), 6).alias("low"), F.round(F.max(nm), 6).alias("high"))


@query("sc23_record_nanomolar", f"""with {ACTIVITIES_SQL}
  select standard_units, count(val * f) as n_converted, round(min(val * f), 6) as low, round(max(val * f), 6) as high from (
    select *, case standard_units when 'M' then 1e9 when 'mM' then 1e6 when 'µM' then 1e3 when 'uM' then 1e3
      when 'nM' then 1 end as f from annotated) group by standard_units""")
def record_nanomolar(spark, sf):
    nm = units.record_to_nanomolar(F.col("standard_value"), F.col("standard_units"))
    return inputs.activities(spark, sf).groupBy("standard_units").agg(
        F.count(nm).alias("n_converted"), F.round(F.min(nm), 6).alias("low"), F.round(F.max(nm), 6).alias("high"))


@query("sc24_number_coercion", """
  select event_type, count(*) as n, count(try_cast(replace(v, ',', '.') as double)) as n_numbers,
    count(*) filter (v in ('', '?')) as n_missing, round(sum(try_cast(replace(v, ',', '.') as double)), 4) as total
  from (select event_type, case when event_id % 11 = 0 then '?' when event_id % 13 = 0 then ''
      when event_id % 7 = 0 then 'n/a' else replace(value::varchar, '.', ',') end as v from events) group by event_type""")
def number_coercion(spark, sf):
    e = table(spark, sf, "events")
    i = F.col("event_id")
    v = (F.when(i % 11 == 0, "?").when(i % 13 == 0, "").when(i % 7 == 0, "n/a")
         .otherwise(F.translate(F.col("value").cast("string"), ".", ",")))
    return e.select("event_type", v.alias("v")).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count(to_double(F.col("v"))).alias("n_numbers"),
        F.count_if(is_missing(F.col("v"))).alias("n_missing"), F.round(F.sum(to_double(F.col("v"))), 4).alias("total"))


@query("agg2_bioactivity_by_molecule", """
  with r as (select 'M' || (user_id % 60) as molecule_id, event_id, event_type, value, (value * 10) v10 from events),
  m as (select molecule_id, event_type, count(*) n, min(event_id) f from r group by all)
  select a.*, (select arg_min(event_type, (-n) * 1000000000000 + f) from m where m.molecule_id = a.molecule_id) as standard_type
  from (select molecule_id, count(*) as bio_n, max(value) as "pChEMBL", min(v10) as standard_value from r group by 1) a""")
def bioactivity_by_molecule(spark, sf):
    e = table(spark, sf, "events")
    recs = e.select(F.concat(F.lit(" m"), (F.col("user_id") % 60).cast("string")).alias("molecule_id"),
                    F.col("event_id").alias("row_index"), F.col("event_type").alias("standard_type"),
                    F.col("value").alias("pChEMBL"), (F.col("value") * 10).alias("standard_value"))
    return bioactivity.aggregate_by_molecule(recs, {"pChEMBL": "max", "standard_value": "min"}, ["standard_type"])


@query("agg3_activity_types", """
  with k as (select case when event_id % 9 = 0 then 'UNKNOWN' when event_id % 5 = 0 then event_type
      else event_type || ' (u' || user_id % 3 || ')' end as key, event_id from events),
  g as (select key, count(*) n, min(event_id) f from k group by key)
  select key, n as count, round(100.0 * n / sum(n) over (), 6) as pct from g order by n desc, f limit 12""")
def activity_types(spark, sf):
    i = F.col("event_id")
    kind = F.when(i % 9 != 0, F.col("event_type"))
    unit = F.when((i % 5 != 0) & (i % 9 != 0), F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")))
    out = bioactivity.activity_type_summary(table(spark, sf, "events"), kind, unit, "event_id")
    return out.withColumn("pct", F.round("pct", 6))


@query("jn6_molecule_properties", """
  select o_orderkey, o_custkey, c_name, c_mktsegment from orders left join customer
    on o_custkey = case when c_custkey % 3 <> 0 then c_custkey end""")
def molecule_properties(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    o = o.withColumn("mol", F.concat(F.lit(" chembl"), F.col("o_custkey").cast("string")))
    # A third of the property rows carries no usable id and must not match anything.
    pid = F.when(F.col("c_custkey") % 3 != 0, F.concat(F.lit("CHEMBL"), F.col("c_custkey").cast("string"), F.lit(" ")))
    c = table(spark, sf, "customer").select(pid.alias("pid"), "c_name", "c_mktsegment")
    return bioactivity.join_properties(o, c, "mol", "pid").drop("mol")


@query("jn6_activity_counts", """
  select c_custkey, c_name, coalesce(n, 0) as bio_n from customer
    left join (select o_custkey, count(*) n from orders group by 1) on o_custkey = c_custkey""")
def activity_counts(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name")
    return bioactivity.with_activity_counts(c, table(spark, sf, "orders").select("o_custkey"), "c_custkey", "o_custkey")


@query("src16_distinct_molecules", """
  select user_id as molecule_id, coalesce(arg_min(s, event_id) filter (s <> ''), '') as smiles, min(event_id) as first_row
  from (select user_id, event_id, case when event_id % 4 <> 1 then '' else event_type || user_id end s from events) group by 1""")
def distinct_molecules(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("molecule_id"), F.col("event_id").alias("row_index"),
        F.when(F.col("event_id") % 4 == 1, F.concat("event_type", F.col("user_id").cast("string"))).otherwise("").alias("smiles"))
    return bioactivity.dedupe_molecules(rows, "molecule_id", "smiles", "row_index")


@query("src15_assays_for_target", """
  with a as (select user_id as assay_id, event_id, event_type, case when event_id % 3 = 0 then null else event_id % 10 end conf from events)
  select assay_id, arg_min(event_type, event_id) as assay_type, arg_min(coalesce(conf, -1), event_id) as confidence, min(event_id) as row_index
  from a where (conf is null or conf >= 7) and event_type in ('click') group by assay_id""")
def assays(spark, sf):
    i = F.col("event_id")
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("assay_id"), i.alias("row_index"), F.col("event_type").alias("assay_type"),
        F.when(i % 3 != 0, i % 10).alias("confidence"))
    out = bioactivity.select_assays(rows, "assay_id", "confidence", "assay_type", "row_index", 7, "CLICK")
    return out.withColumn("confidence", F.coalesce("confidence", F.lit(-1)))


@query("src13_target_search", """
  with t as (select s_suppkey as row_index, 'T' || s_suppkey as target_id, n_name as pref_name,
      case when s_suppkey % 3 = 0 then 'SINGLE PROTEIN' else 'PROTEIN FAMILY' end as target_type,
      case when s_suppkey % 2 = 0 then 'Homo sapiens' else 'Mus musculus' end as organism, s_acctbal as score,
      lower(s_name) as alias from supplier join nation on s_nationkey = n_nationkey)
  select target_id, pref_name, target_type, organism from (select *, row_number() over (order by
    (lower(pref_name) = 'nation_1') desc, (target_type = 'SINGLE PROTEIN' and lower(pref_name) = 'nation_1') desc,
    (contains(lower(pref_name), 'nation_1') and target_type = 'SINGLE PROTEIN') desc,
    contains(lower(pref_name), 'nation_1') desc, (target_type = 'SINGLE PROTEIN') desc,
    (organism = 'Homo sapiens') desc, score desc, row_index) r from t) where r <= 40""")
def target_search(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    k = F.col("s_suppkey")
    t = s.join(n, s.s_nationkey == n.n_nationkey).select(
        k.alias("row_index"), F.concat(F.lit("T"), k.cast("string")).alias("target_id"), F.col("n_name").alias("pref_name"),
        F.when(k % 3 == 0, "SINGLE PROTEIN").otherwise("PROTEIN FAMILY").alias("target_type"),
        F.when(k % 2 == 0, "Homo sapiens").otherwise("Mus musculus").alias("organism"),
        F.col("s_acctbal").alias("score"), F.array(F.lower("s_name")).alias("aliases"))
    return bioactivity.rank_targets(t, " Nation_1 ", limit=40).select("target_id", "pref_name", "target_type", "organism")


@query("src18_property_keys", "select distinct unnest(json_keys(props)) as key from events")
def property_keys(spark, sf):
    e = table(spark, sf, "events").select(F.from_json("props", "map<string,string>").alias("props"))
    return bioactivity.property_keys(e, "props")


@query("src17_json_properties", """
  select event_type, count(*) as n, sum((props->>'k')::int)::double as k_total, max((props->>'k')::int)::double as k_max
  from events group by 1""")
def json_properties(spark, sf):
    from compoundry.sources.records import numeric_properties

    e = table(spark, sf, "events").select("event_type", F.from_json("props", "map<string,string>").alias("props"))
    e = numeric_properties(e, "props", ["k", "absent"])
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k_total"), F.max("k").alias("k_max"))


PATTERN_SQL = "select p_partkey, p_name from part where regexp_matches(p_name, '{}', 'i')"


@query("flt19_wildcard_pattern", PATTERN_SQL.format("r.d.*g.t"))
def wildcard(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_name").where(texts.matches(F.col("p_name"), "R?d*g?t"))


@query("flt19_regex_pattern", PATTERN_SQL.format("^(red|small) [wg]"))
def regex(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_name").where(texts.matches(F.col("p_name"), "/^(RED|small) [wg]/"))


@query("flt19_substring_pattern", PATTERN_SQL.format("ring"))
def substring(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_name").where(texts.matches(F.col("p_name"), "RinG"))


@query("flt23_broadened_target_search", """
  select s_suppkey, s_name || ' | ' || n_name as blob from supplier join nation on s_nationkey = n_nationkey
  where contains(lower(s_name), 'supplier') and regexp_matches(s_name || ' | ' || n_name, 'supplier.*nation_2', 'i')""")
def broadened(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    wanted = "supplier*nation_2"
    broad = texts.broadened_query(wanted, "supplier").split(" ")[0]
    rows = s.where(F.lower("s_name").contains(broad)).join(n, s.s_nationkey == n.n_nationkey)
    rows = rows.select("s_suppkey", texts.search_blob(F.col("s_name"), F.col("n_name")).alias("blob"))
    return rows.where(texts.matches(F.col("blob"), wanted))


@query("sc1_column_keys", """
  select p_name, replace(replace(replace(lower(trim(p_name || '.' || p_type)), ' ', '_'), '-', '_'), '.', '_') as k, count(*) n
  from part group by all""")
def column_keys(spark, sf):
    p = table(spark, sf, "part")
    k = texts.column_key(F.concat_ws(".", "p_name", "p_type"))
    return p.groupBy("p_name", k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("sc2_row_ids", """
  select o_orderkey, substr(sha1('csv|' || o_orderkey || '|C' || o_custkey || '|' || o_orderstatus), 1, 16) as row_id from orders""")
def row_ids(spark, sf):
    o = table(spark, sf, "orders")
    rid = texts.row_id(F.lit("csv"), F.col("o_orderkey"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")), F.col("o_orderstatus"))
    return o.select("o_orderkey", rid.alias("row_id"))


@query("sc4_token_append", """
  select event_id, case when event_id % 3 = 0 then 'import | ' || event_type when event_type = 'click' then 'import | click'
    else 'import | click | ' || event_type end as tokens from events""")
def token_append(spark, sf):
    e = table(spark, sf, "events")
    base = F.when(F.col("event_id") % 3 == 0, "import").otherwise(" import |  | click".replace("|  |", "|"))
    return e.select("event_id", texts.append_token(base, F.col("event_type")).alias("tokens"))


@query("sc5_descriptor_category", """
  select name, case when contains(n, 'mr') or contains(n, 'logp') then 'physicochemical' when contains(n, 'ring') then 'fragment/count'
    when contains(n, 'fp') then 'fingerprint' else 'other/unknown' end as category, count(*) as n_rows
  from (select p_name || '_' || p_partkey % 4 as name, lower(p_name) || case p_partkey % 4 when 0 then '_fp' when 1 then '_mr' else '' end as n from part)
  group by all""")
def descriptor_category(spark, sf):
    m = F.col("p_partkey") % 4
    n = F.concat("p_name", F.when(m == 0, "_FP").when(m == 1, "_MR").otherwise(""))
    return table(spark, sf, "part").select(
        F.concat("p_name", F.lit("_"), m.cast("string")).alias("name"), texts.descriptor_category(n).alias("category")
    ).groupBy("name", "category").agg(F.count(F.lit(1)).alias("n_rows"))


@query("sc6_descriptor_family", """
  select regexp_extract(p_type || '_' || p_size || 'd', '^([A-Za-z]+)', 1) as family, count(*) as n from part group by 1""")
def descriptor_family(spark, sf):
    f = texts.descriptor_family(F.concat("p_type", F.lit("_"), F.col("p_size").cast("string"), F.lit("d")))
    return table(spark, sf, "part").groupBy(f.alias("family")).agg(F.count(F.lit(1)).alias("n"))


@query("sc7_fingerprint_columns", """
  select case p_partkey % 5 when 0 then 'rdkit' when 1 then 'morgan' when 2 then 'morgan' when 3 then 'maccs' end as fp_type,
    case when p_partkey % 5 < 4 then p_size end as bit, count(*) as n from part group by all""")
def fingerprint_columns(spark, sf):
    m, s = F.col("p_partkey") % 5, F.format_string("%03d", "p_size")
    name = (F.when(m == 0, F.concat(F.lit("RDKit_"), s)).when(m == 1, F.concat(F.lit("fp-"), s)).when(m == 2, F.concat(F.lit("ECFP"), s))
            .when(m == 3, F.concat(F.lit("maccs_"), s)).otherwise(F.concat(F.lit("weight_"), s)))
    p = table(spark, sf, "part").select(name.alias("name"))
    return p.groupBy(texts.fingerprint_type(F.col("name")).alias("fp_type"), texts.fingerprint_bit(F.col("name")).alias("bit")).agg(
        F.count(F.lit(1)).alias("n"))


@query("sc8_safe_names", """
  select p_partkey, trim(replace(replace(p_brand || ' ' || p_name, '#', '_'), ' ', '_'), '_') as identifier,
    replace(replace(p_brand || ' ' || p_name, ' ', '_'), '#', '') as slug,
    'rxn_' || lpad(p_partkey::varchar, greatest(4, length(p_partkey::varchar))::int, '0') || '_' || replace(p_name, ' ', '_') as export_name from part""")
def safe_names(spark, sf):
    p = table(spark, sf, "part")
    label = F.concat_ws(" ", "p_brand", "p_name")
    return p.select("p_partkey", texts.safe_identifier(label).alias("identifier"), texts.slug(label).alias("slug"),
                    texts.export_name(F.lit(""), F.col("p_partkey"), F.col("p_name")).alias("export_name"))


@query("sc9_reaction_text", """
  select p_partkey, case when p_partkey % 3 = 0 then null
    else string_split(p_name, ' ')[1] || '.' || string_split(p_name, ' ')[2] || '>>' || p_type end as reaction from part""")
def reaction_text(spark, sf):
    p = table(spark, sf, "part")
    left = F.translate("p_name", " ", "+")
    right = F.when(F.col("p_partkey") % 3 == 0, " ? ").otherwise(F.concat(F.col("p_type"), F.lit(" . ?")))
    return p.select("p_partkey", texts.reaction_text(left, right).alias("reaction"))


@query("sc10_split_labels", """
  select case o_orderstatus when 'F' then 'Train' when 'O' then 'Test' else 'CV/validation' end as label, count(*) as n from orders group by 1""")
def split_labels(spark, sf):
    s = F.when(F.col("o_orderstatus") == "F", "training set").when(F.col("o_orderstatus") == "O", "TEST").otherwise("Cross-Validation")
    return table(spark, sf, "orders").groupBy(texts.split_label(s).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("sc11_number_text", """
  select p_partkey, case when p_partkey % 10 = 0 then 'n/a' else printf('%.2f', p_size / 8.0 + 0.001) end as txt,
    case when p_size / 50.0 >= 0.8 then 'strong' when p_size / 50.0 >= 0.6 then 'moderate' when p_size / 50.0 >= 0.4
      then 'weak-to-moderate' else 'weak' end as r2_class from part""")
def number_text(spark, sf):
    p = table(spark, sf, "part")
    v = F.when(F.col("p_partkey") % 10 != 0, F.col("p_size") / 8.0 + 0.001)
    return p.select("p_partkey", texts.number_text(v, 2).alias("txt"), texts.r2_class(F.col("p_size") / 50.0).alias("r2_class"))


@query("sc12_search_blob", "select s_suppkey, s_suppkey || ' | ' || s_name || ' |  | ' || s_nationkey as blob from supplier")
def search_blob(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select("s_suppkey", texts.search_blob(F.col("s_suppkey"), F.col("s_name"), F.lit(None), F.col("s_nationkey")).alias("blob"))


@query("flt20_flag_coercion", """
  select o_orderpriority, count(*) filter (o_orderkey % 4 < 2) as n_text_true, count(*) filter (o_custkey % 3 > 0) as n_number_true from orders group by 1""")
def flag_coercion(spark, sf):
    from compoundry.functions.missing import to_bool_flag

    o = table(spark, sf, "orders")
    words = F.element_at(F.array(F.lit(" Yes"), F.lit("IN_DOMAIN"), F.lit("out"), F.lit(None)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.groupBy("o_orderpriority").agg(
        F.count_if(to_bool_flag(words, "string")).alias("n_text_true"),
        F.count_if(to_bool_flag(F.col("o_custkey") % 3, "bigint")).alias("n_number_true"))
