"""Queries over structure texts derived from the part table."""

from __future__ import annotations

from pyspark.sql import functions as F

from compoundry.chem import facts, kernels
from compoundry.operators import quality, scaffolds, similarity, splits
from compoundry.plans import inputs
from compoundry.plans.fragment_queries import FORMULAS_SQL, PATHS_SQL, SHELLS_SQL
from compoundry.plans.inputs import MOLECULES_SQL, spread, table
from compoundry.plans.registry import query
from compoundry.session import reliable_checkpoint

HEAVY = r"len(regexp_extract_all(smiles, '\[[^\]]*\]|Br|Cl|[BCNOSPFIbcnops]'))"
VALID = "smiles not in ('', 'C1CC(')"
# Salt-free, readable rows and the ring they carry.
RING = "case p_partkey % 7 when 0 then 'c1ccccc1' when 1 then 'c1ccncc1' when 2 then 'C1CCCCC1' when 3 then 'c12c(cccc1)cccc2' when 4 then 'C1CCNCC1' when 5 then 'c1ccoc1' else '__no_scaffold__' end"
PARTS_SQL = f"""{MOLECULES_SQL}, rings as (select m.*, {RING} as ring, (p_partkey // 7) % 12 as e, p_size % 6 as chain, p_partkey
   from molecules m join part on p_partkey = row_index)"""


def molecules(spark, sf):
    return spread(inputs.molecules(spark, sf))


@query("ch1_parse_status", f"with {MOLECULES_SQL} select case when smiles = '' then 'Empty SMILES.' when smiles = 'C1CC(' then 'Invalid SMILES.' else '' end as error, count(*) as n from molecules group by 1")
def parse_status(spark, sf):
    m = facts.with_structure(molecules(spark, sf), "smiles")
    return m.groupBy(F.col("mol.error").alias("error")).agg(F.count(F.lit(1)).alias("n"))


def with_facts(spark, sf):
    return facts.by_text(molecules(spark, sf), "smiles", lambda t: facts.facts(facts.with_structure(t, "smiles")).drop("mol"))


@query("ch3_compact_descriptors", f"""with {MOLECULES_SQL} select row_index, {HEAVY} as heavy_atoms, len(string_split(smiles, '.')) as n_fragments,
   len(regexp_extract_all(regexp_replace(smiles, '\\[[^\\]]*\\]', '', 'g'), '[0-9]')) // 2 as n_rings,
   {HEAVY} - len(regexp_extract_all(replace(smiles, 'Cl', 'X'), '[Cc]')) as n_hetero_atoms,
   len(regexp_extract_all(smiles, '[bcnops]')) as aromatic_atoms, contains(smiles, '13C')::int as has_isotope, contains(smiles, 'Na')::int as has_metal
 from molecules where {VALID}""".replace("replace(smiles, 'Cl', 'X'), '[Cc]'", "replace(replace(smiles, 'Cl', 'X'), 'Na', 'X'), '[Cc]'").replace("len(regexp_extract_all(smiles, '[bcnops]'))", "len(regexp_extract_all(replace(replace(replace(smiles, 'Cl', 'X'), 'Br', 'X'), 'Na', 'X'), '[bcnops]'))"))
def compact_descriptors(spark, sf):
    m = with_facts(spark, sf).where("ok_parse")
    i = lambda c: F.col(c).cast("int").alias(c)
    return m.select("row_index", "heavy_atoms", "n_fragments", "n_rings", "n_hetero_atoms", "aromatic_atoms", i("has_isotope"), i("has_metal"))


MASS = """case e when 0 then 17.007 when 1 then 16.023 when 2 then 45.017 when 3 then 18.998 when 4 then 35.45 when 5 then 26.018 when 6 then 80.081
   when 7 then 46.005 when 8 then 79.904 when 9 then 31.034 when 10 then 41.073 when 11 then 59.088 end"""


@query("ch3_molecular_weight", f"""with {PARTS_SQL} select row_index, round({MASS} + chain * 14.027 + case row_index % 7 when 0 then 77.106 when 1 then 78.094 when 2 then 83.154
   when 3 then 127.166 when 4 then 84.142 when 5 then 67.067 else case when e = 7 and chain = 0 then 0 else 1.008 end end
   + case when contains(smiles, 'Na') then 58.44 when contains(smiles, '13C') then 17.032 when contains(smiles, '.') then 18.015 else 0 end, 4)::double as molecular_weight from rings where {VALID}""")
def molecular_weight(spark, sf):
    m = with_facts(spark, sf).where("ok_parse")
    return m.select("row_index", F.round("molecular_weight", 4).alias("molecular_weight"))


TPSA = """case when e = 0 then case when chain = 0 and row_index % 7 = 6 then 31.5 else 20.23 end when e = 1 then case when chain = 0 and row_index % 7 = 6 then 35.0 else 26.02 end
   when e = 2 then 37.30 when e = 5 then 23.79 when e = 6 then 60.16 when e = 7 then case when chain = 0 and row_index % 7 = 6 then 54.23 else 43.14 end
   when e = 9 then case when chain = 0 and row_index % 7 = 6 then 20.23 else 9.23 end when e = 11 then 20.23 else 0 end
   + case row_index % 7 when 1 then 12.89 when 4 then 12.03 when 5 then 13.14 else 0 end + case when smiles like '%.O' then 31.5 else 0 end"""


def with_surface(spark, sf):
    work = lambda t: facts.with_polar_surface(facts.facts(facts.with_structure(t, "smiles"))).drop("mol")
    return facts.by_text(molecules(spark, sf), "smiles", work).where("ok_parse")


@query("ch3_tpsa", f"with {PARTS_SQL} select row_index, round({TPSA}, 4)::double as tpsa from rings where {VALID}")
def polar_surface(spark, sf):
    return with_surface(spark, sf).select("row_index", F.round("tpsa", 4).alias("tpsa"))


@query("flt2_veber_from_structures", f"""with {PARTS_SQL}, f as (select row_index, {TPSA} as tpsa from rings where {VALID})
 select count(*) filter (tpsa <= 40) as n_pass, count(*) filter (tpsa > 40) as n_fail from f""")
def veber_from_structures(spark, sf):
    from compoundry.operators import rules

    # no structure of this table has more than ten rotatable bonds, so a low surface limit decides
    m = with_surface(spark, sf).withColumn("pass", rules.veber_pass(tpsa=40.0))
    return m.agg(F.count_if("pass").alias("n_pass"), F.count_if(~F.col("pass")).alias("n_fail"))


@query("ch3_contribution_sums", f"""with {PARTS_SQL} select row_index, round({TPSA}, 4)::double as value from rings
 where {VALID} and not (chain = 0 and row_index % 7 = 6 and e in (0, 1, 7)) and smiles not like '%.O' and smiles not like '%Na%'""")
def contribution_sums(spark, sf):
    """The published surface table, with nought for carbon and the other atoms, as a supplied one."""
    rows = molecules(spark, sf).select("row_index", "smiles").where(~F.col("smiles").contains("[Na+]"))
    m = reliable_checkpoint(facts.with_structure(facts.texts_of(rows, "smiles"), "smiles"))
    rest = m.where("mol.ok").select(F.explode(facts.atom_environments()).alias("environment")).distinct().where(~F.substring("environment", 1, 1).isin("N", "n", "O", "o"))
    table_ = spark.createDataFrame(list(facts.POLAR_SURFACE.items()), "environment string, contribution double").unionAll(rest.withColumn("contribution", F.lit(0.0)))
    sums = facts.contribution_sums(m, "smiles", table_)
    out = facts.by_text(rows, "smiles", lambda t: t.join(sums, "smiles"))
    return out.where(F.col("value").isNotNull()).select("row_index", F.round("value", 4).alias("value"))


@query("ch17_formulas", FORMULAS_SQL)
def formulas(spark, sf):
    m = facts.with_structure(molecules(spark, sf), "smiles").where("mol.ok")
    return m.groupBy(facts.formula(F.col("mol.atoms")).alias("formula")).agg(F.count(F.lit(1)).alias("n"))


@query("sc13_canonical_identity", f"""with {MOLECULES_SQL} select count(*) as n_rows, count(*) filter ({VALID}) as n_readable from molecules""")
def canonical_identity(spark, sf):
    m = molecules(spark, sf).withColumn("key", kernels.canonical(F.col("smiles")))
    return m.agg(F.count(F.lit(1)).alias("n_rows"), F.count("key").alias("n_readable"))


@query("src10_conversion_report", f"""with {MOLECULES_SQL} select count(*) filter ({VALID}) as valid_rows, count(*) filter (smiles = 'C1CC(') as invalid_rows,
   count(*) filter (smiles = '') as skipped_rows from molecules""")
def conversion_report(spark, sf):
    m = facts.with_structure(molecules(spark, sf), "smiles")
    return m.agg(F.count_if("mol.ok").alias("valid_rows"), F.count_if(F.col("mol.error") == "Invalid SMILES.").alias("invalid_rows"),
                 F.count_if(F.col("mol.error") == "Empty SMILES.").alias("skipped_rows"))


def quality_table(spark, sf):
    key = F.coalesce(kernels.canonical(F.col("smiles")), F.lit(""))
    m = facts.by_text(molecules(spark, sf), "smiles", lambda t: facts.facts(facts.with_structure(t, "smiles")).withColumn("duplicate_key", key))
    return quality.quality_control(m)


@query("ch13_structure_issues", f"""with {MOLECULES_SQL} select code, n_rows from (
   select 'INVALID_STRUCTURE' as code, count(*) filter (not {VALID}) as n_rows from molecules union all
   select 'MULTI_FRAGMENT', count(*) filter (contains(smiles, '.')) from molecules union all
   select 'METAL_PRESENT', count(*) filter (contains(smiles, 'Na')) from molecules union all
   select 'ISOTOPE_PRESENT', count(*) filter (contains(smiles, '13C')) from molecules union all
   select 'TOO_SMALL', count(*) filter ({VALID} and {HEAVY} < 3) from molecules) where n_rows > 0""")
def structure_issues(spark, sf):
    from compoundry.operators.contract import issue_counts

    counts = issue_counts(quality_table(spark, sf), "issue_codes")
    wanted = ("INVALID_STRUCTURE", "MULTI_FRAGMENT", "METAL_PRESENT", "ISOTOPE_PRESENT", "TOO_SMALL")
    return counts.where(F.col("code").isin(*wanted)).select("code", F.col("count").alias("n_rows"))


@query("ch12_standardized_structures", f"""with {MOLECULES_SQL} select count(*) filter ({VALID}) as n_ok, count(*) filter (contains(smiles, '.')) as n_stripped from molecules""")
def standardized(spark, sf):
    m = facts.by_text(molecules(spark, sf), "smiles", lambda t: t.withColumn("std", kernels.standardize(F.col("smiles"), "qsar_ready")))
    return m.agg(F.count_if("std.ok").alias("n_ok"), F.count_if(F.col("std.log").contains("LargestFragmentChooser")).alias("n_stripped"))


@query("ch14_scaffolds", f"with {PARTS_SQL} select row_index, ring as murcko from rings where {VALID}")
def scaffold_rows(spark, sf):
    s = scaffolds.annotate(molecules(spark, sf), "smiles")
    return s.where(F.col("murcko").isNotNull()).select("row_index", "murcko")


@query("agg4_scaffold_summary", f"""with {PARTS_SQL} select ring as scaffold, count(*) as count, round(count(*) / sum(count(*)) over (), 4) as fraction from rings where {VALID} group by ring""")
def scaffold_summary(spark, sf):
    return scaffolds.summary(scaffolds.annotate(molecules(spark, sf), "smiles"))


@query("agg5_scaffold_activity", f"""with {PARTS_SQL} select ring as scaffold, count(*) as count, round(avg(activity), 4) as mean_activity, round(min(activity), 4) as best_activity,
   round(max(activity), 4) as worst_activity, round(stddev_samp(activity), 4) as std_activity from rings where {VALID} group by ring""")
def scaffold_activity(spark, sf):
    return scaffolds.activity_summary(scaffolds.annotate(molecules(spark, sf), "smiles"), "murcko", "activity")


@query("agg6_chemical_series", f"""with {PARTS_SQL} select ring as scaffold, count(*) as count, round(max(activity), 4) as best_activity from rings where {VALID} group by ring having count(*) >= 2""")
def chemical_series(spark, sf):
    s = scaffolds.series(scaffolds.annotate(molecules(spark, sf), "smiles"), "murcko", "activity", log_scale=True, min_size=2)
    return s.select("scaffold", "count", "best_activity")


@query("agg6_series_summary", f"""with {PARTS_SQL} select count(*) as n_rows, count(*) filter ({VALID}) as n_valid_molecules, count(*) filter (not {VALID}) as n_invalid_molecules,
   count(distinct ring) filter ({VALID}) as n_series, count(*) filter ({VALID} and ring = '__no_scaffold__') as n_acyclic_rows from rings""")
def series_summary(spark, sf):
    return scaffolds.series_summary(scaffolds.annotate(molecules(spark, sf), "smiles"), "murcko").drop("n_singleton_series")


@query("srt4_scaffold_split", f"""with {PARTS_SQL} select count(*) filter ({VALID}) as n_assigned, count(*) filter (not {VALID}) as n_invalid from rings""")
def scaffold_split(spark, sf):
    s = scaffolds.annotate(molecules(spark, sf), "smiles").select("row_index", "murcko")
    out = splits.group_split(s, "murcko")
    return out.agg(F.count_if(F.col("split") != "invalid").alias("n_assigned"), F.count_if(F.col("split") == "invalid").alias("n_invalid"))


@query("flt13_substructure_search", f"with {PARTS_SQL} select row_index from rings where {VALID} and ring = 'c1ccncc1'")
def substructure(spark, sf):
    return molecules(spark, sf).where(kernels.has_pattern(F.col("smiles"), "n1ccccc1")).select("row_index")


@query("flt13_exact_search", f"with {PARTS_SQL} select row_index from rings where smiles = 'OCCc1ccccc1'")
def exact_search(spark, sf):
    return molecules(spark, sf).where(kernels.canonical(F.col("smiles")) == kernels.canonical(F.lit("c1ccc(CCO)cc1"))).select("row_index")


GROUPS = {"nitro": "[$([NX3](=O)=O),$([N+](=O)[O-])]", "nitrile": "[CX2]#N", "sulfonamide": "S(=O)(=O)N", "halogenated": "[F,Cl,Br,I]",
          "carboxylic_acid": "[CX3](=O)[OX2H1]", "pyridine": "n1ccccc1"}


@query("jn7_functional_groups", f"""with {PARTS_SQL} select row_index, pattern from (
   select row_index, 'nitro' as pattern from rings where {VALID} and e = 7 union all select row_index, 'nitrile' from rings where {VALID} and e = 5 union all
   select row_index, 'sulfonamide' from rings where {VALID} and e = 6 union all select row_index, 'halogenated' from rings where {VALID} and (e in (3, 4, 8) or contains(smiles, '[Cl-]')) union all
   select row_index, 'carboxylic_acid' from rings where {VALID} and e = 2 union all select row_index, 'pyridine' from rings where {VALID} and ring = 'c1ccncc1')""")
def functional_groups(spark, sf):
    hits = kernels.pattern_hits(F.col("smiles"), list(GROUPS), list(GROUPS.values()))
    return molecules(spark, sf).select("row_index", F.explode(hits).alias("h")).select("row_index", "h.pattern")


@query("flt6_alert_labels", f"""with {PARTS_SQL} select row_index, case when e = 7 then 'nitro' when e in (3, 4, 8) or contains(smiles, '[Cl-]') then 'halogen' else 'None' end as alerts from rings where {VALID}
   and not (e = 7 and contains(smiles, '[Cl-]')) union all select row_index, 'halogen, nitro' from rings where {VALID} and e = 7 and contains(smiles, '[Cl-]')""")
def alert_labels(spark, sf):
    hits = kernels.pattern_hits(F.col("smiles"), ["nitro", "halogen"], ["[N+](=O)[O-]", "[F,Cl,Br,I]"])
    m = molecules(spark, sf).select("row_index", "smiles", hits.alias("h")).where(kernels.canonical(F.col("smiles")).isNotNull())
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("h", lambda x: x["pattern"]))), ", ")
    return m.select("row_index", F.when(names == "", "None").otherwise(names).alias("alerts"))


@query("ch15_r_groups", f"with {PARTS_SQL} select row_index from rings where {VALID} and ring in ('c1ccccc1', 'c12c(cccc1)cccc2')")
def r_groups(spark, sf):
    hit, _ = scaffolds.r_group_table(molecules(spark, sf), "smiles", "c1ccccc1")
    return hit.select("row_index")


@query("ch11_path_fragments", PATHS_SQL)
def path_fragments(spark, sf):
    texts = reliable_checkpoint(facts.with_structure(facts.texts_of(molecules(spark, sf), "smiles"), "smiles"))
    f = facts.path_fragments(texts, ["smiles", "n_rows"])
    return facts.fragment_vocabulary(f, 5, "n_rows")


@query("ch11_shell_fragments", SHELLS_SQL)
def shell_fragments(spark, sf):
    texts = reliable_checkpoint(facts.with_structure(facts.texts_of(molecules(spark, sf), "smiles"), "smiles"))
    return facts.fragment_vocabulary(facts.shell_fragments(texts, ["smiles", "n_rows"]), 2, "n_rows")


def circular(spark, sf):
    m = facts.circular_bits(facts.with_structure(molecules(spark, sf), "smiles"))
    return m.where(F.col("bits").isNotNull())


@query("ch7_circular_fingerprints")
def circular_fingerprints(spark, sf):
    return circular(spark, sf).select("row_index", F.size("bits").alias("n_on"))


@query("ch7_low_variance_bits")
def low_variance_bits(spark, sf):
    return facts.low_variance_bits(circular(spark, sf), "bits")


@query("jn2_structure_cliffs")
def structure_cliffs(spark, sf):
    m = circular(spark, sf).select("row_index", similarity.words_from_bits(F.col("bits"), 2048).alias("fp"), (1 + (F.col("row_index") * 7919) % 1000).alias("act"))
    return similarity.activity_cliffs(m, "fp", "row_index", "act", 0.6, 10.0, False, 200)


REGISTRY_SQL = """
 e as (select p_partkey as entry_id, p_name as name, p_type as family, case when p_size % 5 = 0 then 'functional groups' when p_size % 7 = 0 then 'cyclic' else '' end as grp,
   p_size % 11 = 0 as dehydro, p_size % 3 as hetero, p_size % 2 as rings from part),
 s as (select *, case when contains(grp, 'functional') then 'functional_group_registry' when dehydro then 'aromaticity_dehydro' when hetero > 0 then 'heterocycle_registry'
   when rings > 0 or contains(grp, 'cyclic') then 'carbocycle_registry' else 'functional_group_registry' end as section from e)
"""


def registry_entries(spark, sf):
    from compoundry.operators import registry

    s = F.col("p_size")
    e = table(spark, sf, "part").select(
        F.col("p_partkey").alias("entry_id"), F.col("p_name").alias("name"), F.col("p_type").alias("family"), F.lit("C").alias("smarts"),
        F.when(s % 5 == 0, "functional groups").when(s % 7 == 0, "cyclic").otherwise("").alias("grp"), (s % 11 == 0).alias("dehydro"),
        (s % 3).alias("hetero"), (s % 2).alias("rings"))
    return e.withColumn("section", registry.section(F.col("grp"), F.col("family"), F.col("name"), F.col("dehydro"), F.lit(False), F.col("hetero"), F.col("rings")))


PRINT_SQL = f"""{REGISTRY_SQL}, w as (select *, case section when 'heterocycle_registry' then 2048 when 'carbocycle_registry' then 3072 when 'functional_group_registry' then 3328
   else 3840 end as low, case section when 'heterocycle_registry' then 1024 when 'carbocycle_registry' then 256 when 'functional_group_registry' then 384 else 128 end as width from s),
 mt as (select distinct l_orderkey as molecule, l_partkey as entry_id from lineitem union select l_orderkey, l_suppkey from lineitem where l_suppkey % 3 = 0),
 sp as (select molecule, section, (low + entry_id % width)::int as bit, count(*) as n_entries from mt join w using (entry_id) group by 1, 2, 3)"""


def registry_print(spark, sf):
    """Orders as molecules that match the parts they hold; bits here by the entry's number, so that SQL can follow."""
    from compoundry.operators import registry

    span = F.create_map(*[x for k, (a, b) in registry.SECTIONS.items() for x in (F.lit(k), F.struct(F.lit(a).alias("low"), F.lit(b - a).alias("width")))])
    entries = registry_entries(spark, sf).withColumn("_s", F.element_at(span, F.col("section")))
    entries = entries.withColumn("bit", (F.col("_s.low") + F.col("entry_id") % F.col("_s.width")).cast("int")).drop("_s")
    li = table(spark, sf, "lineitem")
    matches = li.select(F.col("l_orderkey").alias("molecule"), F.explode(F.array("l_partkey", F.when(F.col("l_suppkey") % 3 == 0, F.col("l_suppkey")))).alias("entry_id"))
    return registry.sparse_print(matches, entries, "molecule"), entries


@query("ch9_registry_print", f"with {PRINT_SQL} select * from sp")
def sparse_registry_print(spark, sf):
    return registry_print(spark, sf)[0]


@query("ch9_print_sizes", f"with {PRINT_SQL} select molecule, count(distinct bit)::int as n_on from sp group by 1")
def print_sizes(spark, sf):
    from compoundry.operators import registry

    return registry.dense_print(registry_print(spark, sf)[0], "molecule").select("molecule", "n_on")


@query("snk10_bit_support", f"""with {PRINT_SQL}, n as (select section, bit, count(*) as n_molecules, count(*) filter (n_entries > 1) as n_collided from sp group by 1, 2),
 lb as (select (low + entry_id % width)::int as bit, min(entry_id) as first, arg_min(section, entry_id) as sec, count(*) as k from w group by 1)
 select section, bit, n_molecules, n_collided, sec || '_' || bit || '_' || first || case when k > 1 then '+' || (k - 1) else '' end as label from n join lb using (bit)""")
def registry_bit_support(spark, sf):
    from compoundry.operators import registry

    sparse, entries = registry_print(spark, sf)
    return registry.bit_support(sparse).join(registry.bit_labels(entries), "bit")


@query("ch10_registry_issues", """with p as (select p_partkey % 900 as entry_id, case when p_size % 4 = 0 then '' when p_size % 4 = 1 then p_name || '[' when p_size % 4 = 2 then '(' || p_name else p_name end as smarts,
   case when p_size % 9 = 0 then p_type else 'morgan' end as section from part)
 select entry_id, 'empty_pattern' as issue from p where smarts = '' union select entry_id, 'unbalanced_brackets' from p where contains(smarts, '[')
 union select entry_id, 'unbalanced_parentheses' from p where contains(smarts, '(') union select entry_id, 'unknown_section' from p where section <> 'morgan'
 union select entry_id, 'duplicate_id' from p group by entry_id having count(*) > 1""")
def registry_entry_issues(spark, sf):
    from compoundry.operators import registry

    kind = F.col("p_size") % 4
    e = table(spark, sf, "part").select(
        (F.col("p_partkey") % 900).alias("entry_id"),
        F.when(kind == 0, "").when(kind == 1, F.concat("p_name", F.lit("["))).when(kind == 2, F.concat(F.lit("("), "p_name")).otherwise(F.col("p_name")).alias("smarts"),
        F.when(F.col("p_size") % 9 == 0, F.col("p_type")).otherwise("morgan").alias("section"))
    return registry.registry_issues(e)


@query("sc15_registry_sections", f"with {REGISTRY_SQL} select entry_id, section from s")
def registry_sections(spark, sf):
    return registry_entries(spark, sf).select("entry_id", "section")


@query("agg15_registry_audit", f"with {REGISTRY_SQL} select section, count(*)::bigint as entries from s group by 1")
def registry_audit(spark, sf):
    from compoundry.operators import registry

    return registry.section_audit(registry.with_bits(registry_entries(spark, sf))).select("section", "entries")


@query("sc3_registry_bits")
def registry_bits(spark, sf):
    from compoundry.operators import registry

    return registry.with_bits(registry_entries(spark, sf)).select("entry_id", "section", "bit")


@query("set5_merged_rules", "select p_type || '>>' || p_name as smirks, min(p_brand) as name, sum(p_size)::double as weight from part group by 1")
def merged_rules(spark, sf):
    from compoundry.operators import registry

    p = table(spark, sf, "part").select(F.col("p_brand").alias("name"), F.concat("p_type", F.lit(">>"), "p_name").alias("smirks"), F.col("p_size").cast("double").alias("weight"), "p_partkey")
    parts = [p.where(F.col("p_partkey") % 3 == k).drop("p_partkey") for k in (0, 1, 2)]
    bad = p.limit(1).select("name", F.lit("no arrow").alias("smirks"), "weight")
    return registry.merge_rules(parts + [bad])


@query("snk5_export_report", f"with {MOLECULES_SQL} select row_index, case when smiles = '' then 'failed' else 'written' end as status, '{{\"series\":\"' || series || '\"}}' as props_json from molecules")
def export_report(spark, sf):
    from compoundry.sources import sinks

    m = inputs.molecules(spark, sf).select("row_index", "name", "smiles", "series")
    return sinks.export_report(sinks.export_records(m, "smiles", "name")).select("row_index", "status", "props_json")


@query("flt13_superstructure_search", f"with {PARTS_SQL} select row_index from rings where smiles in ('O', 'OC', 'OCC', 'CO', 'OCCc1ccccc1')")
def superstructure(spark, sf):
    from compoundry.operators import search

    return search.search(molecules(spark, sf), "smiles", "OCCc1ccccc1", "superstructure").select("row_index")


@query("flt13_similarity_search")
def similarity_search(spark, sf):
    from compoundry.operators import search

    return search.search(molecules(spark, sf), "smiles", "OCCc1ccccc1", "similarity", 0.6).select("row_index", F.round("similarity", 6).alias("similarity"))


@query("ad20_standardization_fields", f"with {MOLECULES_SQL} select case when {VALID} then 'QSAR-ready' else 'Blocked' end as curation_status, count(*) as n from molecules group by 1")
def standardization_fields(spark, sf):
    from compoundry.operators import intake

    m = molecules(spark, sf).withColumn("std", kernels.standardize(F.col("smiles")))
    m = m.withColumn("status", F.when(F.col("std.ok"), "ok").otherwise("failed"))
    return intake.with_standardization_stage(m, "status", "qsar_ready").groupBy("curation_status").agg(F.count(F.lit(1)).alias("n"))
