"""Fragment, path print and motif queries; their SQL builds atoms and bonds from the recipe of the texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from compoundry.chem import fragments
from compoundry.operators import details
from compoundry.plans import inputs
from compoundry.plans.inputs import spread
from compoundry.plans.registry import query

# Atoms in text order with their bonds (from, to, sign); an aromatic atom in lower case, '!' a bracket atom without hydrogens.
_ENDS = [("O", "", 0), ("N", "", 0), ("O C O", "0-1 1=2", 1), ("F", "", 0), ("Cl", "", 0), ("N C", "0#1", 1), ("N S O O", "0-1 1=2 1=3", 1),
         ("O! N! O", "0-1 1=2", 1), ("Br", "", 0), ("C O", "0-1", 1), ("C C C", "0-1 1=2", 2), ("C C C O", "0-1 1-2 1-3", 1)]
_RINGS = [("c c c c c c", "0:1 1:2 2:3 3:4 4:5 0:5"), ("c c c n c c", "0:1 1:2 2:3 3:4 4:5 0:5"), ("C C C C C C", "0-1 1-2 2-3 3-4 4-5 0-5"),
          ("c c c c c c c c c c", "0:1 1:2 2:3 3:4 4:5 5:6 6:7 7:8 3:8 8:9 0:9"), ("C C C N C C", "0-1 1-2 2-3 3-4 4-5 0-5"),
          ("c c c o c", "0:1 1:2 2:3 3:4 0:4"), ("", "")]
_SALTS = ["Na! Cl!", "O", "C"]


def _atoms(text: str) -> str:
    return f"{text.split()}::varchar[]"


def _bonds(text: str) -> str:
    return "[" + ", ".join(f"{{'a': {x[0]}, 'b': {x[2]}, 's': '{x[1]}'}}" for x in text.split()) + "]::struct(a bigint, b bigint, s varchar)[]"


def _pick(values: list[str], index: str) -> str:
    return f"([{', '.join(values)}])[{index}]"


#: atoms (row_index, i, label, shown, el) and both directions of all bonds, edges (row_index, a, b, s)
GRAPH_SQL = f"""
 kit as (select p_partkey as row_index, p_size % 6 as chain, {_pick([_atoms(a) for a, _, _ in _ENDS], "(p_partkey // 7) % 12 + 1")} as ea,
   {_pick([_bonds(b) for _, b, _ in _ENDS], "(p_partkey // 7) % 12 + 1")} as eb, {_pick([str(x) for _, _, x in _ENDS], "(p_partkey // 7) % 12 + 1")} as hook,
   {_pick([_atoms(a) for a, _ in _RINGS], "p_partkey % 7 + 1")} as ra, {_pick([_bonds(b) for _, b in _RINGS], "p_partkey % 7 + 1")} as rb,
   case when p_partkey % 23 = 0 then {_pick([_atoms(a) for a in _SALTS], "p_partkey % 3 + 1")} else []::varchar[] end as sa
   from part where p_partkey % 41 <> 0 and p_partkey % 43 <> 0),
 graph as (select row_index, ea || list_transform(range(chain), lambda x: 'C') || ra || sa as labels,
   eb || list_transform(range(chain), lambda x: {{'a': case when x = 0 then hook else len(ea) + x - 1 end, 'b': len(ea) + x, 's': '-'}})
   || case when len(ra) > 0 then [{{'a': case when chain = 0 then hook else len(ea) + chain - 1 end, 'b': len(ea) + chain, 's': '-'}}] else [] end
   || list_transform(rb, lambda x: {{'a': x.a + len(ea) + chain, 'b': x.b + len(ea) + chain, 's': x.s}}) as bonds from kit),
 labelled as (select row_index, unnest(range(len(labels))) as i, unnest(labels) as label from graph),
 atoms as (select row_index, i, label, replace(label, '!', '') as shown, upper(label[1]) || replace(label[2:], '!', '') as el from labelled),
 half as (select row_index, unnest(bonds) as e from graph),
 edges as (select row_index, e.a as a, e.b as b, e.s as s from half union all select row_index, e.b, e.a, e.s from half)"""


def paths_sql(longest: int) -> str:
    """paths: every walk over different atoms, of one atom up to ``longest``."""
    return f"""{GRAPH_SQL},
 paths as (select row_index, [i] as p, [shown] as t from atoms union all
   select w.row_index, list_append(w.p, e.b), w.t || [e.s, n.shown] from paths w join edges e on e.row_index = w.row_index and e.a = w.p[-1]
   join atoms n on n.row_index = e.row_index and n.i = e.b where len(w.p) < {longest} and not list_contains(w.p, e.b)),
 texts as (select row_index, least(array_to_string(t, ''), array_to_string(list_reverse(t), '')) as fragment from paths where len(p) > 1 and p[1] < p[-1])"""


PATHS_SQL = f"with recursive {paths_sql(4)} select fragment, count(distinct row_index) as support from texts group by 1 having count(distinct row_index) >= 5"

SHELLS_SQL = f"""with {GRAPH_SQL}, near as (select x.row_index, x.i, any_value(x.shown) as shown, list_sort(list(e.s || n.shown) filter (e.s is not null)) as around
   from atoms x left join edges e on e.row_index = x.row_index and e.a = x.i left join atoms n on n.row_index = e.row_index and n.i = e.b group by 1, 2)
 select shown || '(' || coalesce(array_to_string(around, ''), '') || ')' as fragment, count(distinct row_index) as support from near group by 1 having count(distinct row_index) >= 2"""

FORMULAS_SQL = f"""with {GRAPH_SQL}, used as (select x.row_index, x.i, any_value(x.label) as label, any_value(x.el) as el,
   coalesce(sum(case e.s when '=' then 2 when '#' then 3 when '-' then 1 when ':' then 1 end), 0) as total
   from atoms x left join edges e on e.row_index = x.row_index and e.a = x.i group by 1, 2),
 filled as (select row_index, el, case when contains(label, '!') or label in ('n', 'o') then 0 when label = 'c' then 3 - total when el = 'C' then 4 - total
   when el = 'N' then 3 - total when el = 'O' then 2 - total when el = 'S' then 6 - total else 1 - total end as h from used),
 counts as (select row_index, el, count(*) as n from filled group by 1, 2 union all select row_index, 'H', sum(h) from filled group by 1 having sum(h) > 0),
 forms as (select row_index, string_agg(el || case when n > 1 then n::bigint::varchar else '' end, '' order by case el when 'C' then 0 when 'H' then 1 else 2 end, el) as formula
   from counts group by 1)
 select formula, count(*) as n from forms group by 1"""

TRIPLETS_SQL = f"""with recursive {GRAPH_SQL},
 walks as (select row_index, a, b, 1 as d from edges union select w.row_index, w.a, e.b, w.d + 1 from walks w join edges e on e.row_index = w.row_index and e.a = w.b
   where w.d < 4 and e.b <> w.a),
 far as (select row_index, a, b, min(d) as d from walks where a < b group by 1, 2, 3),
 three as (select x.row_index, list_sort([p.el, q.el, r.el]) as els, list_sort([x.d, y.d, z.d]) as ds
   from far x join far y on y.row_index = x.row_index and y.a = x.a and x.b < y.b join far z on z.row_index = x.row_index and z.a = x.b and z.b = y.b
   join atoms p on p.row_index = x.row_index and p.i = x.a join atoms q on q.row_index = x.row_index and q.i = x.b
   join atoms r on r.row_index = x.row_index and r.i = y.b where greatest(x.d, y.d, z.d) >= 2)"""


def classes(spark, sf):
    return fragments.structure_classes(spread(inputs.molecules(spark, sf)), "row_index", "smiles")


@query("ch11_triplet_counts", f"""{TRIPLETS_SQL} select row_index, array_to_string(els, '.') || '-' || array_to_string(ds, '.') as fragment, count(*) as count
 from three group by 1, 2""")
def triplet_counts(spark, sf):
    c = classes(spark, sf)
    return c.members.join(fragments.triplets(c), "_class").select("row_index", "fragment", "count")


@query("ch11_triplet_vocabulary", f"""{TRIPLETS_SQL} select array_to_string(els, '.') || '-' || array_to_string(ds, '.') as fragment, count(distinct row_index)::bigint as support
 from three group by 1 having count(distinct row_index) >= 5""")
def triplet_vocabulary(spark, sf):
    c = classes(spark, sf)
    return fragments.class_vocabulary(fragments.triplets(c), c, 5)


@query("ch7_path_print", f"""with recursive {paths_sql(8)}, bits as (select distinct row_index, ('0x' || substr(md5(fragment), 1, 8))::bigint % 2048 as bit from texts)
 select a.row_index, count(b.bit) as n_on, coalesce(sum(b.bit), 0)::bigint as bit_sum from (select distinct row_index from atoms) a left join bits b using (row_index) group by 1""")
def path_print(spark, sf):
    c = classes(spark, sf)
    bits = fragments.path_bits(c)
    total = F.aggregate("bits", F.lit(0).cast("long"), lambda a, b: a + b)
    return c.members.join(bits, "_class").select("row_index", F.size("bits").cast("long").alias("n_on"), total.alias("bit_sum"))


#: lineitem as pattern hits: an order is a compound, a line one pattern that occurs in it
HITS_SQL = """
 hits as (select l_orderkey as compound, case when l_linenumber % 2 = 0 then 'heterocycle' else 'functional_group' end as category, 'k' || l_partkey as key,
   l_returnflag || l_quantity::int as name, case when l_tax > 0 then 'S' || l_suppkey else '' end as smarts, [l_suppkey % 2, 2 + l_suppkey % 2] as atoms,
   (1 + l_quantity % 3)::int as match_count, case when l_returnflag <> 'R' then l_linestatus end as family from lineitem),
 ranked as (select *, row_number() over (partition by compound, category, atoms order by category <> 'heterocycle', family is null, -len(atoms), -match_count, lower(name),
   lower(key), name, key, smarts) as r from hits),
 motifs as (select * exclude r, row_number() over (partition by compound order by category <> 'heterocycle', family is null, -len(atoms), -match_count, lower(name),
   lower(key), name, key, smarts) as place from ranked where r = 1)"""


def pattern_hits(spark, sf):
    low = F.col("l_suppkey") % 2
    return inputs.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("compound"), F.when(F.col("l_linenumber") % 2 == 0, "heterocycle").otherwise("functional_group").alias("category"),
        F.concat(F.lit("k"), "l_partkey").alias("key"), F.concat("l_returnflag", F.col("l_quantity").cast("int")).alias("name"),
        F.when(F.col("l_tax") > 0, F.concat(F.lit("S"), "l_suppkey")).otherwise("").alias("smarts"),
        F.array(low, low + 2).cast("array<int>").alias("atoms"), (1 + F.col("l_quantity") % 3).cast("int").alias("match_count"),
        F.when(F.col("l_returnflag") != "R", F.col("l_linestatus")).alias("family"), F.lit(None).cast("string").alias("superclass"),
        F.lit("registry").alias("source"))


@query("set3_distinct_motifs", f"""with {HITS_SQL} select compound, place, key, category, name, smarts, coalesce(family, '') as family, '' as superclass, 'registry' as source,
   match_count::double as match_count, len(atoms)::double as matched_atom_count, array_to_string(atoms, ', ') as matched_atoms from motifs""")
def distinct_motifs(spark, sf):
    return details.motif_table(details.distinct_motifs(pattern_hits(spark, sf), "compound"), "compound")


@query("ad3_search_profiles", f"""with {HITS_SQL},
 f as (select compound, count(*) as n, string_agg(name, '|' order by lower(category), lower(name), key, smarts) as names,
   string_agg(case when smarts <> '' then smarts else 'C' || match_count end, '|' order by lower(category), lower(name), key, smarts) as pats
   from (select compound, category, key, name, smarts, min(match_count) as match_count from hits group by all) group by 1),
 m as (select compound, string_agg(name, '|' order by place) as names, string_agg(nullif(smarts, ''), '|' order by place) as pats from motifs where category = 'heterocycle' group by 1)
 select o_orderkey as compound, o_orderstatus as smiles, o_orderpriority as murcko, '' as generic, 0.35::double as similarity_threshold, coalesce(f.n, 0)::double as n_fragments,
   coalesce(f.n, 0) / 250.0::double as coverage, coalesce(f.names, '') as fragment_names, coalesce(f.pats, '') as fragment_smarts, coalesce(m.names, '') as motif_names,
   coalesce(m.pats, '') as motif_smarts, 'or' as motif_logic, 'hybrid' as search_mode from orders left join f on f.compound = o_orderkey left join m on m.compound = o_orderkey""")
def search_profiles(spark, sf):
    hits = pattern_hits(spark, sf)
    found = hits.groupBy("compound", "category", "key", "name", "smarts").agg(F.concat(F.lit("C"), F.min("match_count")).alias("smiles"))
    chosen = details.distinct_motifs(hits, "compound").where(F.col("category") == details.HETEROCYCLE)
    compounds = inputs.table(spark, sf, "orders").select(F.col("o_orderkey").alias("compound"), F.col("o_orderstatus").alias("smiles"),
                                                         F.col("o_orderpriority").alias("murcko"), F.lit("").alias("generic"))
    return details.search_profiles(compounds, "compound", found, chosen, 250)


@query("src23_pattern_table", """select 'k' || p_partkey as key, 'functional_group' as category, trim(p_name) as name, p_type as smarts, p_brand as source from part where p_size % 3 <> 0 and p_size % 4 <> 0
 union all select lower(replace(trim(p_name), ' ', '_')), 'functional_group', trim(p_name), p_type, p_brand from part where p_size % 3 = 0 and p_size % 4 <> 0""")
def pattern_table(spark, sf):
    size = F.col("p_size")
    supplied = inputs.table(spark, sf, "part").select(
        F.when(size % 3 != 0, F.concat(F.lit("k"), "p_partkey")).alias("pattern_id"), F.concat(F.lit(" "), "p_name").alias("name"),
        F.when(size % 4 != 0, F.col("p_type")).alias("smarts"), F.lit("Functional_Groups").alias("category"), F.col("p_brand").alias("source"))
    return details.functional_patterns(supplied)
