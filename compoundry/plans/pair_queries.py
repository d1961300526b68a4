"""Similarity, cliff, diversity and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from compoundry.operators import diversity, similarity, splits
from compoundry.plans.inputs import spread, table
from compoundry.plans.registry import query

BITS_SQL = """
 b as (select vec_id, label, list_transform(embedding, lambda x: (x > 0)::int) as f, list_sum(list_transform(embedding, lambda x: (x > 0)::int)) as n from embeddings),
 s as (select x.vec_id as i, y.vec_id as j, list_dot_product(x.f::float[], y.f::float[])::int as c, x.n as nx, y.n as ny from b x join b y on x.vec_id <> y.vec_id),
 t as (select *, c / (nx + ny - c)::double as sim from s)
"""


def fingerprints(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", similarity.words_from_values(F.col("embedding")).alias("fp"))


@query("jn1_topk_tanimoto", f"""with {BITS_SQL}, w as (select i, j, sim from t where sim >= 0.4 union all select vec_id, vec_id, 1.0 from b where n > 0),
 r as (select i, j, sim, row_number() over (partition by i order by sim desc, j) as rank from w)
 select i as query_index, j as reference_index, round(sim, 4) as similarity, rank from r where rank <= 5""")
def topk_tanimoto(spark, sf):
    f = fingerprints(spark, sf).withColumn("text", F.concat(F.lit("S"), F.col("vec_id").cast("string")))
    return similarity.top_hits(f, f, "fp", "vec_id", "vec_id", "text", 5, 0.4, include_self=True)


@query("jn1_self_topk", f"""with {BITS_SQL}, r as (select i, j, sim, row_number() over (partition by i order by sim desc, j) as rank from t
   where sim >= 0.45) select i as query_index, j as reference_index, round(sim, 4) as similarity, rank from r where rank <= 3""")
def self_topk(spark, sf):
    f = fingerprints(spark, sf).withColumn("text", F.concat(F.lit("S"), F.col("vec_id").cast("string")))
    return similarity.top_hits(f, f, "fp", "vec_id", "vec_id", "text", 3, 0.45)


def rounded(x):
    """``round(x, 6)`` of a similarity without a decimal number per row: only values next to a tie need one."""
    scaled = x * 1e6 + 0.5
    whole = F.floor(scaled)
    return F.when(F.abs(scaled - F.rint(scaled)) < 1e-4, F.round(x, 6)).otherwise(whole / 1e6)


@query("jn2_similarity_pairs", f"with {BITS_SQL} select i as id_a, j as id_b, round(sim, 6) as similarity from t where i < j and sim >= 0.5")
def similarity_pairs(spark, sf):
    return similarity.row_pairs(fingerprints(spark, sf), "fp", "vec_id", 0.5).withColumn("similarity", rounded(F.col("similarity")))


CLASS_SQL = f"""{BITS_SQL}, cls as (select f, min(vec_id) as class_id, count(*) as n_rows from b group by f),
 m as (select vec_id, class_id, n_rows from b join cls using (f)), lk as (select i, j, sim from t where sim >= 0.5)"""


@query("jn2_class_links", f"with {CLASS_SQL} select i as class_a, j as class_b, round(sim, 6) as similarity from lk where i < j and i in (select class_id from cls) and j in (select class_id from cls)")
def class_links(spark, sf):
    links, _ = similarity.class_links(fingerprints(spark, sf), "fp", "vec_id", 0.5)
    return links.withColumn("similarity", F.round("similarity", 6))


@query("jn2_class_members", f"""with {CLASS_SQL}, o as (select i, count(*) as n from lk join m a on a.vec_id = i join m c on c.vec_id = j where a.class_id <> c.class_id group by i)
   select vec_id, class_id, n_rows, coalesce(n, 0) as n_links from m left join o on i = vec_id""")
def class_members(spark, sf):
    return similarity.class_links(fingerprints(spark, sf), "fp", "vec_id", 0.5)[1]


CLIFF_SQL = f"""{BITS_SQL}, a as (select vec_id, 1 + (vec_id * 7919) % 1000 as act from b),
 p as (select t.i, t.j, t.sim, x.act as ax, y.act as ay, greatest(x.act, y.act) / least(x.act, y.act)::double as ratio from t
   join a x on x.vec_id = t.i join a y on y.vec_id = t.j where t.i < t.j and sim >= 0.5),
 q as (select *, round(sim * log10(ratio), 4) as score from p where ratio >= 10)"""


def cliffs(spark, sf, n):
    f = fingerprints(spark, sf).withColumn("act", 1 + (F.col("vec_id") * 7919) % 1000)
    return similarity.activity_cliffs(f, "fp", "vec_id", "act", 0.5, 10.0, False, n)


@query("jn2_activity_cliffs", f"""with {CLIFF_SQL} select i as index_a, j as index_b, round(sim, 4) as similarity, round(ratio, 4) as activity_ratio,
   score as cliff_score, case when ax < ay then 'a' else 'b' end as higher_active from q order by score desc, round(sim, 4) desc, i, j limit 100""")
def activity_cliffs(spark, sf):
    return cliffs(spark, sf, 100).drop("activity_a", "activity_b")


@query("jn8_cliff_compounds", f"""with {CLIFF_SQL}, top as (select i, j from q order by score desc, round(sim, 4) desc, i, j limit 50)
   select distinct vec_id, label from b where vec_id in (select i from top union select j from top)""")
def cliff_compounds(spark, sf):
    ids = similarity.pair_members(cliffs(spark, sf, 50)).withColumnRenamed("id", "vec_id")
    return fingerprints(spark, sf).select("vec_id", "label").join(ids, "vec_id", "left_semi")


@query("jn9_unmatched_rows", f"with {BITS_SQL} select vec_id, label from b where vec_id not in (select i from t where sim >= 0.5)")
def unmatched_rows(spark, sf):
    f = fingerprints(spark, sf)
    return similarity.unmatched_rows(f, "fp", "vec_id", 0.5).select("vec_id", "label")


@query("ad14_pair_compounds", f"""with {CLIFF_SQL}, top as (select * from q order by score desc, round(sim, 4) desc, i, j limit 60)
   select score as cliff_score, 'a' as pair_role, i as compound, ax::double as activity from top union all select score, 'b', j, ay from top""")
def pair_compounds(spark, sf):
    return similarity.pair_rows(cliffs(spark, sf, 60), ["cliff_score"], {"compound": ("index_a", "index_b"), "activity": ("activity_a", "activity_b")})


@query("jn5_similar_compounds", f"""with {BITS_SQL} select j as vec_id, round(sim, 6) as similarity, c as shared_bits from t where i = (select min(vec_id) from b) order by sim desc, j limit 20""")
def similar_compounds(spark, sf):
    f = fingerprints(spark, sf)
    q = f.orderBy("vec_id").first()
    out = similarity.query_scan(f.where(F.col("vec_id") != q["vec_id"]), q["fp"], "fp", "vec_id", 20)
    return out.withColumn("similarity", F.round("similarity", 6))


@query("jn4_hybrid_search", f"""with {BITS_SQL}, q as (select *, (select label from b order by vec_id limit 1) ql from t where i = (select min(vec_id) from b)),
 h as (select j, round(sim, 4) s, c, c / nx::double as ov, case when label = ql then 1.0 when label % 2 = ql % 2 then 0.7 else 0 end sc from q join b on vec_id = j)
 select j as vec_id, round(0.5 * s + 0.3 * sc + 0.2 * ov, 4) as hybrid_score, s as similarity, round(ov, 4) as fragment_overlap, c as shared_fragments
 from h where s >= 0.3 order by 2 desc, s desc, c desc, j limit 40""")
def hybrid_search(spark, sf):
    f = fingerprints(spark, sf).withColumns({"scaffold": F.col("label").cast("string"), "generic": (F.col("label") % 2).cast("string")})
    q = f.orderBy("vec_id").first()
    out = similarity.hybrid_search(f.where(F.col("vec_id") != q["vec_id"]), q["fp"], "fp", "vec_id", "scaffold", q["scaffold"], "generic", q["generic"],
                                   min_similarity=0.3, top_k=40)
    return out.select("vec_id", "hybrid_score", "similarity", "fragment_overlap", "shared_fragments")


@query("sc29_tanimoto_sets", """
 with d as (select p_partkey, list_sort(list_distinct([p_size % 7, p_size % 11, p_partkey % 13])) a, list_sort(list_distinct([p_size % 5, p_partkey % 7, p_size % 13])) b from part)
 select p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) as similarity, len(list_intersect(a, b)) as shared from d""")
def tanimoto_sets(spark, sf):
    s, k = F.col("p_size"), F.col("p_partkey")
    p = table(spark, sf, "part").select("p_partkey", F.array_distinct(F.array(s % 7, s % 11, k % 13)).alias("a"), F.array_distinct(F.array(s % 5, k % 7, s % 13)).alias("b"))
    return p.select("p_partkey", F.round(similarity.tanimoto_sets(F.col("a"), F.col("b")), 6).alias("similarity"),
                    F.size(similarity.shared_bits(F.col("a"), F.col("b"))).alias("shared"))


@query("jn12_distance_matrix", """
 select x.s_suppkey as i, y.n_nationkey as j, round(sqrt((x.s_nationkey - y.n_nationkey) ** 2 + (x.s_acctbal / 1000 - y.n_regionkey) ** 2), 6) as distance,
   round(abs(x.s_nationkey - y.n_nationkey) + abs(x.s_acctbal / 1000 - y.n_regionkey), 6) as cityblock from supplier x join nation y on true""")
def distance_matrix(spark, sf):
    from compoundry.operators.distances import distance_pairs

    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.array(F.col("s_nationkey").cast("double"), F.col("s_acctbal") / 1000).alias("x"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.array(F.col("n_nationkey").cast("double"), F.col("n_regionkey").cast("double")).alias("x"))
    out = distance_pairs(s, n, "id", "x", ("euclidean", "cityblock"))
    return out.select("i", "j", F.round("euclidean", 6).alias("distance"), F.round("cityblock", 6).alias("cityblock"))


def supplier_points(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.array(F.col("s_nationkey").cast("double"), F.col("s_acctbal") / 1000).alias("x"))


NEAR_SQL = """d as (select x.s_suppkey as i, y.s_suppkey as j, sqrt((x.s_nationkey - y.s_nationkey) ** 2 + (x.s_acctbal / 1000 - y.s_acctbal / 1000) ** 2) as e,
   abs(x.s_nationkey - y.s_nationkey) + abs(x.s_acctbal / 1000 - y.s_acctbal / 1000) as c from supplier x join supplier y on x.s_suppkey <> y.s_suppkey)"""


@query("jn12_within_threshold", f"""with {NEAR_SQL} select 'euclidean' as metric, i, j, round(e, 6) as distance from d where i < j and e <= 1.25
   union all select 'cityblock', i, j, round(c, 6) from d where i < j and c <= 1.25""")
def within_threshold(spark, sf):
    from compoundry.operators.distances import within

    s = supplier_points(spark, sf)
    parts = [within(s, None, "id", "x", 1.25, m).select(F.lit(m).alias("metric"), "i", "j", F.round("distance", 6).alias("distance")) for m in ("euclidean", "cityblock")]
    return parts[0].unionAll(parts[1])


@query("jn12_nearest_within", f"""with {NEAR_SQL}, r as (select i, j, e, row_number() over (partition by i order by e, j) as n from d where e <= 1.25)
   select i, j, round(e, 6) as distance from r where n <= 3""")
def nearest_within(spark, sf):
    from compoundry.operators.distances import within

    out = within(supplier_points(spark, sf), None, "id", "x", 1.25, nearest=3)
    return out.select("i", "j", F.round("distance", 6).alias("distance"))


@query("jn12_cosine_within", """select x.vec_id as i, y.vec_id as j, round(1 - list_cosine_similarity(x.embedding::double[], y.embedding::double[]), 6) as distance
   from embeddings x join embeddings y on x.vec_id < y.vec_id where 1 - list_cosine_similarity(x.embedding::double[], y.embedding::double[]) <= 0.7""")
def cosine_within(spark, sf):
    from compoundry.operators.distances import within

    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    return within(e, None, "id", "x", 0.7, "cosine").withColumn("distance", F.round("distance", 6))


@query("srt7_sphere_exclusion")
def sphere_exclusion(spark, sf):
    return diversity.sphere_exclusion(fingerprints(spark, sf), "fp", "vec_id", 0.55)


@query("srt8_butina_clusters")
def butina_clusters(spark, sf):
    return diversity.butina_selection(diversity.butina_clusters(fingerprints(spark, sf), "fp", "vec_id", 0.55), 10)


#: Farthest row by row: the distance of every row to the picks, and the next pick, step by step.
def maxmin_sql(n: int) -> str:
    return f"""with recursive {BITS_SQL}, lo as (select min(vec_id) as m from b),
 st as (select 1 as step, vec_id as id, case when vec_id = m then 0.0 else 1 - sim end as d, m as pick from b cross join lo left join t on t.i = vec_id and t.j = m
   union all select step + 1, id, case when id = nxt then 0.0 else least(d, 1 - sim) end, nxt
   from (select step, id, d, first_value(id) over (order by d desc, id) as nxt from st) s left join t on t.i = s.id and t.j = s.nxt where step < {n}),
 picks as (select distinct pick, step from st)"""


@query("srt6_maxmin_pick", maxmin_sql(12) + " select pick as vec_id, step as rank from picks")
def maxmin_pick(spark, sf):
    return diversity.maxmin_pick(fingerprints(spark, sf), "fp", "vec_id", 12)


@query("win6_selection_rank", maxmin_sql(6) + " select vec_id, label, step as selection_rank, step is not null as selected from b left join picks on pick = vec_id")
def selection_rank(spark, sf):
    f = fingerprints(spark, sf)
    return diversity.with_selection(f.select("vec_id", "label"), diversity.maxmin_pick(f, "fp", "vec_id", 6), "vec_id")


@query("agg18_diversity_metrics", f"""with {BITS_SQL}, nn as (select i, 1 - max(sim) as d from t group by i),
 o as (select 1 - sim as d, row_number() over (partition by i order by j) as p from t)
 select (select count(*) from b) as n_compounds, round((select avg(d) from nn), 4) as mean_nn_distance, round((select avg(d) from o where p <= 20), 4) as mean_pairwise_dist,
   (select count(*) from nn where d > 0.5) as n_singletons, round((select avg(d) from o where p <= 20), 4) as diversity_score""")
def diversity_metrics(spark, sf):
    return diversity.diversity_metrics(fingerprints(spark, sf), "fp", "vec_id")


@query("win5_rank_bins", "select o_orderkey, floor((row_number() over (order by o_totalprice, o_orderkey) - 1) * 5 / count(*) over ())::int as bin from orders")
def rank_bins(spark, sf):
    return splits.rank_bins(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey").select("o_orderkey", "bin")


@query("srt2_random_split", """select split, n from (select count(*) c, round_even(count(*) * 0.2, 0)::bigint t, round_even(count(*) * 0.1, 0)::bigint v from orders),
   lateral (select 'test' as split, t as n union all select 'validation', v union all select 'train', c - t - v)""")
def random_split(spark, sf):
    s = splits.split_dataset(table(spark, sf, "orders").select("o_orderkey"), "random", "o_orderkey")
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("srt3_stratified_split", """select split, n from (select count(*) c, ceil(count(*) * 0.2)::bigint t, ceil(count(*) * 0.1)::bigint v from orders),
   lateral (select 'test' as split, t as n union all select 'validation', v union all select 'train', c - t - v)""")
def stratified_split(spark, sf):
    s = splits.split_dataset(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "stratified", "o_orderkey", target="o_orderpriority")
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("srt4_group_split")
def group_split(spark, sf):
    return splits.split_summary(splits.group_split(table(spark, sf, "part").select("p_partkey", "p_name"), "p_name"))


@query("srt5_groups_stay_whole", """select sum(n_groups)::bigint as n_groups, 0::bigint as n_shared from (select count(distinct o_custkey) n_groups from orders)""")
def groups_stay_whole(spark, sf):
    s = splits.split_dataset(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "scaffold", "o_orderkey", group="o_custkey")
    return splits.groups_by_split(s, "o_custkey").agg(F.sum("n_groups").alias("n_groups"), F.sum("n_shared").alias("n_shared"))
