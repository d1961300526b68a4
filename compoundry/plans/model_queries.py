"""Validation, applicability-domain and descriptor-screening queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from compoundry.operators import descriptors, domain, validation
from compoundry.operators.domain import DomainConfig
from compoundry.plans import inputs
from compoundry.plans.inputs import spread, table
from compoundry.plans.registry import query


def rounded(df, digits=6, skip=()):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


PRED_SQL = """
 p as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / 1000 as y, (l_quantity * 1500 + 250) / 1000 as f,
   l_returnflag as s, l_linestatus = 'F' as inside, l_partkey % 10 = 0 as low from lineitem)
"""
METRICS_SQL = """count(*) as n, round(1 - sum((y - f) ** 2) / (var_pop(y) * count(*)), 6) as r2, round(sqrt(avg((y - f) ** 2)), 6) as rmse,
   round(avg(abs(y - f)), 6) as mae, round(avg(y - f), 6) as bias, round(stddev_samp(y - f), 6) as residual_sd,
   round(max(abs(y - f)), 6) as max_abs_residual, round(corr(y, f), 6) as pearson_r,
   round(2 * covar_pop(y, f) / (var_pop(y) + var_pop(f) + (avg(y) - avg(f)) ** 2), 6) as ccc,
   round(regr_slope(y, f), 6) as slope, round(regr_intercept(y, f), 6) as intercept,
   round(median(abs(y - f)), 6) as median_abs_error, round(quantile_cont(abs(y - f), 0.95), 6) as p95_abs_residual"""


def predictions(spark, sf):
    li = spread(table(spark, sf, "lineitem"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_extendedprice") / 1000).alias("actual_value"),
                     ((F.col("l_quantity") * 1500 + 250) / 1000).alias("predicted_pActivity"), F.col("l_returnflag").alias("dataset"),
                     F.when(F.col("l_linestatus") == "F", "inside").otherwise("no").alias("ad_in_domain"),
                     F.when(F.col("l_partkey") % 10 == 0, " Low").otherwise("high").alias("ad_confidence"))


@query("agg12_regression_metrics", f"""with {PRED_SQL} select 'all' as "group", {METRICS_SQL} from p union all select s, {METRICS_SQL} from p group by s""")
def regression_metrics(spark, sf):
    return rounded(validation.metrics_by_split(validation.canonical_predictions(predictions(spark, sf))))


DIAG_SQL = f"""{PRED_SQL}, st as (select avg(y - f) m, stddev_samp(y - f) sd from p),
 d as (select p.*, y - f as r, (y - f - m) / sd as z, greatest(1.0, 2 * sd) as lim from p, st),
 e as (select *, abs(r) > lim as big, abs(z) > 3 as wild from d),
 g as (select *, big::int + wild::int + (not inside)::int + low::int as hits, concat_ws('; ', case when big then 'large residual' end,
   case when wild then 'residual z-outlier' end, case when not inside then 'outside applicability domain' end,
   case when low then 'low AD confidence' end) as why from e)"""


@query("win4_residual_diagnostics", f"""with {DIAG_SQL} select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(r, 6) as residual, round(z, 6) as residual_z,
   case when hits >= 2 then 'critical' when hits = 1 then 'warning' else 'ok' end as validation_severity,
   case when hits > 0 then why else 'ok' end as review_reason from g""")
def residual_diagnostics(spark, sf):
    d = validation.residual_diagnostics(predictions(spark, sf))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("residual", 6).alias("residual"),
                    F.round("residual_z", 6).alias("residual_z"), "validation_severity", "review_reason")


@query("agg17_validation_summary", f"""with {DIAG_SQL} select count(*) as n_rows, count(*) filter (hits > 0) as n_outliers, count(*) filter (big) as n_large_residuals,
   count(*) filter (wild) as n_z_outliers, count(*) filter (not inside) as n_outside_ad, count(*) filter (low) as n_low_ad_confidence,
   count(*) filter (hits = 1) as n_warning, count(*) filter (hits >= 2) as n_critical, round(avg(inside::int), 6) as ad_coverage,
   round(max(lim), 6) as residual_threshold from g""")
def validation_summary(spark, sf):
    return rounded(validation.validation_summary(validation.residual_diagnostics(predictions(spark, sf))))


@query("sc27_residual_levels", f"""with {PRED_SQL}, s as (select avg(y - f) m, stddev_pop(y - f) d from p) select round(m, 6) as mean, round(d, 6) as std,
   round(m - d, 6) as minus_1std, round(m + d, 6) as plus_1std, round(m - 2 * d, 6) as minus_2std, round(m + 2 * d, 6) as plus_2std from s""")
def residual_levels(spark, sf):
    p = validation.canonical_predictions(predictions(spark, sf)).withColumn("residual", F.col("observed") - F.col("predicted"))
    return rounded(validation.residual_levels(p, "residual"))


@query("ml28_inlier_mask", f"""with {PRED_SQL}, s as (select avg(y - f) m, stddev_pop(y - f) d from p) select inlier, count(*) as n, round(sum(y - f), 4) as total
   from (select (abs(y - f - m) <= 2 * d)::int as inlier, y, f from p, s) group by 1""")
def inlier_mask(spark, sf):
    p = validation.canonical_predictions(predictions(spark, sf))
    m = validation.inlier_mask(p, "observed", "predicted")
    return m.groupBy(F.col("inlier").cast("int").alias("inlier")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("residual"), 4).alias("total"))


@query("flt21_rectangle_selection", f"with {PRED_SQL} select l_orderkey, l_linenumber, l_partkey, l_suppkey from p where f between 20 and 40 and y between 10 and 30.5")
def rectangle(spark, sf):
    p = validation.canonical_predictions(predictions(spark, sf))
    return p.where(validation.inside_rectangle(F.col("predicted"), F.col("observed"), 40, 30.5, 20, 10)).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("flt21_lasso_selection", f"""with {PRED_SQL} select l_orderkey, l_linenumber, l_partkey, l_suppkey from p
   where f > 10.1 and y > 5.3 and (f - 10.1) / 40.0 + (y - 5.3) / 30.0 < 1""")
def lasso(spark, sf):
    p = validation.canonical_predictions(predictions(spark, sf))
    return p.where(validation.inside_polygon(F.col("predicted"), F.col("observed"), [(10.1, 5.3), (50.1, 5.3), (10.1, 35.3)])).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("ml16_external_validation", f"""with {PRED_SQL}, a as (select avg(y) m, var_pop(y) v from p where s = 'A'),
 t as (select count(*) n, avg(y) my, avg(f) mf, var_pop(y) vy, var_pop(f) vf, covar_pop(y, f) c, sum((y - f) ** 2) press, avg(abs(y - f)) mae,
   sum(y * f) / sum(f * f) k, sum(y * f) / sum(y * y) kp from p where s <> 'A'),
 o as (select sum((y - k * f) ** 2) e1, sum((f - kp * y) ** 2) e2 from p, t where s <> 'A'),
 r as (select *, 1 - press / (n * vy) r2, 1 - e1 / (n * vy) r0, 1 - e2 / (n * vf) r0p from t, o)
 select round(r2, 6) r2, round(sqrt(press / n), 6) rmse, round(mae, 6) mae, round(press / n, 6) mse,
   round(2 * c / (vy + vf + (my - mf) ** 2), 6) ccc, round(1 - press / (n * vy + n * (my - m) ** 2), 6) q2f1, round(r2, 6) q2f2,
   round(1 - (press / n) / v, 6) q2f3, round(r0, 6) ext_r0_2, round(r0p, 6) ext_r0p_2,
   round(r2 * (1 - sqrt(greatest(r2 - r0, 0))), 6) ext_rm2, round(r2 * (1 - sqrt(greatest(r2 - r0p, 0))), 6) ext_rm2_prime,
   round((r2 * (1 - sqrt(greatest(r2 - r0, 0))) + r2 * (1 - sqrt(greatest(r2 - r0p, 0)))) / 2, 6) ext_rm2_avg,
   round(abs(r2 * (1 - sqrt(greatest(r2 - r0, 0))) - r2 * (1 - sqrt(greatest(r2 - r0p, 0)))), 6) ext_rm2_delta,
   round(k, 6) ext_k, round(kp, 6) ext_k_prime from r, a""")
def external_validation(spark, sf):
    p = validation.canonical_predictions(predictions(spark, sf))
    return rounded(validation.external_validation(p.where(F.col("split") == "A"), p.where(F.col("split") != "A")))


AD_SQL = """
 r as (select l_quantity as a, l_extendedprice / 1000 as b from lineitem where l_returnflag = 'A'),
 m as (select count(*) n, avg(a) ma, avg(b) mb, var_pop(a) va, var_pop(b) vb, covar_pop(a, b) c from r),
 q as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity as a, l_extendedprice / 1000 as b from lineitem where l_returnflag <> 'A'),
 d as (select q.*, n, 9.0 / n as h_star, (vb * (a - ma) ** 2 - 2 * c * (a - ma) * (b - mb) + va * (b - mb) ** 2) / (va * vb - c * c) as q2 from q, m),
 s as (select *, 1.0 / n + q2 / n as lev, q2 * (n - 1) / n as d2 from d),
 f as (select *, lev <= h_star as in_w, d2 <= 5.991464547107979 as in_m, greatest(lev / h_star, d2 / 5.991464547107979) as margin from s)
"""


def ad_fit(spark, sf, cfg):
    li = spread(table(spark, sf, "lineitem")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("MW"),
        (F.col("l_extendedprice") / 1000).alias("LogP"), "l_returnflag")
    ref = li.where(F.col("l_returnflag") == "A")
    return domain.fit_domain(ref, ["MW", "LogP"], cfg, fill=False), li.where(F.col("l_returnflag") != "A")


@query("ml19_applicability_domain", f"""with {AD_SQL} select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(lev, 8) as leverage,
   round(d2, 6) as maha_d2, in_w::int as in_ad_williams, in_m::int as in_ad_maha, (in_w and in_m)::int as in_ad from f""")
def applicability_domain(spark, sf):
    cfg = DomainConfig(use_mahalanobis=True)
    fit, q = ad_fit(spark, sf, cfg)
    s = domain.score_domain(fit, q)
    i = lambda c: F.col(c).cast("int").alias(c)
    return s.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("leverage", 8).alias("leverage"),
                    F.round("maha_d2", 6).alias("maha_d2"), i("in_ad_williams"), i("in_ad_maha"), i("in_ad"))


@query("ml20_domain_explanation", f"""with {AD_SQL} select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(margin, 6) as "AD_margin",
   (not in_w)::int + (not in_m)::int as "AD_failed_methods",
   case when not (in_w and in_m) then 'low' when margin >= 0.85 then 'medium' else 'high' end as "AD_confidence",
   case when not (in_w and in_m) then concat_ws('; ', case when not in_w then 'high leverage' end, case when not in_m then 'high Mahalanobis distance' end)
     when margin >= 0.85 then 'inside AD but close to boundary' else 'inside AD' end as "AD_reason" from f""")
def domain_explanation(spark, sf):
    cfg = DomainConfig(use_mahalanobis=True)
    fit, q = ad_fit(spark, sf, cfg)
    e = domain.explain_domain(domain.score_domain(fit, q), cfg)
    return e.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("AD_margin", 6).alias("AD_margin"),
                    "AD_failed_methods", "AD_confidence", "AD_reason")


@query("ml32_domain_summary", f"""with {AD_SQL}, o as (select count(*)::double query_rows, (count(*) filter (in_w or in_m))::double query_in_domain,
   (count(*) filter (not (in_w or in_m)))::double query_out_of_domain, max(n)::double reference_rows, 2.0::double feature_count,
   round(max(h_star), 8)::double h_star, round(5.991464547107979, 8)::double mahalanobis_threshold from f)
 select metric, value from (unpivot o on columns(*) into name metric value value)""")
def domain_summary(spark, sf):
    cfg = DomainConfig(use_mahalanobis=True, combine="or")
    fit, q = ad_fit(spark, sf, cfg)
    return domain.domain_summary(fit, domain.score_domain(fit, q)).select("metric", F.round("value", 8).alias("value"))


@query("ml18_williams", """
 with d as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity x, l_extendedprice / 1000 y from lineitem),
 m as (select count(*) n, avg(x) mx, var_pop(x) vx, regr_slope(y, x) b, regr_intercept(y, x) a from d),
 e as (select d.*, n, y - (a + b * x) as r, 1.0 / n + (x - mx) ** 2 / (n * vx) as h from d, m),
 s as (select sqrt(sum(r * r) / (max(n) - 2)) sd from e)
 select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(h, 8) as leverage, round(r / (sd * sqrt(1 - h)), 6) as std_resid,
   (h <= 6.0 / n and abs(r / (sd * sqrt(1 - h))) <= 3)::int as in_ad from e, s""")
def williams(spark, sf):
    from compoundry.functions import linalg

    d = spread(table(spark, sf, "lineitem")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    m = linalg.moments(d, ["x", "y"])
    slope = m.cross[0, 1] / m.cross[0, 0]
    fit = domain.fit_domain(d, ["x"], fill=False)
    out = domain.predict_with_domain({"x": slope}, m.mean[1] - slope * m.mean[0], fit, d, "y")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("leverage", 8).alias("leverage"),
                      F.round("std_resid", 6).alias("std_resid"), F.col("in_ad").cast("int").alias("in_ad"))


@query("jn10_knn_distance", """
 with z as (select p_partkey, (p_size - avg(p_size) over ()) / stddev_pop(p_size) over () as a,
     (p_retailprice - avg(p_retailprice) over ()) / stddev_pop(p_retailprice) over () as b from part),
 d as (select x.p_partkey, sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2) as d, row_number() over (partition by x.p_partkey order by
     (x.a - y.a) ** 2 + (x.b - y.b) ** 2) as r from z x join z y on true)
 select p_partkey, round(avg(d), 6) as knn_dist from d where r between 2 and 6 group by p_partkey""")
def knn_distance(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    fit = domain.fit_domain(p, ["p_size", "p_retailprice"], fill=False)
    return domain.knn_distance(fit, p, "p_partkey").withColumn("knn_dist", F.round("knn_dist", 6))


@query("ml19_knn_domain", """
 with z as (select s_suppkey, (s_nationkey - avg(s_nationkey) over ()) / stddev_pop(s_nationkey) over () as a,
     (s_acctbal - avg(s_acctbal) over ()) / stddev_pop(s_acctbal) over () as b from supplier),
 d as (select x.s_suppkey, sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2) as d, row_number() over (partition by x.s_suppkey order by
     (x.a - y.a) ** 2 + (x.b - y.b) ** 2) as r from z x join z y on true),
 k as (select s_suppkey, avg(d) as k from d where r between 2 and 6 group by 1)
 select s_suppkey, round(k, 6) as knn_dist, (k <= (select quantile_cont(k, 0.95) from k))::int as in_ad_knn from k""")
def knn_domain(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("n"), "s_acctbal")
    cfg = DomainConfig(use_williams=False, use_knn=True)
    fit = domain.fit_domain(s, ["n", "s_acctbal"], cfg, ident="s_suppkey")
    out = domain.score_domain(fit, s, "s_suppkey")
    return out.select("s_suppkey", F.round("knn_dist", 6).alias("knn_dist"), F.col("in_ad_knn").cast("int").alias("in_ad_knn"))


NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "MolLogP", "sparse", "constant"]
WIDE_SQL = """
 w as (select l_quantity, l_extendedprice, l_discount, l_tax, l_quantity * 2 + 1 as "MolLogP",
   case when l_orderkey % 3 = 0 then null else l_tax end as sparse, 1.0::double as constant from lineitem)
"""


def wide(spark, sf):
    li = spread(table(spark, sf, "lineitem"))
    return li.select("l_quantity", "l_extendedprice", "l_discount", "l_tax", (F.col("l_quantity") * 2 + 1).alias("MolLogP"),
                     F.when(F.col("l_orderkey") % 3 != 0, F.col("l_tax")).alias("sparse"), F.lit(1.0).alias("constant"))


def column_sql(expr, cols=NUMERIC):
    return " union all ".join(expr.format(c=f'"{c}"', n=c) for c in cols)


@query("ml6_descriptor_summary", f"with {WIDE_SQL}" + column_sql("""
 select '{n}' as descriptor, count(*) as n, count(*) - count({c}) as missing, round((count(*) - count({c})) / count(*), 6) as missing_fraction,
   count(distinct {c}) as n_unique, round(avg({c}), 6) as mean, round(stddev_pop({c}), 6) as std, round(median({c}), 6) as median,
   case when (count(*) - count({c})) / count(*) > 0.2 then 'high_missing' when count(distinct {c}) <= 1 then 'low_variance' else 'ok' end as status from w"""))
def descriptor_summary(spark, sf):
    s = descriptors.explore_descriptors(wide(spark, sf), NUMERIC)
    return rounded(s.select("descriptor", "n", "missing", "missing_fraction", "n_unique", "mean", "std", "median", "status"))


@query("agg13_category_summary", f"with {WIDE_SQL}, f as (" + column_sql("""
 select '{n}' as d, (count(*) - count({c})) / count(*) as m, count(distinct {c}) as u from w""") + """)
 select case d when 'MolLogP' then 'physicochemical' else 'other/unknown' end as category, count(*) as descriptors,
   count(*) filter (m <= 0.2 and u > 1) as ok, count(*) filter (m > 0.2) as high_missing, count(*) filter (u <= 1) as low_variance,
   round(avg(m), 6) as mean_missing_fraction from f group by 1""")
def category_summary(spark, sf):
    return rounded(descriptors.category_summary(descriptors.explore_descriptors(wide(spark, sf), NUMERIC)))


_PAIRS = [(a, b) for i, a in enumerate(NUMERIC) for b in NUMERIC[i + 1:]]


@query("ml6_correlation_pairs", f"with {WIDE_SQL}, c as (" + " union all ".join(
    f"""select '{a}' as descriptor_a, '{b}' as descriptor_b, case when stddev_pop("{a}") filter ("{b}" is not null) > 0 and stddev_pop("{b}") > 0
      then corr("{a}", "{b}") end as r from w""" for a, b in _PAIRS) + """)
 select descriptor_a, descriptor_b, round(abs(r), 6) as abs_correlation, round(r, 6) as correlation from c where abs(r) >= 0.9""")
def correlation_pairs(spark, sf):
    return rounded(descriptors.correlation_pairs(wide(spark, sf), NUMERIC, 0.9))


@query("ml4_feature_scores", f"with {WIDE_SQL}, m as (select median(sparse) s from w)" + column_sql("""
 select '{n}' as feature, round(coalesce(abs(corr({c}, l_extendedprice)), 0), 6) as score from w""", ["l_quantity", "l_discount", "l_tax", "MolLogP"]) + """
 union all select 'sparse', round(abs(corr(coalesce(sparse, s), l_extendedprice)), 6) from w, m""")
def feature_scores(spark, sf):
    df = wide(spark, sf)
    cols = ["l_quantity", "l_discount", "l_tax", "MolLogP", "sparse"]
    s = descriptors.feature_scores(df, cols, descriptors.fill_values(df, cols), {}, "l_extendedprice")
    return spark.createDataFrame([(c, round(v, 6)) for c, v in s.items()], "feature string, score double")


@query("ml1_descriptor_filter", f"with {WIDE_SQL}, f as (" + column_sql("""
 select '{n}' as feature, round((count(*) - count({c})) / count(*), 4) as missing_fraction, count(*) - count({c}) as missing_count,
   case when (count(*) - count({c})) / count(*) > 0.2 then 'high_missing' when var_pop({c}) < 0.0001 then 'low_variance' end as s, abs(corr({c}, l_extendedprice)) r from w""",
    ["l_quantity", "l_discount", "l_tax", "MolLogP", "sparse", "constant"]) + """)
 select feature, missing_fraction, missing_count, coalesce(s, case when feature = (select max(feature) from f where feature in ('l_quantity', 'MolLogP')
   and round(r, 9) = (select round(max(r), 9) from f where feature in ('l_quantity', 'MolLogP'))) or feature not in ('l_quantity', 'MolLogP') then 'kept' else 'correlated' end) as status from f""")
def descriptor_filter(spark, sf):
    df = wide(spark, sf)
    cfg = descriptors.FilterConfig(target="l_extendedprice", min_variance=0.0001)
    res = descriptors.filter_descriptors(df, ["l_quantity", "l_discount", "l_tax", "MolLogP", "sparse", "constant"], cfg)
    return res.report.select("feature", "missing_fraction", "missing_count", "status")


@query("ml5_median_imputation", f"with {WIDE_SQL}, m as (select median(sparse) s from w) select round(sum(coalesce(sparse, s)), 4) as total, count(coalesce(sparse, s)) as n from w, m")
def median_imputation(spark, sf):
    df = wide(spark, sf)
    out = descriptors.impute(df, descriptors.fill_values(df, ["sparse"]))
    return out.agg(F.round(F.sum("sparse"), 4).alias("total"), F.count("sparse").alias("n"))


@query("agg14_removed_families", f"with {WIDE_SQL}, f as (" + column_sql("""
 select '{n}' as feature, (count(*) - count({c})) / count(*) > 0.2 or var_pop({c}) < 0.0001 as gone from w""", ["l_discount", "l_tax", "sparse", "constant"]) + """)
 select regexp_extract(feature, '^([A-Za-z_]+)', 1) as family, count(*) as n_removed from f where gone group by 1""")
def removed_families(spark, sf):
    cfg = descriptors.FilterConfig(min_variance=0.0001, max_correlation=1.0)
    res = descriptors.filter_descriptors(wide(spark, sf), ["l_discount", "l_tax", "sparse", "constant"], cfg)
    return descriptors.removed_families(res.report)


@query("win9_spearman_ranks", """
 select p_partkey, (rank() over (order by p_size) + (rank() over (order by p_size) + count(*) over (partition by p_size) - 1)) / 2.0 as rank_p_size,
   (rank() over (order by p_retailprice) + (rank() over (order by p_retailprice) + count(*) over (partition by p_retailprice) - 1)) / 2.0 as rank_p_retailprice from part""")
def spearman_ranks(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return descriptors.spearman_ranks(p, ["p_size", "p_retailprice"], "p_partkey").select("p_partkey", "rank_p_size", "rank_p_retailprice")


@query("ml7_clean_matrix", f"with {WIDE_SQL} select * from (" + column_sql("select '{n}' as feature, min({c}) <> max({c}) as k from w") + ") where k", )
def clean_matrix(spark, sf):
    kept = descriptors.clean_matrix(wide(spark, sf), NUMERIC)
    return spark.createDataFrame([(c, True) for c in kept], "feature string, k boolean")


@query("prj8_shared_columns", """
 select 'c_acctbal' as feature where (select min(c_acctbal) <> max(c_acctbal) from customer) and (select min(s_acctbal) <> max(s_acctbal) from supplier)
 union all select 'nation' where (select min(c_nationkey) <> max(c_nationkey) from customer) and (select min(s_nationkey) <> max(s_nationkey) from supplier)""")
def shared_columns(spark, sf):
    ref = table(spark, sf, "customer").select("c_acctbal", F.col("c_nationkey").alias("nation"), F.lit(1).alias("flat"), F.col("c_custkey").alias("id"), "c_name")
    q = table(spark, sf, "supplier").select(F.col("s_acctbal").alias("c_acctbal"), F.col("s_nationkey").alias("nation"), F.lit(2).alias("flat"),
                                            F.col("s_suppkey").alias("id"), F.col("s_name").alias("c_name"))
    return spark.createDataFrame([(c,) for c in domain.shared_columns(ref, q)], "feature string")


@query("sc25_safe_ratio", "select p_partkey, case when p_size % 5 > 0 then round(p_retailprice / (p_size % 5), 6) end as ratio from part")
def safe_ratio(spark, sf):
    from compoundry.functions.missing import safe_ratio as ratio

    return table(spark, sf, "part").select("p_partkey", F.round(ratio(F.col("p_retailprice"), (F.col("p_size") % 5).cast("double")), 6).alias("ratio"))


@query("sc26_minmax_log", """
 select p_partkey, round((ln(1 + p_size) - min(ln(1 + p_size)) over ()) / (max(ln(1 + p_size)) over () - min(ln(1 + p_size)) over ()), 6) as scaled from part""")
def minmax_log(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.log1p(F.col("p_size").cast("double")).alias("v"))
    ends = p.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    return p.crossJoin(F.broadcast(ends)).select("p_partkey", F.round(scaled, 6).alias("scaled"))


SCREENED = ["q", "p", "d", "t", "qp", "pd", "k"]
SCREENED_SQL = """x as (select l_quantity q, l_extendedprice p, l_discount d, l_tax t, l_quantity + l_extendedprice / 5000 qp, l_extendedprice * (1 - l_discount) pd, 1.0 k from lineitem)"""
#: Columns by falling variance; each stays unless one that stayed is near it.
_ML9 = "with recursive " + SCREENED_SQL + ", v(c, pos, var) as (" + " union all ".join(
    f"select '{c}', {i}, (select var_pop({c}) from x)" for i, c in enumerate(SCREENED)) + "), r(a, b, cc) as (" + " union all ".join(
    f"select '{a}', '{b}', coalesce((select corr({a}, {b}) from x), 0)" for a in SCREENED for b in SCREENED if a != b and "k" not in (a, b)) + """),
 o as (select c, pos, row_number() over (order by var desc, pos) as n from v),
 near as (select c, pos, n, coalesce((select list(b) from r where a = c and abs(cc) >= 0.8), []::varchar[]) as l from o),
 w as (select 0::bigint as n, []::varchar[] as kept union all select near.n, case when list_has_any(kept, l) then kept else list_append(kept, c) end from w join near on near.n = w.n + 1)
 select c as feature, pos as position, list_contains((select kept from w order by n desc limit 1), c) as kept from v"""


@query("ml9_high_correlation", _ML9)
def high_correlation(spark, sf):
    from compoundry.operators.correlation import high_correlation_columns

    q, p, d = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount")
    x = inputs.table(spark, sf, "lineitem").select(q.alias("q"), p.alias("p"), d.alias("d"), F.col("l_tax").alias("t"), (q + p / 5000).alias("qp"),
                                                   (p * (1 - d)).alias("pd"), F.lit(1.0).alias("k"))
    return high_correlation_columns(x, SCREENED, 0.8)
