"""Regression, selection, projection, explanation and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from compoundry.functions import linalg
from compoundry.operators import holdout, models, regression, reporting, symbolic
from compoundry.plans.inputs import spread, table
from compoundry.plans.model_queries import rounded
from compoundry.plans.registry import query

FEATURES = ["qty", "disc", "tax", "line"]
ROWS_SQL = """
 d as (select l_orderkey * 8 + l_linenumber as id, l_quantity as qty, l_discount * 100 as disc, l_tax * 100 as tax, l_linenumber::double as line,
   l_extendedprice / 1000 as y, l_returnflag as s from lineitem)
"""


def rows(spark, sf):
    li = spread(table(spark, sf, "lineitem"))
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("qty"), (F.col("l_discount") * 100).alias("disc"),
                     (F.col("l_tax") * 100).alias("tax"), F.col("l_linenumber").cast("double").alias("line"), (F.col("l_extendedprice") / 1000).alias("y"),
                     F.col("l_returnflag").alias("s"))


@query("ml15_ols_coefficients", f"""with {ROWS_SQL}, m as (select count(*) n, avg(qty) ma, avg(disc) mb, avg(y) my, var_pop(qty) aa, var_pop(disc) bb, covar_pop(qty, disc) ab,
   covar_pop(qty, y) ay, covar_pop(disc, y) bd from d),
 c as (select *, (ay * bb - bd * ab) / (aa * bb - ab * ab) as b1, (bd * aa - ay * ab) / (aa * bb - ab * ab) as b2 from m),
 e as (select *, my - b1 * ma - b2 * mb as b0 from c), s as (select sum((y - b0 - b1 * qty - b2 * disc) ** 2) / (max(n) - 3) as s2 from d, e),
 v as (select *, aa * bb - ab * ab as det from e, s)
 select 'intercept' as term, round(b0, 6) as coefficient, round(sqrt(s2 * (1.0 / n + (ma * ma * bb - 2 * ma * mb * ab + mb * mb * aa) / det / n)), 6) as std_error, null::double as vif from v
 union all select 'qty', round(b1, 6), round(sqrt(s2 * bb / det / n), 6), round(aa * bb / det, 6) from v
 union all select 'disc', round(b2, 6), round(sqrt(s2 * aa / det / n), 6), round(aa * bb / det, 6) from v""")
def ols_coefficients(spark, sf):
    m = linalg.moments(rows(spark, sf), ["qty", "disc", "y"])
    return rounded(regression.coefficient_table(spark, m, [0, 1], 2).select("term", "coefficient", "std_error", "vif"))


CHAIN_SQL = f"""{ROWS_SQL}, g as (select s, case when id % 11 <> 0 then 2 * qty + 1 end as twice, disc, y from d),
 f as (select avg(twice) as fill from g where s = 'N'), z as (select s, coalesce(twice, fill) as a, disc as b, y from g, f),
 m as (select avg(a) ma, avg(b) mb, avg(y) my, var_pop(a) aa, var_pop(b) bb, covar_pop(a, b) ab, covar_pop(a, y) ay, covar_pop(b, y) bd from z where s = 'N'),
 c as (select *, (ay * bb - bd * ab) / (aa * bb - ab * ab) as b1, (bd * aa - ay * ab) / (aa * bb - ab * ab) as b2 from m),
 p as (select s, y, my + b1 * (a - ma) + b2 * (b - mb) as f from z, c)"""


def chain_run(spark, sf):
    """Split N trains, A and R stay outside: a doubled feature, one constant in training only, one mostly missing."""
    d = rows(spark, sf).select("id", "s", "disc", "y", F.when(F.col("id") % 11 != 0, F.col("qty")).alias("qty"),
                               F.when(F.col("id") % 11 != 0, 2 * F.col("qty") + 1).alias("twice"),
                               F.when(F.col("s") == "N", 3.0).otherwise(F.col("tax")).alias("flat"), F.when(F.col("id") % 5 == 0, F.col("line")).alias("rare"))
    return holdout.run(d, ["qty", "twice", "disc", "flat", "rare"], "y", "id", "s", train="N")


@query("ml31_training_only_fit", f"""with {CHAIN_SQL} select 'intercept' as feature, null::double as fill, round(my - b1 * ma - b2 * mb, 6) as coefficient from c
 union all select 'twice', round(fill, 6), round(b1, 6) from c, f union all select 'disc', round(mb, 6), round(b2, 6) from c""")
def training_only_fit(spark, sf):
    return rounded(chain_run(spark, sf)[0].table(spark))


@query("ml12_external_run", f"""with {CHAIN_SQL}, w as (select 'all' as "group", y, f from p union all select s, y, f from p)
 select "group", count(*) as n, round(1 - sum((y - f) ** 2) / (var_pop(y) * count(*)), 6) as r2, round(sqrt(avg((y - f) ** 2)), 6) as rmse, round(avg(abs(y - f)), 6) as mae
 from w group by 1""")
def external_run(spark, sf):
    return rounded(chain_run(spark, sf)[1].select("group", "n", "r2", "rmse", "mae"))


@query("ml13_select_k_best", f"""with {ROWS_SQL}, r as (select 'qty' f, corr(qty, y) r, count(*) n from d union all select 'disc', corr(disc, y), count(*) from d
   union all select 'tax', corr(tax, y), count(*) from d union all select 'line', corr(line, y), count(*) from d)
 select f as feature, round(r * r / (1 - r * r) * (n - 2), 4) as f_score from r order by abs(r) desc limit 2""")
def select_k_best(spark, sf):
    m = linalg.moments(rows(spark, sf), FEATURES + ["y"])
    f = regression.f_regression(m, [0, 1, 2, 3], 4)
    best = regression.select_k_best(m, [0, 1, 2, 3], 4, 2)
    return spark.createDataFrame([(FEATURES[i], round(float(f[i]), 4)) for i in best], "feature string, f_score double")


@query("ml14_forward_selection", f"""with {ROWS_SQL}, r as (select 'qty' f, abs(corr(qty, y)) r from d union all select 'disc', abs(corr(disc, y)) from d
   union all select 'tax', abs(corr(tax, y)) from d union all select 'line', abs(corr(line, y)) from d)
 select f as feature, round(r * r, 6) as score from r order by r desc limit 1""")
def forward_selection(spark, sf):
    cv = regression.cross_validation(rows(spark, sf), FEATURES, "y", "id", 1)
    sel = regression.select(cv, regression.SelectionConfig(criterion="train_r2", max_features=1))
    return spark.createDataFrame([(n, round(sel.score, 6)) for n in sel.names], "feature string, score double")


@query("ml14_subset_methods")
def subset_methods(spark, sf):
    cv = regression.cross_validation(rows(spark, sf), FEATURES, "y", "id", 5)
    out = []
    for method in ("forward", "backward", "montecarlo", "genetic"):
        sel = regression.select(cv, regression.SelectionConfig(method=method, criterion="bic"))
        out.append((method, ",".join(sel.names), float(sel.score)))
    return spark.createDataFrame(out, "method string, features string, score double")


#: The network as a fold over rounds, then the walk along its cycle.
_NET = """list_reduce([{{'l': ({0}) // side, 'r': ({0}) % side}}, {{'l': 1::bigint, 'r': 0::bigint}}, {{'l': 2, 'r': 0}}, {{'l': 3, 'r': 0}}, {{'l': 4, 'r': 0}}],
  lambda a, b: {{'l': a.r, 'r': (a.l + ((a.r * 2654435761 + run * 40503 + b.l * 69069) % 2147483647) * ((a.r * 2654435761 + run * 40503 + b.l * 69069) % 2147483647)
    % 1073741789) % side}})"""
_PERMUTED = f"""with o as (select o_orderkey as id, o_totalprice as y, row_number() over (order by o_orderkey) - 1 as i, count(*) over () as n from orders),
 s as (select o.*, (floor(sqrt(n - 1)) + 1)::bigint as side, unnest(range(1, 4)) as run from o), e as (select id, run, n, side, {_NET.format("i")} as q from s),
 f as (select id, run, n, side, q.l * side + q.r as p from e),
 w as (select id, run, case when p < n then p else list_reduce(list_prepend(p, range(64)), lambda x, z: case when x < n then x else
   ({_NET.format("x")}).l * side + ({_NET.format("x")}).r end) end as p from f)
 select w.id, run, o.y from w join o on o.i = w.p"""


@query("ml17_permuted_targets", _PERMUTED)
def permuted_targets(spark, sf):
    p = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("y"))
    return regression.permuted_targets(p, [], "y", "id", 3).withColumnRenamed("_run", "run").select("id", "run", "y")


@query("ml17_permutation_test")
def permutation_test(spark, sf):
    p = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("double").alias("a"),
                                          (F.col("o_orderkey") % 97).cast("double").alias("b"), F.col("o_totalprice").alias("y"))
    r = regression.permutation_test(p, ["a", "b"], "y", "id")
    return spark.createDataFrame([(r["q2_observed"], r["p_value"])], "q2_observed double, p_value double")


@query("ml10_ridge_training")
def ridge_training(spark, sf):
    return models.train(rows(spark, sf), "y", "id", "ridge", FEATURES).metrics


@query("ml10_tree_training")
def tree_training(spark, sf):
    d = rows(spark, sf)
    model = models.fit(d, "gradient_boosting", FEATURES, "y")
    return models.long_metrics(model.predict(d.withColumn("observed", F.col("y"))), "s")


@query("ml11_model_ranking")
def model_ranking(spark, sf):
    ranking = models.model_ranking(rows(spark, sf), "y", "id", FEATURES)
    return spark.createDataFrame([(r["rank"], r["model"], str(r["params"]), float(r["cv_r2"])) for r in ranking], "rank int, model string, params string, cv_r2 double")


@query("ml11_ensemble_prediction")
def ensemble_prediction(spark, sf):
    d = rows(spark, sf)
    top = models.ensemble(d, "y", FEATURES, models.model_ranking(d, "y", "id", FEATURES), 3)
    return models.predict_ensemble(top, d).select("id", "y", "predicted")


@query("ml22_univariate_importance", f"""with {ROWS_SQL}, r as (select 'qty' f, abs(corr(qty, y)) v, avg(qty) m, stddev_samp(qty) sd from d union all select 'disc', abs(corr(disc, y)), avg(disc), stddev_samp(disc) from d
   union all select 'tax', abs(corr(tax, y)), avg(tax), stddev_samp(tax) from d union all select 'line', abs(corr(line, y)), avg(line), stddev_samp(line) from d)
 select row_number() over (order by v desc)::int as rank, f as feature, round(v, 6) as importance, round(v / sum(v) over (), 6) as normalized_importance,
   round(m, 6) as mean, round(sd, 6) as std from r""")
def univariate_importance(spark, sf):
    d = rows(spark, sf)
    method, values = models.importance(d, None, FEATURES, "y")
    return rounded(models.importance_table(d, method, values).select("rank", "feature", "importance", "normalized_importance", "mean", "std"))


@query("ml22_local_contributions", f"""with {ROWS_SQL}, w as (select abs(corr(qty, y)) wa, abs(corr(disc, y)) wb, avg(qty) ma, stddev_samp(qty) sa, avg(disc) mb, stddev_samp(disc) sb from d)
 select count(*) as n, round(sum(score), 4) as total, round(max(score), 6) as top from (select id, ((qty - ma) / sa * wa + (disc - mb) / sb * wb) / (wa + wb) as score from d, w)""")
def local_contributions(spark, sf):
    d = rows(spark, sf)
    method, values = models.importance(d, None, ["qty", "disc"], "y")
    local = models.local_contributions(d, models.importance_table(d, method, values), "id")
    return local.agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum("approx_local_score"), 4) + 0.0).alias("total"), F.round(F.max("approx_local_score"), 6).alias("top"))


@query("ml25_principal_axes", f"""with {ROWS_SQL}, m as (select var_samp(qty) a, var_samp(disc) c, covar_samp(qty, disc) b from d),
 l as (select (a + c + sqrt((a - c) ** 2 + 4 * b * b)) / 2 l1, (a + c - sqrt((a - c) ** 2 + 4 * b * b)) / 2 l2 from m)
 select 'PC1' as axis, round(l1 / (l1 + l2), 6) as explained from l union all select 'PC2', round(l2 / (l1 + l2), 6) from l""")
def principal_axes(spark, sf):
    axes = regression.principal_axes(rows(spark, sf), ["qty", "disc"], 2)
    return spark.createDataFrame([(f"PC{i + 1}", round(v, 6)) for i, v in enumerate(axes.explained)], "axis string, explained double")


@query("ml25_space_coordinates")
def space_coordinates(spark, sf):
    d = rows(spark, sf)
    return regression.principal_axes(d, FEATURES, 2).scores(d).select("id", "PC1", "PC2")


@query("ml24_symbolic_regression", f"""with {ROWS_SQL} select 'disc*qty' as term, 1.0::double as coefficient, round(avg(qty * disc), 6) as mean_abs_contribution from d
   union all select 'line', 3.0::double, round(avg(3 * line), 6) from d""")
def symbolic_regression(spark, sf):
    d = rows(spark, sf).withColumn("z", F.col("qty") * F.col("disc") + 3 * F.col("line"))
    return rounded(symbolic.term_table(d, symbolic.fit_symbolic(d, FEATURES, "z", "id")))


@query("sc28_symbolic_terms", f"""with {ROWS_SQL} select round(sum(qty ** 2), 4) as sq, round(sum(sign(disc - 5) * sqrt(abs(disc - 5))), 4) as rt,
   round(sum(sign(disc - 5) * ln(1 + abs(disc - 5))), 4) as lg, round(sum(1 / (1 + abs(disc - 5))), 4) as inv, round(sum(qty * (disc - 5)), 4) as prod from d""")
def symbolic_terms(spark, sf):
    d = rows(spark, sf).withColumn("disc", F.col("disc") - 5)
    t = symbolic.candidate_terms(["qty", "disc"], {"qty": 0.0, "disc": 0.0}, symbolic.SymbolicConfig())
    s = lambda label, name: F.round(F.sum(t[label]), 4).alias(name)
    return d.agg(s("qty^2", "sq"), s("sign(disc)*sqrt(abs(disc))", "rt"), s("sign(disc)*log1p(abs(disc))", "lg"), s("1/(1+abs(disc))", "inv"), s("qty*disc", "prod"))


@query("ml26_packaged_predictions", f"""with {ROWS_SQL}, m as (select regr_slope(y, qty) b, regr_intercept(y, qty) a from d)
 select id, y, case when id % 7 = 0 then 'failed' else 'ok' end as prediction_status, case when id % 7 <> 0 then round(a + b * qty, 6) end as "predicted_p_IC50" from d, m""")
def packaged_predictions(spark, sf):
    d = rows(spark, sf)
    model = models.fit(d, "linear", ["qty"], "y")
    q = d.select("id", "y", F.when(F.col("id") % 7 != 0, F.col("qty")).alias("source_qty"))
    out, _ = models.package_predictions(model, q, "p IC50")
    return out.select("id", "y", "prediction_status", F.round("predicted_p_IC50", 6).alias("predicted_p_IC50"))


@query("set1_stacked_datasets", f"""with {ROWS_SQL} select 'train' as dataset, count(*) as n, count(line) as n_line from d where s = 'A'
   union all select 'test', count(*), 0 from d where s = 'N' union all select 'external', count(*), 0 from d where s = 'R'""")
def stacked_datasets(spark, sf):
    d = rows(spark, sf)
    out = reporting.stack_datasets({"train": d.where(F.col("s") == "A"), "test": d.where(F.col("s") == "N").drop("line"), "external": d.where(F.col("s") == "R").drop("line")})
    return out.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.count("line").alias("n_line"))


@query("agg17_dataset_profile", """select count(*) as rows, 6::bigint as columns, count(*) filter (c_nationkey % 4 = 0) as missing_values,
   count(*) - count(distinct c_mktsegment) as duplicate_ids from customer""")
def dataset_profile(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("compound_id"), "c_name", "c_acctbal", "c_nationkey",
                                            F.when(F.col("c_nationkey") % 4 != 0, F.col("c_acctbal")).alias("activity"))
    return reporting.dataset_profile(c).select("rows", "columns", "missing_values", "duplicate_ids")


@query("agg17_numeric_summary", """select 'c_acctbal' as feature, count(c_acctbal) as count, round(avg(c_acctbal), 6) as mean, round(stddev_samp(c_acctbal), 6) as std, min(c_acctbal) as min,
   round(median(c_acctbal), 6) as median, max(c_acctbal) as max from customer""")
def numeric_summary(spark, sf):
    return rounded(reporting.numeric_summary(table(spark, sf, "customer"), ["c_acctbal"]))


@query("ml29_report_flags", """select item, status from (select 'Dataset' as item, 'ok' as status union all select 'Missing values', 'warning' where (select count(*) from customer where c_nationkey % 4 = 0) > 0
   union all select 'Duplicate identifiers', 'warning' where (select count(*) - count(distinct c_mktsegment) from customer) > 0 union all select 'Prediction diagnostics', 'warning'
   union all select 'Applicability domain', 'missing' union all select 'Interpretability', 'missing')""")
def report_flags(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("compound_id"),
                                            F.when(F.col("c_nationkey") % 4 != 0, F.col("c_acctbal")).alias("activity"))
    report = reporting.build_report(dataset=c)
    return spark.createDataFrame([(i, s) for i, s, _ in report.flags], "item string, status string")
