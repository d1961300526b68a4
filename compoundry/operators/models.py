"""Regression models for descriptor tables: train, cross-validate, search, predict, explain."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from compoundry.functions import linalg
from compoundry.functions.missing import NUMERIC_TYPES, finite, safe_corr
from compoundry.operators import descriptors, regression, splits
from compoundry.operators.regression import Linear
from compoundry.operators.validation import regression_aggregates
from compoundry.session import reliable_checkpoint

# Model settings.  Trees come from the ML library; the others are product-matrix fits.
LINEAR_MODELS = {
    "linear": (regression.fit_linear, {}), "ridge": (regression.fit_ridge, {"alpha": 1.0}),
    "elastic_net": (regression.fit_elastic_net, {"alpha": 0.01, "l1_ratio": 0.2}), "pls": (regression.fit_pls, {"components": 2}),
}
TREE_MODELS = {
    "random_forest": (RandomForestRegressor, {"numTrees": 300, "maxDepth": 5}),
    "gradient_boosting": (GBTRegressor, {"maxIter": 100, "maxDepth": 3, "stepSize": 0.1}),
}
SCALED = ("ridge", "elastic_net", "pls", "linear")


@dataclass
class Fitted:
    """A fitted model: fill values and either a linear predictor or an ML pipeline."""

    key: str
    features: list[str]
    target: str
    fills: dict[str, float]
    linear: Linear | None = None
    pipeline: object | None = None

    def predict(self, df: DataFrame, name: str = "predicted") -> DataFrame:
        filled = df.withColumns({f"_f{i}": F.coalesce(finite(F.col(f"`{c}`").cast("double")), F.lit(self.fills.get(c, 0.0)))
                                 for i, c in enumerate(self.features)})
        cols = [f"_f{i}" for i in range(len(self.features))]
        if self.linear is not None:
            at = {c: i for i, c in enumerate(self.features)}
            used = [f"_f{at[c]}" for c in self.linear.features]
            return filled.withColumn(name, linalg.linear_form(used, self.linear.coef, self.linear.intercept)).drop(*cols)
        out = self.pipeline.transform(filled)
        return out.withColumn(name, F.col("_prediction")).drop("_prediction", "_vector", *cols)


def fit(df: DataFrame, key: str, features: list[str], target: str, params: dict | None = None,
        fills: dict[str, float] | None = None, seed: int = 42) -> Fitted:
    """Fit one model on complete-target rows; missing features take the median."""
    rows = df.where(finite(F.col(target).cast("double")).isNotNull())
    fills = fills if fills is not None else descriptors.fill_values(rows, features)
    filled = descriptors.impute(rows, fills)
    if key in LINEAR_MODELS:
        make, defaults = LINEAR_MODELS[key]
        m = linalg.moments(filled, features + [target])
        lin = make(m, list(range(len(features))), len(features), **{**defaults, **(params or {})})
        return Fitted(key, features, target, fills, linear=lin)
    if key not in TREE_MODELS:
        raise ValueError(f"unknown model {key!r}; have {', '.join([*LINEAR_MODELS, *TREE_MODELS])}")
    make, defaults = TREE_MODELS[key]
    cols = [f"_f{i}" for i in range(len(features))]
    data = filled.select(*[F.col(f"`{c}`").alias(s) for c, s in zip(features, cols)], F.col(target).cast("double").alias("_label"))
    settings = {**defaults, **(params or {})}
    if key == "gradient_boosting" and settings.get("subsamplingRate", 1.0) == 1.0 and not {"weightCol", "lossType"} & set(settings):
        data, settings = _by_vector(data, cols), {**settings, "weightCol": "_weight"}
    model = make(featuresCol="_vector", labelCol="_label", predictionCol="_prediction", seed=seed, **settings)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=cols, outputCol="_vector"), model]).fit(data)
    return Fitted(key, features, target, fills, pipeline=pipe)


def _by_vector(data: DataFrame, cols: list[str]) -> DataFrame:
    """One row per distinct feature vector: the mean label, weighted by its rows.

    Boosting by squared error without subsampling fits the same trees to it: residuals differ from the label by a value of the
    vector, and the spread of labels within a vector is no split's gain. Every round then reads as many rows as there
    are vectors, not as there are rows. The candidates of a split come from a sample as before, now of the vectors by weight.
    """
    return reliable_checkpoint(data.groupBy(*cols).agg(F.avg("_label").alias("_label"), F.count(F.lit(1)).cast("double").alias("_weight")))


def usable_features(df: DataFrame, target: str, ident: str, min_present: float = 0.7, drop_constant: bool = True) -> list[str]:
    """Numeric, non-provenance columns with enough values and some variation."""
    from compoundry.operators.domain import usable_columns

    # Provenance columns that are never features.
    blocked = {"row_id", "transform_log", "qc_flags", "dropped_reason", "import_source_format", "source_format", "source_name", target.lower(), ident.lower()}
    numeric = [c for c, t in df.dtypes if t in NUMERIC_TYPES and c.lower() not in blocked and not c.lower().startswith("source_")]
    return usable_columns(df.select(*numeric), min_present, drop_constant, exclude=())


@dataclass
class Training:
    model: Fitted
    predictions: DataFrame
    metrics: DataFrame
    summary: dict = field(default_factory=dict)


def train(df: DataFrame, target: str, ident: str, key: str = "ridge", features: list[str] | None = None,
          test_size: float = 0.2, folds: int = 5, seed: int = 42, params: dict | None = None) -> Training:
    """Split, fit on the training rows, predict both parts and cross-validate."""
    features = features or usable_features(df, target, ident)
    if not features:
        raise ValueError("no usable feature columns")
    rows = df.where(finite(F.col(target).cast("double")).isNotNull())
    n = rows.count()
    if n < 4:
        raise ValueError("at least 4 rows with a numeric target are required")
    share = min(max(test_size, 0.05), 0.8)
    if n < 8:
        share = min(max(1 / n, share), 0.5)
    # Written down once: fitting, predicting and scoring all read the split rows.
    keep = rows.select(ident, *dict.fromkeys([target, *features]))
    parts = reliable_checkpoint(splits.random_split(keep, ident, share, 0.0, seed))
    rows = parts.drop("split")
    model = fit(parts.where(F.col("split") == "train"), key, features, target, params, seed=seed)
    pred = with_residuals(model.predict(parts.withColumn("observed", F.col(target).cast("double")))).withColumn("model", F.lit(key))
    cv = cross_predict(rows, key, features, target, ident, min(folds, n), seed, params)
    cv = cv.withColumn("split", F.lit("cross_validation"))
    both = pred.select("split", "observed", "predicted").unionByName(cv.select("split", "observed", "predicted"))
    return Training(model, pred, long_metrics(both), {
        "model_key": key, "target_column": target, "n_rows_used": n, "n_features_used": len(features), "feature_names": features})


def with_residuals(df: DataFrame) -> DataFrame:
    r = F.col("observed") - F.col("predicted")
    return df.withColumns({"residual": r, "abs_residual": F.abs(r)})


def cross_predict(df: DataFrame, key: str, features: list[str], target: str, ident: str, folds: int = 5, seed: int = 42,
                  params: dict | None = None) -> DataFrame:
    """Out-of-fold predictions.  Linear models read the data once for all folds."""
    rows = regression.with_fold(df.withColumn("observed", F.col(target).cast("double")), ident, folds, seed, "_fold")
    if key not in LINEAR_MODELS:
        out = None
        for f in range(folds):
            part = fit(rows.where(F.col("_fold") != f), key, features, target, params, seed=seed).predict(rows.where(F.col("_fold") == f))
            out = part if out is None else out.unionByName(part)
        return out
    fills = descriptors.fill_values(rows, features)
    filled = descriptors.impute(rows, fills)
    by_fold = linalg.moments(filled, features + ["observed"], by="_fold")
    make, defaults = LINEAR_MODELS[key]
    x, y = list(range(len(features))), len(features)
    pred: Column | None = None
    for f in by_fold:
        lin = make(regression.combine([m for g, m in by_fold.items() if g != f]), x, y, **{**defaults, **(params or {})})
        pred = F.when(F.col("_fold") == f, lin.column()) if pred is None else pred.when(F.col("_fold") == f, lin.column())
    return filled.withColumn("predicted", pred)


def long_metrics(df: DataFrame, group: str = "split") -> DataFrame:
    """group, metric, value rows of r2, rmse, mae, n."""
    ok = df.where(F.col("observed").isNotNull() & F.col("predicted").isNotNull())
    agg = regression_aggregates(F.col("observed"), F.col("predicted"))
    wide = ok.groupBy(F.col(group).alias("group")).agg(*[agg[m].cast("double").alias(m) for m in ("r2", "rmse", "mae", "n")])
    items = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("r2", "rmse", "mae", "n")]))
    return wide.select("group", items.alias("i")).select("group", "i.*")


# Search space of the automatic model choice.
SEARCH = {
    "linear": [{}], "ridge": [{"alpha": a} for a in (0.01, 0.1, 1.0, 10.0, 100.0)],
    "elastic_net": [{"alpha": a, "l1_ratio": r} for a in (0.001, 0.01, 0.1) for r in (0.2, 0.5, 0.8)],
    "pls": [{"components": c} for c in (1, 2, 3, 4)],
    "random_forest": [{"numTrees": 50, "maxDepth": d} for d in (4, 8)], "gradient_boosting": [{"maxIter": 30, "maxDepth": d} for d in (2, 4)],
}


def model_ranking(df: DataFrame, target: str, ident: str, features: list[str], keys: tuple[str, ...] = tuple(LINEAR_MODELS),
                  folds: int = 5, seed: int = 42) -> list[dict]:
    """Candidates by pooled cross-validated R2, best first.

    All linear candidates share one pass over the data; tree candidates are fitted.
    """
    rows = df.where(finite(F.col(target).cast("double")).isNotNull())
    filled = descriptors.impute(rows, descriptors.fill_values(rows, features))
    by_fold = linalg.moments(regression.with_fold(filled, ident, folds, seed, "_fold"), features + [target], by="_fold")
    total = regression.combine(list(by_fold.values()))
    x, y = list(range(len(features))), len(features)
    out = []
    for key in keys:
        for params in SEARCH[key]:
            if key in LINEAR_MODELS:
                make, defaults = LINEAR_MODELS[key]
                sse = 0.0
                for f, test in by_fold.items():
                    lin = make(regression.combine([m for g, m in by_fold.items() if g != f]), x, y, **{**defaults, **params})
                    sse += regression.residual_sums(test, x, y, lin.coef, lin.intercept)[0]
            else:
                cv = cross_predict(rows, key, features, target, ident, folds, seed, params)
                sse = cv.agg(F.sum(F.pow(F.col("observed") - F.col("predicted"), 2)).alias("s")).first()["s"]
            out.append({"model": key, "params": params, "cv_r2": 1 - sse / total.cross[y, y], "cv_rmse": (sse / total.n) ** 0.5})
    out.sort(key=lambda r: (-r["cv_r2"], r["model"], str(r["params"])))
    return [{"rank": i + 1, **r} for i, r in enumerate(out)]


def ensemble(df: DataFrame, target: str, features: list[str], ranking: list[dict], top_k: int = 3) -> list[Fitted]:
    return [fit(df, r["model"], features, target, r["params"]) for r in ranking[:top_k]]


def predict_ensemble(models: list[Fitted], df: DataFrame, name: str = "predicted") -> DataFrame:
    """Mean of the members' predictions."""
    out = df
    for i, m in enumerate(models):
        out = m.predict(out, f"_p{i}")
    cols = [f"_p{i}" for i in range(len(models))]
    return out.withColumn(name, sum((F.col(c) for c in cols), F.lit(0.0)) / len(cols)).drop(*cols)


# Explanation.
def importance(df: DataFrame, model: Fitted | None, features: list[str], target: str, method: str = "auto") -> tuple[str, dict[str, float]]:
    """Importance per feature: tree importances, |coefficient|, permutation or |correlation|."""
    if method in ("auto", "model_importance", "coefficient") and model is not None:
        if model.linear is not None:
            return "coefficient_abs", dict(zip(model.linear.features, np.abs(model.linear.coef).astype(float)))
        return "model_importance", dict(zip(features, model.pipeline.stages[-1].featureImportances.toArray().astype(float)))
    if method == "permutation" and model is not None:
        return "permutation", permutation_importance(df, model, features, target)
    y = finite(F.col(target).cast("double"))
    fills = descriptors.fill_values(df, features)
    x = {c: F.when(y.isNotNull(), F.coalesce(finite(F.col(f"`{c}`").cast("double")), F.lit(fills[c]))) for c in features}
    r = df.agg(*[F.abs(safe_corr(v, y)).alias(f"r{i}") for i, v in enumerate(x.values())]).first()
    return "univariate_correlation", {c: float(r[f"r{i}"] or 0.0) for i, c in enumerate(features)}


def permutation_importance(df: DataFrame, model: Fitted, features: list[str], target: str, seed: int = 0) -> dict[str, float]:
    """Loss of R2 when one feature is replaced by that of a seeded random partner row."""
    from compoundry.functions.skew import with_global_rank

    rows = df.where(finite(F.col(target).cast("double")).isNotNull()).select(*features, F.col(target).cast("double").alias("observed"))
    rows = rows.withColumn("_k", F.xxhash64(F.lit(seed), *features, "observed", F.monotonically_increasing_id()))
    rows = reliable_checkpoint(rows)
    order = with_global_rank(rows, "_k", "_k", "_i", chunk=2 ** 44)

    def r2(d: DataFrame) -> float:
        a = regression_aggregates(F.col("observed"), F.col("predicted"))
        return float(d.agg(a["r2"].alias("r")).first()["r"] or 0.0)

    base, out = r2(model.predict(rows)), {}
    for j, c in enumerate(features):
        mixed = with_global_rank(rows.select(c, "_k").withColumn("_h", F.xxhash64(F.lit(seed + j + 1), "_k")), "_h", "_k", "_i", chunk=2 ** 44)
        swapped = order.drop(c).join(mixed.select("_i", c), "_i")
        out[c] = max(base - r2(model.predict(swapped)), 0.0)
    return out


def importance_table(df: DataFrame, method: str, values: dict[str, float], max_features: int | None = None) -> DataFrame:
    """rank, feature, importance, normalized_importance, method, mean, std, missing_fraction."""
    total = sum(abs(v) for v in values.values())
    names = list(values)
    order = sorted(range(len(names)), key=lambda i: (-abs(values[names[i]]), i))[:max_features]
    stats = {}
    cols = [names[i] for i in order]
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        v = finite(F.col(f"`{c}`").cast("double"))
        aggs += [F.avg(v).alias(f"m{i}"), F.when(F.count(v) > 1, F.stddev_samp(v)).alias(f"s{i}"), F.count(v).alias(f"c{i}")]
    r = df.agg(*aggs).first()
    rows = [(k + 1, c, float(values[c]), float(values[c] / total) if total > 0 else 0.0, method, r[f"m{k}"], r[f"s{k}"],
             1 - r[f"c{k}"] / max(r["n"], 1)) for k, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(
        rows, "rank int, feature string, importance double, normalized_importance double, method string, mean double, std double, missing_fraction double")


def local_contributions(df: DataFrame, table: DataFrame, ident: str, top: int | None = None, shown: int = 5) -> DataFrame:
    """Per row: z-score x normalised importance, the strongest features as text and the sum."""
    weights = (table.orderBy("rank") if top is None else table.orderBy("rank").limit(top)).collect()
    parts = []
    for w in weights:
        v = finite(F.col(f"`{w['feature']}`").cast("double"))
        z = F.coalesce((v - F.lit(w["mean"])) / F.lit(w["std"] or 1.0), F.lit(0.0))
        parts.append(F.struct(F.lit(w["feature"]).alias("f"), (z * F.lit(w["normalized_importance"])).alias("c")))
    arr = F.array(*parts)
    ranked = F.slice(F.array_sort(arr, lambda a, b: F.when(F.abs(a["c"]) > F.abs(b["c"]), -1).when(F.abs(a["c"]) < F.abs(b["c"]), 1).otherwise(0)), 1, shown)
    text = F.array_join(F.transform(ranked, lambda s: F.concat(s["f"], F.lit(":"), F.format_string("%.4g", s["c"]))), "; ")
    return df.select(F.col(ident).cast("string").alias("compound_id"), text.alias("top_contributing_features"),
                     F.aggregate(arr, F.lit(0.0), lambda a, s: a + s["c"]).alias("approx_local_score"))


# Packaging.
def expected_columns(df: DataFrame, features: list[str]) -> tuple[DataFrame, DataFrame]:
    """Query table with all expected features, and the report of where each came from.

    ``source_X`` and ``X`` stand in for each other; absent features are null.
    """
    have, report, adds = set(df.columns), [], {}
    for f in features:
        twin = f[7:] if f.startswith("source_") else f"source_{f}"
        if f in have:
            report.append((f, "present"))
        elif twin in have:
            adds[f] = F.col(f"`{twin}`")
            report.append((f, f"alias of {twin}"))
        else:
            adds[f] = F.lit(None).cast("double")
            report.append((f, "missing"))
    out = df.withColumns(adds) if adds else df
    return out, df.sparkSession.createDataFrame(report, "feature string, source string")


def package_predictions(model: Fitted, df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Predictions with a per-row status; rows without any usable feature fail, the others do not."""
    from compoundry.functions.texts import prediction_column

    ready, report = expected_columns(df, model.features)
    present = sum((finite(F.col(f"`{c}`").cast("double")).isNotNull().cast("int") for c in model.features), F.lit(0))
    name = prediction_column(label)
    out = model.predict(ready.withColumn("_present", present), "_p")
    ok = F.col("_present") > 0
    return out.withColumns({
        name: F.when(ok, F.col("_p")), "prediction_status": F.when(ok, "ok").otherwise("failed"),
        "missing_features": F.lit(len(model.features)) - F.col("_present")}).drop("_p", "_present"), report


def save_model(model: Fitted, path: str) -> None:
    """Model folder: manifest as JSON text plus the ML pipeline for tree models."""
    import json

    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    manifest = {"key": model.key, "features": model.features, "target": model.target, "fills": model.fills}
    if model.linear is not None:
        manifest["linear"] = {"features": model.linear.features, "coef": [float(c) for c in model.linear.coef], "intercept": model.linear.intercept}
    else:
        model.pipeline.write().overwrite().save(f"{path}/pipeline")
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_model(path: str) -> Fitted:
    import json

    from pyspark.ml import PipelineModel
    from pyspark.sql import SparkSession

    m = json.loads(SparkSession.getActiveSession().read.text(f"{path}/manifest").first()["value"])
    lin = None
    if "linear" in m:
        lin = Linear(m["linear"]["features"], np.array(m["linear"]["coef"]), m["linear"]["intercept"], m["target"])
    pipe = None if lin else PipelineModel.load(f"{path}/pipeline")
    return Fitted(m["key"], m["features"], m["target"], m["fills"], lin, pipe)
