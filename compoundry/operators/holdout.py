"""Regression runs whose every statistic comes from the training rows alone.

Fills, variances, correlations, chosen features and coefficients are read from two aggregations over the training
rows; the fitted chain is one column expression, so test and external rows are scored in their own scan and
can leak nothing into the fit.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compoundry.functions import linalg
from compoundry.operators import descriptors, regression, validation


@dataclass(frozen=True)
class ChainConfig:
    """``max_missing``: share of training rows a feature may lack; ``fill``: mean, median or zero;
    ``selection``: search among the features left, on folds of the training rows; ``ridge``: penalty, 0 for least squares."""

    max_missing: float = 0.3
    fill: str = "mean"
    min_variance: float = 1e-12
    correlation: float = 0.95
    prefer: str = "variance"
    selection: regression.SelectionConfig | None = None
    folds: int = 5
    ridge: float = 0.0
    seed: int = 0


@dataclass
class Chain:
    """A fitted chain; ``dropped`` holds the reason for every feature left out."""

    features: list[str]
    fills: dict[str, float]
    coefficients: np.ndarray
    intercept: float
    target: str
    n_train: int
    dropped: dict[str, str] = field(default_factory=dict)

    def predict(self, df: DataFrame, name: str = "predicted") -> DataFrame:
        """All rows and columns plus the prediction; missing or non-numeric features take the training fill."""
        value = F.lit(float(self.intercept))
        for c, w in zip(self.features, self.coefficients, strict=True):
            own = F.expr(f"try_cast(`{c}` as double)")
            own = F.when(~F.isnan(own) & (F.abs(own) != float("inf")), own)
            value = value + F.coalesce(own, F.lit(self.fills[c])) * float(w)
        return df.withColumn(name, value)

    def table(self, spark) -> DataFrame:
        """feature, fill, coefficient; the intercept has no fill."""
        rows = [("intercept", None, float(self.intercept))]
        rows += [(c, self.fills[c], float(w)) for c, w in zip(self.features, self.coefficients, strict=True)]
        return spark.createDataFrame(rows, "feature string, fill double, coefficient double")


def _clean(df: DataFrame, features: list[str], target: str, ident: str) -> DataFrame:
    """Numbers as doubles, anything else as null; rows without a target are no training rows."""
    number = lambda c: F.expr(f"try_cast(`{c}` as double)")
    finite = lambda v: F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    return df.select(F.col(f"`{ident}`").alias(ident), *[finite(number(c)).alias(c) for c in [*features, target]]).where(F.col(f"`{target}`").isNotNull())


def fit_chain(train: DataFrame, features: list[str], target: str, ident: str, cfg: ChainConfig = ChainConfig()) -> Chain:
    """Missing share, fill, variance, correlation and selection filters and the linear fit, from ``train`` only.

    Features empty or too often missing, constant, or correlated with one that stands before them are left out with their
    reason. A training table without rows, or one that keeps no feature, is an error.
    """
    rows = _clean(train, features, target, ident)
    counts = rows.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(features)]).first()
    n = counts["n"]
    if not n:
        raise ValueError("no training row has a target")
    dropped = {c: "missing" for i, c in enumerate(features) if counts[f"c{i}"] == 0 or 1 - counts[f"c{i}"] / n > cfg.max_missing}
    left = [c for c in features if c not in dropped]
    fills = descriptors.fill_values(rows, left, cfg.fill)
    filled = descriptors.impute(rows, fills)
    m = linalg.moments(filled, [*left, target])
    variance = np.diag(m.cross) / max(m.n, 1)
    varied = [i for i in range(len(left)) if variance[i] > cfg.min_variance]
    dropped |= {c: "constant" for i, c in enumerate(left) if i not in set(varied)}
    kept = set(descriptors.drop_high_correlation(m.part(varied), cfg.correlation, cfg.prefer)) if varied else set()
    dropped |= {left[i]: "correlated" for i in varied if left[i] not in kept}
    chosen = [c for c in left if c in kept]
    if cfg.selection is not None and chosen:
        cv = regression.cross_validation(filled, chosen, target, ident, cfg.folds, cfg.seed)
        picked = {chosen[i] for i in regression.select(cv, cfg.selection).subset}
        dropped |= {c: "not selected" for c in chosen if c not in picked}
        chosen = [c for c in chosen if c in picked]
    if not chosen:
        raise ValueError("no feature is left after the training filters")
    x = [left.index(c) for c in chosen]
    line = regression.fit_ridge(m, x, len(left), cfg.ridge) if cfg.ridge > 0 else regression.fit_linear(m, x, len(left))
    return Chain(chosen, {c: fills[c] for c in chosen}, np.asarray(line.coef), float(line.intercept), target, int(m.n), dropped)


def scored(chain: Chain, df: DataFrame, split: str) -> DataFrame:
    """split, observed, predicted of the rows with a target."""
    observed = F.expr(f"try_cast(`{chain.target}` as double)")
    rows = chain.predict(df, "_p").select(F.col(f"`{split}`").cast("string").alias("split"), observed.alias("observed"), F.col("_p").alias("predicted"))
    return rows.where(F.col("observed").isNotNull() & ~F.isnan("observed"))


def run(df: DataFrame, features: list[str], target: str, ident: str, split: str, cfg: ChainConfig = ChainConfig(),
        train: str = "train") -> tuple[Chain, DataFrame]:
    """Fit on the rows of one split; metrics of every split by the same chain."""
    chain = fit_chain(df.where(F.col(f"`{split}`") == train), features, target, ident, cfg)
    return chain, validation.metrics_by_split(scored(chain, df, split))
