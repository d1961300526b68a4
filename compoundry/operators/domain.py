"""Applicability domain: leverage, neighbour distance, Mahalanobis distance.

Fitting needs only means and the p x p product matrix of the reference table; scoring
is a row expression.  Neighbour distances are the one pairwise part (`neighbors`).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from compoundry.functions import linalg
from compoundry.functions.missing import safe_ratio, to_double
from compoundry.functions.skew import group_quantiles
from compoundry.operators import neighbors
from compoundry.session import reliable_checkpoint


@dataclass(frozen=True)
class DomainConfig:
    use_williams: bool = True
    use_knn: bool = False
    use_mahalanobis: bool = False
    combine: str = "and"
    knn_k: int = 5
    knn_quantile: float = 0.95
    maha_alpha: float = 0.95
    maha_chi2: bool = True


@dataclass
class DomainFit:
    features: list[str]
    config: DomainConfig
    fill: dict[str, float]
    moments: linalg.Moments
    xtx_inv: np.ndarray
    h_star: float
    mean: np.ndarray
    std: np.ndarray
    cov_inv: np.ndarray | None = None
    maha_threshold: float | None = None
    knn_threshold: float | None = None
    reference: DataFrame | None = field(default=None, repr=False)


def column_medians(df: DataFrame, cols: list[str]) -> dict[str, float]:
    """Exact medians, counted per column."""
    items = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("double").alias("v")) for c in cols]))
    long = df.select(items.alias("i")).select("i.*").where(F.col("v").isNotNull() & ~F.isnan("v"))
    return {r["c"]: float(r["m"]) for r in group_quantiles(long, ["c"], "v", {"m": 0.5}).collect()}


def _filled(df: DataFrame, fit_fill: dict[str, float], cols: list[str]) -> DataFrame:
    num = lambda c: F.coalesce(F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")),
                               F.lit(fit_fill.get(c, 0.0)))
    return df.withColumns({c: num(c) for c in cols})


def fit_domain(reference: DataFrame, features: list[str], cfg: DomainConfig = DomainConfig(), fill: bool = True,
               ident: str | None = None) -> DomainFit:
    """Fit on the reference table; missing values take the column median."""
    if not features:
        raise ValueError("The applicability domain needs at least one feature.")
    medians = column_medians(reference, features) if fill else {}
    ref = _filled(reference, medians, features)
    m = linalg.moments(ref, features)
    if m.n == 0:
        raise ValueError("The applicability domain needs at least one reference row.")
    std = np.where(m.std_pop > 1e-12, m.std_pop, 1.0)
    fit = DomainFit(features, cfg, medians, m, linalg.invert(m.cross), 3.0 * (len(features) + 1) / m.n, m.mean, std, reference=ref)
    if cfg.use_mahalanobis and m.n >= 3:
        fit.cov_inv = linalg.invert(m.cross / np.outer(std, std) / (m.n - 1))
        if cfg.maha_chi2:
            fit.maha_threshold = linalg.chi2_quantile(cfg.maha_alpha, max(len(features), 1))
        else:
            d2 = ref.select(F.lit(0).alias("g"), mahalanobis(fit).alias("d2"))
            fit.maha_threshold = float(group_quantiles(d2, ["g"], "d2", {"q": cfg.maha_alpha}).first()["q"])
    if cfg.use_knn and m.n >= 2:
        # Without a row id one is drawn and written down, so that both passes agree on it.
        own = ref.withColumn("_rid", F.col(ident)) if ident else reliable_checkpoint(
            ref.withColumn("_rid", F.monotonically_increasing_id()))
        d = knn_distance(fit, own, "_rid").select(F.lit(0).alias("g"), "knn_dist")
        fit.knn_threshold = float(group_quantiles(d, ["g"], "knn_dist", {"q": cfg.knn_quantile}).first()["q"])
    return fit


def leverage(fit: DomainFit) -> Column:
    """Hat value of a row against the reference: 1/n + d' (D'D)^-1 d."""
    return 1.0 / fit.moments.n + linalg.quadratic_form(fit.features, fit.mean, fit.xtx_inv)


def mahalanobis(fit: DomainFit) -> Column:
    return linalg.quadratic_form(fit.features, fit.mean, fit.cov_inv / np.outer(fit.std, fit.std))


def knn_distance(fit: DomainFit, rows: DataFrame, ident: str) -> DataFrame:
    """ident, knn_dist: mean z-scaled distance to the k nearest reference rows."""
    vec = neighbors.feature_array(fit.features, fit.mean, fit.std)
    corr = fit.moments.cross / np.outer(fit.std, fit.std)
    direction = np.linalg.eigh(corr)[1][:, -1]
    k = max(int(fit.config.knn_k), 1)
    d = neighbors.nearest_distances(rows.select(ident, vec.alias("x")), ident,
                                    fit.reference.select(vec.alias("x")), "x", direction, k + 1)
    return neighbors.mean_distance(d, k)


def score_domain(fit: DomainFit, query: DataFrame, ident: str | None = None) -> DataFrame:
    """Distances and in-domain flags per query row (``ident`` is needed for kNN)."""
    cfg = fit.config
    rows = _filled(query, fit.fill, fit.features)
    rows = rows.withColumns({"leverage": leverage(fit), "h_star": F.lit(fit.h_star)})
    yes = F.lit(True)
    rows = rows.withColumn("in_ad_williams", F.col("leverage") <= fit.h_star if cfg.use_williams else yes)
    flags = [F.col("in_ad_williams")] if cfg.use_williams else []
    if cfg.use_knn and fit.knn_threshold is not None:
        d = knn_distance(fit, rows, ident)
        rows = rows.join(d, ident, "left").withColumn("in_ad_knn", F.col("knn_dist") <= fit.knn_threshold)
    else:
        rows = rows.withColumns({"knn_dist": F.lit(None).cast("double"), "in_ad_knn": yes})
    if cfg.use_knn:
        flags.append(F.col("in_ad_knn"))
    if cfg.use_mahalanobis and fit.maha_threshold is not None:
        rows = rows.withColumn("maha_d2", mahalanobis(fit)).withColumn("in_ad_maha", F.col("maha_d2") <= fit.maha_threshold)
    else:
        rows = rows.withColumns({"maha_d2": F.lit(None).cast("double"), "in_ad_maha": yes})
    if cfg.use_mahalanobis:
        flags.append(F.col("in_ad_maha"))
    rows = rows.withColumns({"knn_threshold": F.lit(fit.knn_threshold).cast("double"),
                             "maha_threshold": F.lit(fit.maha_threshold).cast("double")})
    combined = yes
    if flags:
        combined = flags[0]
        for f in flags[1:]:
            combined = (combined | f) if cfg.combine.strip().lower() == "or" else (combined & f)
    return rows.withColumn("in_ad", combined)


def explain_domain(scored: DataFrame, cfg: DomainConfig, role: str = "query") -> DataFrame:
    """Ratios, margin, confidence tier and reason text of scored rows.

    The leverage ratio is always part of the margin.
    """
    lev = safe_ratio(F.col("leverage"), F.col("h_star"))
    knn = safe_ratio(F.col("knn_dist"), F.col("knn_threshold"))
    maha = safe_ratio(F.col("maha_d2"), F.col("maha_threshold"))
    used = [lev] + ([knn] if cfg.use_knn else []) + ([maha] if cfg.use_mahalanobis else [])
    margin = F.greatest(*used) if len(used) > 1 else lev
    checks = [(cfg.use_williams, "in_ad_williams", "high leverage"),
              (cfg.use_knn, "in_ad_knn", "far from reference neighbours"),
              (cfg.use_mahalanobis, "in_ad_maha", "high Mahalanobis distance")]
    failed = F.array_compact(F.array(*[F.when(~F.col(c), t) for on, c, t in checks if on]) if any(o for o, _, _ in checks)
                             else F.array().cast("array<string>"))
    n_failed = F.size("_failed")
    close = F.coalesce(F.col("AD_margin") >= 0.85, F.lit(False))
    return scored.withColumns({
        "AD_dataset_role": F.lit(role), "AD_leverage_ratio": lev, "AD_knn_ratio": knn, "AD_maha_ratio": maha,
        "AD_margin": margin, "AD_enabled_methods": F.lit(sum(int(o) for o, _, _ in checks)), "_failed": failed,
    }).withColumns({
        "AD_failed_methods": n_failed,
        "AD_confidence": F.when(n_failed > 0, "low").when(close, "medium").otherwise("high"),
        "AD_reason": F.when(n_failed > 0, F.array_join("_failed", "; "))
        .when(close, "inside AD but close to boundary").otherwise("inside AD"),
    }).drop("_failed")


def domain_summary(fit: DomainFit, scored: DataFrame) -> DataFrame:
    """metric, value rows of a scored query table."""
    one = scored.agg(F.count(F.lit(1)).alias("query_rows"), F.count_if("in_ad").alias("query_in_domain"),
                     F.count_if(~F.col("in_ad")).alias("query_out_of_domain"))
    extra = {"reference_rows": fit.moments.n, "feature_count": len(fit.features), "h_star": fit.h_star,
             "knn_threshold": fit.knn_threshold, "mahalanobis_threshold": fit.maha_threshold}
    items = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in one.columns]
    items += [F.struct(F.lit(k).alias("metric"), F.lit(float(v)).alias("value")) for k, v in extra.items() if v is not None]
    return one.select(F.explode(F.array(*items)).alias("m")).select("m.*")


# Columns that are never descriptors of a domain.
NOT_FEATURES = (
    "row_id", "row_index", "compound_id", "molecule_id", "mol_id", "id", "name", "smiles", "canonical_smiles",
    "standardized_smiles", "inchi", "inchikey", "standard_inchikey", "pactivity", "activity", "standard_value",
    "standard_units", "standard_type", "observed", "predicted", "residual", "abs_residual", "split", "class", "label")


def usable_columns(df: DataFrame, min_present: float = 0.70, drop_constant: bool = True,
                   exclude: tuple[str, ...] = NOT_FEATURES) -> list[str]:
    """Numeric columns with enough present values and more than one of them (one pass)."""
    names = [c for c in df.columns if c.lower() not in exclude]
    v = {c: to_double(F.col(f"`{c}`")) for c in names}
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(names):
        aggs += [F.count(v[c]).alias(f"p{i}"), F.min(v[c]).alias(f"a{i}"), F.max(v[c]).alias(f"b{i}")]
    r = df.agg(*aggs).first()
    keep = []
    for i, c in enumerate(names):
        present = r[f"p{i}"] / r["n"] if r["n"] else 0.0
        if r[f"p{i}"] and present >= min_present and not (drop_constant and r[f"a{i}"] == r[f"b{i}"]):
            keep.append(c)
    return keep


def shared_columns(reference: DataFrame, query: DataFrame) -> list[str]:
    there = set(usable_columns(query))
    shared = [c for c in usable_columns(reference) if c in there]
    if not shared:
        raise ValueError("No shared numeric descriptor columns.")
    return shared


def predict_with_domain(model_weights: dict[str, float], intercept: float, fit: DomainFit, query: DataFrame,
                        observed: str | None = None) -> DataFrame:
    """Linear prediction with domain flags.

    The leverage here comes from the query table's own product matrix; with observed
    values the standardised residual must also stay within 3.
    """
    cols = list(fit.features)
    own = linalg.moments(query, cols)
    lev = 1.0 / own.n + linalg.quadratic_form(cols, own.mean, linalg.invert(own.cross))
    rows = query.withColumns({"y_pred": linalg.linear_form(cols, [model_weights[c] for c in cols], intercept), "leverage": lev})
    inside = (F.col("leverage") <= fit.h_star) if fit.config.use_williams else F.lit(True)
    if fit.config.use_mahalanobis and fit.maha_threshold is not None:
        in_m = mahalanobis(fit) <= fit.maha_threshold
        inside = (inside | in_m) if fit.config.combine == "or" else (inside & in_m)
    rows = rows.withColumns({"h_star": F.lit(fit.h_star), "in_ad": inside})
    if observed:
        res = F.col(observed) - F.col("y_pred")
        dof = max(own.n - len(cols) - 1, 1)
        s = rows.agg(F.sqrt(F.sum(res * res) / dof).alias("_s"))
        rows = rows.crossJoin(F.broadcast(s))
        std_res = res / F.greatest(F.col("_s") * F.sqrt(F.greatest(1 - F.col("leverage"), F.lit(1e-12))), F.lit(1e-12))
        rows = rows.withColumn("std_resid", std_res).withColumn("in_ad", F.col("in_ad") & (F.abs("std_resid") <= 3.0)).drop("_s")
    return rows
