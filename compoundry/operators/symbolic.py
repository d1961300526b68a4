"""Symbolic regression: a short sum of transformed features found by greedy search."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from compoundry.functions import linalg
from compoundry.operators import descriptors, regression


@dataclass(frozen=True)
class SymbolicConfig:
    max_features: int = 6
    max_terms: int = 4
    folds: int = 5
    square: bool = True
    cube: bool = False
    log: bool = True
    sqrt: bool = True
    inverse: bool = True
    interactions: bool = True
    seed: int = 0
    min_gain: float = 1e-4


@dataclass
class Symbolic:
    target: str
    features: list[str]
    terms: list[str]
    coef: list[float]
    intercept: float
    fills: dict[str, float]
    expressions: dict[str, Column] = field(repr=False, default_factory=dict)
    train_r2: float = float("nan")
    cv_r2: float = float("nan")

    @property
    def text(self) -> str:
        parts = [f"{self.target} = {self.intercept:.5g}"]
        for c, t in zip(self.coef, self.terms):
            parts.append(f" {'+' if c >= 0 else '-'} {abs(c):.5g}*{t}")
        return "".join(parts)

    def predict(self, df: DataFrame, name: str = "symbolic_prediction") -> DataFrame:
        total = F.lit(self.intercept)
        for c, t in zip(self.coef, self.terms):
            total = total + F.lit(c) * self.expressions[t]
        return df.withColumn(name, total)


def candidate_terms(features: list[str], fills: dict[str, float], cfg: SymbolicConfig) -> dict[str, Column]:
    """Label -> expression of every candidate term."""
    v = {f: F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(fills[f])) for f in features}
    terms: dict[str, Column] = {}
    for f, x in v.items():
        sign = F.signum(x)
        terms[f] = x
        shapes = [(cfg.square, f"{f}^2", x * x), (cfg.cube, f"{f}^3", x * x * x),
                  (cfg.sqrt, f"sign({f})*sqrt(abs({f}))", sign * F.sqrt(F.abs(x))),
                  (cfg.log, f"sign({f})*log1p(abs({f}))", sign * F.log1p(F.abs(x))),
                  (cfg.inverse, f"1/(1+abs({f}))", 1.0 / (1.0 + F.abs(x)))]
        terms.update({label: e for on, label, e in shapes if on})
    if cfg.interactions:
        for i, a in enumerate(features):
            for b in features[i + 1:]:
                terms[f"{a}*{b}"] = v[a] * v[b]
    return terms


def fit_symbolic(df: DataFrame, features: list[str], target: str, ident: str, cfg: SymbolicConfig = SymbolicConfig()) -> Symbolic:
    """Screen features by |r|, then add terms while the pooled cross-validated R2 grows.

    Two passes: one for the screen, one for the fold product matrices of all terms.
    """
    fills = descriptors.fill_values(df, features)
    filled = descriptors.impute(df, fills)
    m = linalg.moments(filled, features + [target])
    varied = [i for i in range(len(features)) if m.std_pop[i] > 1e-12]
    if not varied:
        raise ValueError("all feature columns are constant or empty")
    r = m.corr
    ranked = sorted(varied, key=lambda i: (-abs(r[i, len(features)]), i))[:max(1, cfg.max_features)]
    top = [features[i] for i in ranked]
    terms = candidate_terms(top, fills, cfg)
    labels = list(terms)
    wide = df.select(F.col(ident).alias("_id"), F.col(target).cast("double").alias("_y"),
                     *[terms[t].alias(f"t{i}") for i, t in enumerate(labels)])
    cv = regression.cross_validation(wide, [f"t{i}" for i in range(len(labels))], "_y", "_id", cfg.folds, cfg.seed)
    usable = [i for i in range(len(labels)) if cv.total.std_pop[i] > 1e-12]
    chosen: list[int] = []
    score = cv.pooled([])[0]
    while len(chosen) < cfg.max_terms:
        best, best_score = None, score
        for i in usable:
            if i in chosen:
                continue
            s = cv.pooled(chosen + [i])[0]
            if s > best_score + cfg.min_gain:
                best, best_score = i, s
        if best is None:
            break
        chosen.append(best)
        score = best_score
    coef, b0 = regression.solve(cv.total, chosen, cv.y)
    sse, sst = regression.residual_sums(cv.total, chosen, cv.y, coef, b0)
    names = [labels[i] for i in chosen]
    return Symbolic(target, top, names, [float(c) for c in coef], b0, fills, {n: terms[n] for n in names},
                    1 - sse / sst if sst > 0 else float("nan"), score)


def term_table(df: DataFrame, model: Symbolic) -> DataFrame:
    """term, coefficient, mean |contribution|."""
    if not model.terms:
        return df.sparkSession.createDataFrame([], "term string, coefficient double, mean_abs_contribution double")
    one = df.agg(*[F.avg(F.abs(F.lit(c) * model.expressions[t])).alias(f"t{i}") for i, (c, t) in enumerate(zip(model.coef, model.terms))])
    items = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.lit(c).alias("coefficient"), F.col(f"t{i}").alias("mean_abs_contribution"))
                                for i, (c, t) in enumerate(zip(model.coef, model.terms))]))
    return one.select(items.alias("i")).select("i.*")
