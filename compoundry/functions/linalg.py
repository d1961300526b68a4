"""Feature moments by distributed aggregation; the p x p algebra is done on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# p x p doubles on the driver: 4,096 features are 128 MB.
MAX_FEATURES = 4096


@dataclass
class Moments:
    """Row count, means and the centred cross-product matrix of a feature list."""

    columns: list[str]
    n: int
    mean: np.ndarray
    cross: np.ndarray

    @property
    def std_pop(self) -> np.ndarray:
        return np.sqrt(np.maximum(np.diag(self.cross) / max(self.n, 1), 0.0))

    @property
    def corr(self) -> np.ndarray:
        d = np.sqrt(np.maximum(np.diag(self.cross), 0.0))
        scale = np.outer(d, d)
        out = np.divide(self.cross, scale, out=np.zeros_like(self.cross), where=scale > 0)
        np.fill_diagonal(out, 1.0)
        return np.clip(out, -1.0, 1.0)

    def part(self, idx: list[int]) -> "Moments":
        return Moments([self.columns[i] for i in idx], self.n, self.mean[idx], self.cross[np.ix_(idx, idx)])


def invert(a: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.inv(a)
    except np.linalg.LinAlgError:
        return np.linalg.pinv(a)


def _cross_products(rows: DataFrame, cols: list[str], mean: np.ndarray, by: str | None) -> dict:
    """Per-partition centred Gram blocks, summed by (group, i, j) on the cluster."""
    p = len(cols)

    def block(batches):
        acc: dict = {}
        for pdf in batches:
            groups = pdf.groupby(by) if by else [(0, pdf)]
            for g, part in groups:
                x = part[cols].to_numpy(dtype=float) - mean
                have = acc.setdefault(int(g), [0, np.zeros((p, p)), np.zeros(p)])
                have[0] += len(x)
                have[1] += x.T @ x
                have[2] += x.sum(axis=0)
        for g, (n, xtx, s) in acc.items():
            for i in range(p):
                yield pd.DataFrame({"g": [g], "i": [i], "n": [n], "s": [s[i]], "row": [xtx[i].tolist()]})

    return summed_blocks(rows.mapInPandas(block, BLOCK_SCHEMA), p)


#: One row of a partial Gram block: group, row number, rows counted, sum, products with all columns.
BLOCK_SCHEMA = "g int, i int, n bigint, s double, row array<double>"


def summed_blocks(parts: DataFrame, p: int) -> dict:
    """Count, sums and products per group, from rows of ``BLOCK_SCHEMA`` added up on the cluster."""
    head = parts.groupBy("g", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    body = (parts.select("g", "i", F.posexplode("row").alias("j", "v")).groupBy("g", "i", "j")
            .agg(F.sum("v").alias("v")))
    joined = body.join(head, ["g", "i"]).toPandas()
    out = {}
    for g, t in joined.groupby("g"):
        m = np.zeros((p, p))
        m[t["i"], t["j"]] = t["v"]
        first = t.drop_duplicates("i").sort_values("i")
        out[int(g)] = (int(first["n"].iloc[0]), first["s"].to_numpy(), m)
    return out


def moments(df: DataFrame, cols: list[str], by: str | None = None):
    """Moments over complete numeric rows; with ``by`` a dict per small group number.

    Two passes: means first, then products of centred values, so that large offsets
    do not cancel.
    """
    if len(cols) > MAX_FEATURES:
        raise ValueError(f"{len(cols)} features exceed the {MAX_FEATURES} of a driver-side matrix")
    safe = [f"_x{i}" for i in range(len(cols))]
    keep = [F.col(by).cast("int").alias("_g")] if by else []
    rows = df.select(*keep, *[F.col(f"`{c}`").cast("double").alias(s) for c, s in zip(cols, safe)]).na.drop("any")
    mean = np.array([float(v) if v is not None else 0.0 for v in rows.agg(*[F.avg(s) for s in safe]).first()])
    if len(cols) <= 40:
        groups = _cross_sql(rows, safe, mean, "_g" if by else None)
    else:
        groups = _cross_products(rows, safe, mean, "_g" if by else None)
    done = {g: centred(cols, mean, *v) for g, v in groups.items()}
    if by:
        return done
    return done.get(0, Moments(list(cols), 0, mean, np.zeros((len(cols), len(cols)))))


def centred(cols: list[str], around: np.ndarray, n: int, s: np.ndarray, m: np.ndarray) -> Moments:
    """Moments from the count, sums and products of values around any point."""
    shift = s / max(n, 1)
    return Moments(list(cols), n, around + shift, m - n * np.outer(shift, shift))


def _cross_sql(rows: DataFrame, cols: list[str], mean: np.ndarray, by: str | None) -> dict:
    """The same products as plain sums: stays in generated code for few features."""
    x = [F.col(c) - F.lit(float(m)) for c, m in zip(cols, mean)]
    p = len(cols)
    sums = [F.sum(v).alias(f"s{i}") for i, v in enumerate(x)]
    prods = [F.sum(x[i] * x[j]).alias(f"m{i}_{j}") for i in range(p) for j in range(i, p)]
    g = F.col(by) if by else F.lit(0)
    out = {}
    for r in rows.groupBy(g.alias("g")).agg(F.count(F.lit(1)).alias("n"), *sums, *prods).collect():
        m = np.zeros((p, p))
        for i in range(p):
            for j in range(i, p):
                m[i, j] = m[j, i] = r[f"m{i}_{j}"]
        out[int(r["g"])] = (int(r["n"]), np.array([r[f"s{i}"] for i in range(p)]), m)
    return out


def quadratic_form(cols: list[str], center: np.ndarray, matrix: np.ndarray) -> Column:
    """(x - c)' M (x - c) as an expression; a vectorised function for many features."""
    d = [F.col(f"`{c}`") - F.lit(float(m)) for c, m in zip(cols, center)]
    p = len(cols)
    if p <= 16:
        total = None
        for i in range(p):
            for j in range(i, p):
                w = float(matrix[i, j] + matrix[j, i]) if i != j else float(matrix[i, i])
                term = d[i] * d[j] * F.lit(w)
                total = term if total is None else total + term
        return total
    mat, mid = np.asarray(matrix), np.asarray(center)

    @F.pandas_udf("double")
    def form(*parts: pd.Series) -> pd.Series:
        x = np.column_stack([s.to_numpy(dtype=float) for s in parts]) - mid
        return pd.Series(np.einsum("ij,jk,ik->i", x, mat, x))

    return form(*[F.col(f"`{c}`") for c in cols])


def linear_form(cols: list[str], weights, intercept: float = 0.0) -> Column:
    total = F.lit(float(intercept))
    for c, w in zip(cols, weights):
        total = total + F.col(f"`{c}`") * F.lit(float(w))
    return total


# Distribution functions (series and continued fractions; there is no scipy here).
def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    import math

    if x <= 0:
        return 0.0
    log_front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return total * math.exp(log_front)
    b = x + 1 - a
    c, d = 1e308, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        step = d * c
        h *= step
        if abs(step - 1) < 1e-16:
            break
    return 1.0 - math.exp(log_front) * h


def chi2_quantile(q: float, df: int) -> float:
    """Chi-square quantile by bisection on the distribution function."""
    low, high = 0.0, max(10.0, 10.0 * df)
    while gamma_p(df / 2, high / 2) < q:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if gamma_p(df / 2, mid / 2) < q else (low, mid)
    return (low + high) / 2


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function (Lentz continued fraction)."""
    import math

    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_i(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log(1 - x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(10_000):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + num * d
        d = 1 / (d if abs(d) > tiny else tiny)
        c = 1 + num / (c if abs(c) > tiny else tiny)
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def t_two_sided_p(t: float, dof: int) -> float:
    return beta_i(dof / 2, 0.5, dof / (dof + t * t))
