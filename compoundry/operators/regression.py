"""Linear regression family, subset selection and cross-validation from product matrices.

One pass over the data yields the product matrix of every fold.  Any subset, criterion,
penalty or fold combination is then p x p algebra on the driver; the rows are not read
again.  Means and cross products of folds combine exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from compoundry.functions import linalg
from compoundry.functions.linalg import Moments
from compoundry.functions.shuffle import returned
from compoundry.operators.validation import adjusted_r2, aic_bic
from compoundry.session import reliable_checkpoint


def with_fold(df: DataFrame, ident: str, k: int, seed: int = 0, name: str = "fold") -> DataFrame:
    """Seeded fold number per row; needs no shuffle."""
    return df.withColumn(name, F.pmod(F.xxhash64(F.lit(int(seed)), F.col(ident)), F.lit(int(k))).cast("int"))


def combine(parts: list[Moments]) -> Moments:
    """Moments of the union of disjoint row sets."""
    n = sum(p.n for p in parts)
    mean = sum(p.n * p.mean for p in parts) / max(n, 1)
    cross = sum(p.cross + p.n * np.outer(p.mean - mean, p.mean - mean) for p in parts)
    return Moments(parts[0].columns, n, mean, cross)


@dataclass
class Linear:
    """A fitted linear predictor."""

    features: list[str]
    coef: np.ndarray
    intercept: float
    target: str = "y"

    def column(self) -> Column:
        return linalg.linear_form(self.features, self.coef, self.intercept)


def solve(m: Moments, x: list[int], y: int, ridge: float = 0.0) -> tuple[np.ndarray, float]:
    """Least squares of column y on columns x (minimum norm where singular)."""
    a, b = m.cross[np.ix_(x, x)], m.cross[x, y]
    coef = np.linalg.lstsq(a + ridge * np.eye(len(x)), b, rcond=None)[0] if len(x) else np.zeros(0)
    return coef, float(m.mean[y] - coef @ m.mean[x])


def residual_sums(m: Moments, x: list[int], y: int, coef: np.ndarray, intercept: float) -> tuple[float, float]:
    """(sum of squared residuals, total sum of squares) of a fixed predictor on the rows of m."""
    c = m.cross
    shift = m.mean[y] - intercept - (coef @ m.mean[x] if len(x) else 0.0)
    quad = c[y, y] - 2 * (coef @ c[x, y] if len(x) else 0.0) + (coef @ c[np.ix_(x, x)] @ coef if len(x) else 0.0)
    return float(max(quad, 0.0) + m.n * shift * shift), float(c[y, y])


@dataclass
class CrossValidation:
    """Fold moments over features + target (the last column)."""

    features: list[str]
    folds: dict[int, Moments]
    total: Moments = field(init=False)
    rest: dict[int, Moments] = field(init=False)

    def __post_init__(self) -> None:
        self.total = combine(list(self.folds.values()))
        self.rest = {f: combine([m for g, m in self.folds.items() if g != f]) for f in self.folds} if len(self.folds) > 1 else {}

    @property
    def y(self) -> int:
        return len(self.features)

    def scores(self, subset: list[int]) -> tuple[float, float]:
        """Mean over folds of R2 and RMSE."""
        r2, rmse = [], []
        for f, test in self.folds.items():
            sse, sst = residual_sums(test, subset, self.y, *solve(self.rest[f], subset, self.y))
            r2.append(1 - sse / sst if sst > 0 else float("nan"))
            rmse.append((sse / max(test.n, 1)) ** 0.5)
        return float(np.mean(r2)), float(np.mean(rmse))

    def pooled(self, subset: list[int]) -> tuple[float, float]:
        """R2 and RMSE over all out-of-fold predictions together."""
        sse = sum(residual_sums(t, subset, self.y, *solve(self.rest[f], subset, self.y))[0] for f, t in self.folds.items())
        sst = float(self.total.cross[self.y, self.y])
        return (1 - sse / sst if sst > 1e-24 else float("nan")), (sse / max(self.total.n, 1)) ** 0.5


def cross_validation(df: DataFrame, features: list[str], target: str, ident: str, k: int = 5, seed: int = 0) -> CrossValidation:
    folds = linalg.moments(with_fold(df, ident, k, seed, "_fold"), features + [target], by="_fold")
    return CrossValidation(features, folds)


#: Criteria and whether larger is better.
CRITERIA = {"cv_r2": 1, "cv_rmse": -1, "adj_r2": 1, "aic": -1, "bic": -1, "train_r2": 1}


def _fit_many(m: Moments, index: np.ndarray, y: int) -> tuple[np.ndarray, np.ndarray]:
    """Least squares on many subsets of one size: (B, k) column numbers to coefficients and intercepts."""
    a = m.cross[index[:, :, None], index[:, None, :]]
    coef = np.einsum("bij,bj->bi", np.linalg.pinv(a, hermitian=True), m.cross[index, y])
    return coef, m.mean[y] - (coef * m.mean[index]).sum(1)


def _errors_many(m: Moments, index: np.ndarray, y: int, coef: np.ndarray, intercept: np.ndarray) -> np.ndarray:
    """Squared residuals of many fixed predictors on the rows of m."""
    a = m.cross[index[:, :, None], index[:, None, :]]
    shift = m.mean[y] - intercept - (coef * m.mean[index]).sum(1)
    quad = m.cross[y, y] - 2 * (coef * m.cross[index, y]).sum(1) + np.einsum("bi,bij,bj->b", coef, a, coef)
    return np.maximum(quad, 0.0) + m.n * shift * shift


def score_subsets(cv: CrossValidation, masks: np.ndarray, criterion: str = "cv_r2") -> np.ndarray:
    """The criterion of many feature masks at once (rows of a boolean matrix); nan where undefined.

    Masks of one size share their linear algebra, so a sweep over all neighbours of a subset
    is a few stacked matrix products.
    """
    if criterion not in CRITERIA:
        raise ValueError(f"unknown criterion: {criterion!r}")
    out, sizes, n = np.full(len(masks), np.nan), masks.sum(1), cv.total.n
    for k in np.unique(sizes):
        if k == 0 or n <= k + 1:
            continue
        who = np.flatnonzero(sizes == k)
        index = np.nonzero(masks[who])[1].reshape(len(who), int(k))
        if criterion.startswith("cv_"):
            parts = []
            for fold, test in cv.folds.items():
                sse = _errors_many(test, index, cv.y, *_fit_many(cv.rest[fold], index, cv.y))
                sst = test.cross[cv.y, cv.y]
                parts.append((1 - sse / sst if sst > 0 else np.full(len(who), np.nan)) if criterion == "cv_r2" else np.sqrt(sse / max(test.n, 1)))
            out[who] = np.mean(parts, axis=0)
            continue
        sse = _errors_many(cv.total, index, cv.y, *_fit_many(cv.total, index, cv.y))
        sst = float(cv.total.cross[cv.y, cv.y])
        for i, e in zip(who, sse, strict=True):
            r2 = 1 - e / sst if sst > 0 else float("nan")
            out[i] = {"train_r2": lambda: r2, "adj_r2": lambda: adjusted_r2(r2, n, int(k)), "aic": lambda: aic_bic(float(e), n, int(k) + 1)[0],
                      "bic": lambda: aic_bic(float(e), n, int(k) + 1)[1]}[criterion]()
    return out


@dataclass(frozen=True)
class SelectionConfig:
    """``max_features`` 0 means all. ``draws`` are the random subsets of the random search;
    ``population`` and ``generations`` belong to the evolutionary one."""

    method: str = "forward"
    criterion: str = "cv_r2"
    seed: int = 0
    max_features: int = 0
    min_features: int = 1
    draws: int = 2000
    population: int = 80
    generations: int = 60
    flips: float = 1.0


@dataclass
class Selection:
    subset: list[int]
    names: list[str]
    score: float
    history: list[tuple[str, float, list[str]]]


class _Search:
    """Scores masks as gains (larger is better, undefined last) and remembers every improvement."""

    def __init__(self, cv: CrossValidation, cfg: SelectionConfig) -> None:
        self.cv, self.cfg, self.p = cv, cfg, len(cv.features)
        self.sign = CRITERIA[cfg.criterion]
        self.low = min(max(cfg.min_features, 1), self.p)
        self.high = max(self.low, min(cfg.max_features or self.p, self.p))
        self.mask, self.gain, self.steps = np.zeros(self.p, bool), -np.inf, []

    def gains(self, masks: np.ndarray) -> np.ndarray:
        got = score_subsets(self.cv, masks, self.cfg.criterion) * self.sign
        return np.where(np.isnan(got), -np.inf, got)

    def move(self, label: str, mask: np.ndarray, gain: float) -> None:
        self.mask, self.gain = mask.copy(), float(gain)
        self.steps.append((label, self.gain * self.sign, [self.cv.features[i] for i in np.flatnonzero(mask)]))

    def offer(self, label: str, masks: np.ndarray) -> np.ndarray:
        gains = self.gains(masks)
        top = int(gains.argmax())
        if not self.steps or gains[top] > self.gain + 1e-12:
            self.move(label, masks[top], gains[top])
        return gains

    def result(self) -> Selection:
        subset = [int(i) for i in np.flatnonzero(self.mask)]
        return Selection(subset, [self.cv.features[i] for i in subset], self.gain * self.sign, self.steps)


def _stepwise(search: _Search, growing: bool) -> Selection:
    """Best single change of the subset, again and again: growing from none or shrinking from all."""
    if not growing:
        everything = np.ones(search.p, bool)
        search.move("all", everything, search.gains(everything[None])[0])
    while True:
        open_ = np.flatnonzero(search.mask != growing)
        size = int(search.mask.sum())
        if not len(open_) or (growing and size >= search.high) or (not growing and size <= search.low):
            return search.result()
        masks = np.repeat(search.mask[None], len(open_), 0)
        masks[np.arange(len(open_)), open_] = growing
        gains = search.gains(masks)
        top = int(gains.argmax())
        must = size < search.low if growing else size > search.high
        if gains[top] <= search.gain + 1e-12 and not must:
            return search.result()
        search.move(("+" if growing else "-") + search.cv.features[open_[top]], masks[top], gains[top])


def _fit_size(masks: np.ndarray, low: int, high: int, rng: np.random.Generator) -> np.ndarray:
    """Masks with sizes moved into bounds by switching random members off or others on."""
    order = np.where(masks, 1.0, 0.0) + rng.random(masks.shape)  # members first, in random order
    rank = (-order).argsort(1).argsort(1)
    return rank < np.clip(masks.sum(1), low, high)[:, None]


def _random_search(search: _Search) -> Selection:
    """Subsets of uniformly drawn sizes, scored in batches."""
    rng = np.random.default_rng(search.cfg.seed)
    for at in range(0, search.cfg.draws, 512):
        n = min(512, search.cfg.draws - at)
        sizes = rng.integers(search.low, search.high + 1, n)
        masks = rng.random((n, search.p)).argsort(1).argsort(1) < sizes[:, None]
        search.offer(f"draws {at}-{at + n - 1}", masks)
    return search.result()


def _evolve(search: _Search) -> Selection:
    """Parents are paired at random, children take each feature from either and flip about ``flips``
    features; the best of parents and children live on, equal masks once."""
    cfg, rng = search.cfg, np.random.default_rng(search.cfg.seed)
    sizes = rng.integers(search.low, search.high + 1, max(cfg.population, 4))
    living = np.unique(rng.random((len(sizes), search.p)).argsort(1).argsort(1) < sizes[:, None], axis=0)
    gains = search.offer("first population", living)
    for turn in range(cfg.generations):
        left, right = rng.permutation(len(living)), rng.permutation(len(living))
        children = np.where(rng.random(living.shape) < 0.5, living[left], living[right])
        children ^= rng.random(children.shape) < cfg.flips / search.p
        children = _fit_size(children, search.low, search.high, rng)
        fresh = search.offer(f"generation {turn + 1}", children)
        both, at = np.unique(np.concatenate([living, children]), axis=0, return_index=True)
        gains = np.concatenate([gains, fresh])[at]
        best = np.argsort(-gains, kind="stable")[: max(cfg.population, 4)]
        living, gains = both[best], gains[best]
    return search.result()


METHODS = {"forward": lambda s: _stepwise(s, True), "backward": lambda s: _stepwise(s, False), "montecarlo": _random_search, "genetic": _evolve}
#: Other spellings of the methods.
SPELLED = {"mc": "montecarlo", "monte-carlo": "montecarlo", "ga": "genetic", "genetic-algorithm": "genetic", "genetic_algorithm": "genetic"}


def select(cv: CrossValidation, cfg: SelectionConfig = SelectionConfig()) -> Selection:
    """Feature subset by the configured search; the rows are not read again."""
    method = cfg.method.lower().strip()
    method = SPELLED.get(method, method)
    if method not in METHODS:
        raise ValueError(f"unknown selection method: {cfg.method!r}")
    return METHODS[method](_Search(cv, cfg))


def vif(m: Moments) -> np.ndarray:
    """Variance inflation: diagonal of the inverse correlation matrix."""
    if len(m.columns) <= 1:
        return np.ones(len(m.columns))
    return np.minimum(np.diag(linalg.invert(m.corr)), 1e12)


def coefficient_table(spark, m: Moments, x: list[int], y: int) -> DataFrame:
    """term, coefficient, standard error, t, p, VIF of the least squares fit."""
    coef, b0 = solve(m, x, y)
    sse, _ = residual_sums(m, x, y, coef, b0)
    dof = max(m.n - len(x) - 1, 1)
    s2 = sse / dof
    inv = linalg.invert(m.cross[np.ix_(x, x)])
    mean = m.mean[x]
    var = np.concatenate([[1.0 / m.n + mean @ inv @ mean], np.diag(inv)]) * s2
    se = np.sqrt(np.maximum(var, 1e-300))
    beta = np.concatenate([[b0], coef])
    infl = [None] + [float(v) for v in vif(m.part(x))]
    names = ["intercept"] + [m.columns[i] for i in x]
    rows = [(names[i], float(beta[i]), float(se[i]), float(beta[i] / se[i]),
             linalg.t_two_sided_p(float(beta[i] / se[i]), dof), infl[i]) for i in range(len(names))]
    return spark.createDataFrame(rows, "term string, coefficient double, std_error double, t double, p_value double, vif double")


def _numbered(df: DataFrame, keep: list[str], target: str, ident: str) -> DataFrame:
    """``ident``, ``keep``, the target and ``_i``, the row number by id from 0 on, written once."""
    from compoundry.functions.skew import with_range_rank

    rows = with_range_rank(df.select(ident, *keep, target), [F.col(ident)], "_i").withColumn("_i", F.col("_i") - 1)
    return reliable_checkpoint(rows)


def _key(run, seed: int):
    return run + int(seed) * 1_000_003


def permuted_targets(df: DataFrame, keep: list[str], target: str, ident: str, n_permutations: int, seed: int = 0) -> DataFrame:
    """``ident``, ``keep``, ``_run`` (from 1 on) and the target of the row that this row is dealt in that run."""
    from compoundry.functions.shuffle import permuted

    rows = _numbered(df, keep, target, ident)
    n = rows.count()
    runs = rows.drop(target).withColumn("_run", F.explode(F.sequence(F.lit(1), F.lit(int(n_permutations)))))
    place = permuted(F.col("_i"), n, _key(F.col("_run"), seed))
    return runs.withColumn("_i", place).join(rows.select("_i", target), "_i").drop("_i")


#: Row numbers of one block times runs: what a task of the permutation test holds of dealt targets.
DEALT = 5_000_000
DEAL_ROWS = 400_000


def _planes(x: np.ndarray) -> bytes:
    """Bytes of numbers by significance, so that the exchange compresses what they share."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplaned(raw: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _deal_targets(n: int, runs: int, seed: int, block: int):
    """mapInArrow on (_i, _y): per run and block of row numbers, the targets dealt to it, packed."""
    def deal(place: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        for run in range(1, runs + 1):
            row = returned(place, n, _key(run, seed))
            order = np.argsort(row)
            row, dealt = row[order], y[order]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(row // block)) + 1, [len(row)]])
            ends = list(zip(cuts[:-1], cuts[1:], strict=True))
            steps = [np.diff(row[a:b], prepend=row[a] // block * block).astype("<u4") for a, b in ends]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row[cuts[:-1]] // block, pa.int64()), pa.array([run] * len(ends), pa.int32()),
                 pa.array([_planes(s) for s in steps], pa.binary()), pa.array([_planes(dealt[a:b]) for a, b in ends], pa.binary())],
                ["_b", "_run", "_steps", "_y"])

    def flow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_numpy(zero_copy_only=False).astype("<f8")))
                size += batch.num_rows
            if size >= DEAL_ROWS:
                yield from deal(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, size = [], 0
        if held:
            yield from deal(*(np.concatenate(x) for x in zip(*held, strict=True)))
    return flow


def _dealt_blocks(mean: np.ndarray, k: int, block: int):
    """applyInArrow on one block: its features and all targets dealt to it, as partial product blocks of run and fold."""
    def run_block(rows: pa.Table, dealt: pa.Table) -> pa.Table:
        at = rows.column("_i").to_numpy() % block
        p = len(mean)
        x = np.column_stack([rows.column(f"_x{j}").to_numpy() for j in range(p - 1)] + [np.zeros(len(at))]) - mean
        fold = rows.column("_fold").to_numpy()
        whole = ~np.isnan(x).any(1)
        x, fold, at = x[whole], fold[whole], at[whole]
        order = np.argsort(fold, kind="stable")
        x, at, fold = x[order], at[order], fold[order]
        edge = np.searchsorted(fold, np.arange(k + 1))
        by_run: dict[int, list] = {}
        for run, steps, y in zip(*(dealt.column(c).to_pylist() for c in ("_run", "_steps", "_y")), strict=True):
            by_run.setdefault(run, []).append((steps, y))
        out: list[tuple] = []
        y = np.empty(block)
        for run, parts in by_run.items():
            y.fill(np.nan)
            for steps, values in parts:
                y[np.cumsum(_unplaned(steps, "<u4").astype(np.int64))] = _unplaned(values, "<f8")
            x[:, -1] = y[at] - mean[-1]
            for f in range(k):
                z = x[edge[f] : edge[f + 1]]
                z = z[~np.isnan(z[:, -1])]
                if len(z):
                    products, sums = z.T @ z, z.sum(0)
                    out += [(run * k + f, i, len(z), sums[i], products[i]) for i in range(p)]
        columns = zip(*out, strict=True) if out else ([], [], [], [], [])
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64()))
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["g", "i", "n", "s", "row"])
    return run_block


def permutation_test(df: DataFrame, features: list[str], target: str, ident: str, n_permutations: int = 20,
                     k: int = 5, seed: int = 0) -> dict:
    """Cross-validated R2 against shuffled targets; p = (hits + 1) / (permutations + 1).

    Rows are numbered once, by id. The targets of every run go, packed, to the block of row numbers that
    holds the rows they are dealt to; features move once for all runs. All runs are reduced to fold product matrices in
    one job.
    """
    runs = int(n_permutations)
    everything = list(range(len(features)))
    observed = cross_validation(df, features, target, ident, k, seed).scores(everything)[0]
    rows = _numbered(df, features, target, ident)
    number = lambda c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan")))
    rows = with_fold(rows, ident, k, seed, "_fold").select(F.col("_i").cast("long").alias("_i"), "_fold", *[number(c).alias(f"_x{j}") for j, c in enumerate([*features, target])])
    last = f"_x{len(features)}"
    # any point near the means will do to keep large offsets from cancelling
    kept = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    got = rows.agg(F.count(F.lit(1)), *[F.avg(kept(f"_x{j}")) for j in range(len(features) + 1)]).first()
    n, around = int(got[0]), np.array([float(v) if v is not None else 0.0 for v in got[1:]])
    block = max(4096, DEALT // max(1, runs))
    dealt = rows.select("_i", last).mapInArrow(_deal_targets(n, runs, seed, block), "_b long, _run int, _steps binary, _y binary")
    blocks = rows.drop(last).withColumn("_b", F.floor(F.col("_i") / F.lit(block)).cast("long"))
    parts = blocks.groupBy("_b").cogroup(dealt.groupBy("_b")).applyInArrow(_dealt_blocks(around, k, block), linalg.BLOCK_SCHEMA)
    groups = {g: linalg.centred([*features, target], around, *v) for g, v in linalg.summed_blocks(reliable_checkpoint(parts), len(features) + 1).items()}
    found = []
    for r in range(1, runs + 1):
        folds = {f: groups[r * k + f] for f in range(k) if r * k + f in groups}
        found.append(CrossValidation(features, folds).scores(everything)[0])
    return {"q2_observed": observed, "q2_permuted": found, "p_value": (sum(q >= observed for q in found) + 1) / (len(found) + 1)}


# Penalised and latent-variable fits on z-scaled features.
def _scaled(m: Moments, x: list[int], y: int, scale: bool):
    sd = m.std_pop[x]
    sd = np.where((sd > 1e-12) & scale, sd, 1.0)
    return m.cross[np.ix_(x, x)] / np.outer(sd, sd), m.cross[x, y] / sd, sd


def fit_ridge(m: Moments, x: list[int], y: int, alpha: float = 1.0, scale: bool = True) -> Linear:
    a, b, sd = _scaled(m, x, y, scale)
    coef = np.linalg.solve(a + alpha * np.eye(len(x)), b) / sd
    return Linear([m.columns[i] for i in x], coef, float(m.mean[y] - coef @ m.mean[x]), m.columns[y])


def fit_linear(m: Moments, x: list[int], y: int, scale: bool = False) -> Linear:
    coef, b0 = solve(m, x, y)
    return Linear([m.columns[i] for i in x], coef, b0, m.columns[y])


def fit_elastic_net(m: Moments, x: list[int], y: int, alpha: float = 0.01, l1_ratio: float = 0.2, scale: bool = True,
                    iterations: int = 10_000, tol: float = 1e-10) -> Linear:
    """Coordinate descent on the product matrix: 1/(2n) |y - Xw|2 + alpha (l1 |w| + (1 - l1)/2 |w|2)."""
    a, b, sd = _scaled(m, x, y, scale)
    a, b = a / m.n, b / m.n
    w = np.zeros(len(x))
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
    for _ in range(iterations):
        change = 0.0
        for j in range(len(x)):
            r = b[j] - a[j] @ w + a[j, j] * w[j]
            new = np.sign(r) * max(abs(r) - l1, 0.0) / (a[j, j] + l2) if a[j, j] + l2 > 0 else 0.0
            change = max(change, abs(new - w[j]))
            w[j] = new
        if change <= tol:
            break
    coef = w / sd
    return Linear([m.columns[i] for i in x], coef, float(m.mean[y] - coef @ m.mean[x]), m.columns[y])


def fit_pls(m: Moments, x: list[int], y: int, components: int = 2, scale: bool = True) -> Linear:
    """Single-response partial least squares by deflating the product matrices."""
    a, b, sd = _scaled(m, x, y, scale)
    a, s = a.copy(), b.copy()
    w_all, p_all, q_all, r_all = [], [], [], []
    for _ in range(min(components, len(x))):
        norm = np.linalg.norm(s)
        if norm < 1e-12:
            break
        w = s / norm
        r = w.copy()
        for p_old, r_old in zip(p_all, r_all):
            r -= (p_old @ w) * r_old
        tt = r @ a @ r
        if tt < 1e-12:
            break
        p, q = a @ r / tt, (b @ r) / tt
        s = s - p * q * tt
        w_all.append(w), p_all.append(p), q_all.append(q), r_all.append(r)
    coef = (np.array(r_all).T @ np.array(q_all) if r_all else np.zeros(len(x))) / sd
    return Linear([m.columns[i] for i in x], coef, float(m.mean[y] - coef @ m.mean[x]), m.columns[y])


def f_regression(m: Moments, x: list[int], y: int) -> np.ndarray:
    """Univariate F statistic per feature; constant features score 0."""
    sxx, syy = np.diag(m.cross)[x], m.cross[y, y]
    scale = np.sqrt(np.maximum(sxx * syy, 0.0))
    r2 = np.divide(m.cross[x, y], scale, out=np.zeros(len(x)), where=scale > 0) ** 2
    return np.where(r2 >= 1, np.inf, r2 / np.maximum(1 - r2, 1e-300) * max(m.n - 2, 1))


def select_k_best(m: Moments, x: list[int], y: int, k: int) -> list[int]:
    f = f_regression(m, x, y)
    order = sorted(range(len(x)), key=lambda i: (-f[i], i))[:k]
    return sorted(x[i] for i in order)


@dataclass
class PrincipalAxes:
    columns: list[str]
    mean: np.ndarray
    axes: np.ndarray
    explained: list[float]

    def scores(self, df: DataFrame, prefix: str = "PC") -> DataFrame:
        cols = {}
        for k, axis in enumerate(self.axes):
            cols[f"{prefix}{k + 1}"] = linalg.linear_form(self.columns, axis, -float(axis @ self.mean))
        return df.withColumns(cols)


def principal_axes(df: DataFrame, columns: list[str], n: int = 2) -> PrincipalAxes:
    """Centred principal axes from the product matrix; each axis' largest weight is positive."""
    m = linalg.moments(df, columns)
    if m.n == 0:
        raise ValueError("no complete rows to project")
    values, vectors = np.linalg.eigh(m.cross / max(m.n - 1, 1))
    order = np.argsort(-values)[:max(1, min(n, len(columns), m.n))]
    axes = vectors[:, order].T
    axes = axes * np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])[:, None]
    total = values.sum()
    return PrincipalAxes(columns, m.mean, axes, [float(values[i] / total) if total > 0 else 0.0 for i in order])
