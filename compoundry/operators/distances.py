"""Distance tables between rows of numeric vectors.

``distance_pairs`` is the full matrix, a product by definition. ``within`` returns the pairs up to a
threshold (or the nearest few of them) from a pivot index: in a metric space the distances of two
rows to a pivot differ by no more than their own distance, so rows are dealt into shells around
one pivot, a shell meets its neighbours only, and the other pivots rule out pairs before a
distance is computed. Nothing but hits leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compoundry.functions import blocks, linalg
from compoundry.session import reliable_checkpoint

METRICS = {
    "euclidean": lambda d, a, b: np.sqrt((d ** 2).sum(-1)),
    "cityblock": lambda d, a, b: np.abs(d).sum(-1),
    "chebyshev": lambda d, a, b: np.abs(d).max(-1),
    "cosine": lambda d, a, b: 1 - (a @ b.T) / np.maximum(np.sqrt((a ** 2).sum(-1))[:, None] * np.sqrt((b ** 2).sum(-1))[None, :], 1e-300),
}
CHUNK = 512


def normalise(df: DataFrame, cols: list[str]) -> DataFrame:
    """z-scores of the columns; missing values take the mean (a z-score of 0)."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols])
    out = df.crossJoin(F.broadcast(stats))
    z = lambda c: F.coalesce((F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0), F.lit(0.0))
    return out.withColumns({c: z(c) for c in cols}).drop(*[f"{p}_{c}" for p in "ms" for c in cols])


def distance_pairs(left: DataFrame, right: DataFrame | None, ident: str, x: str, metrics: tuple[str, ...] = ("euclidean",)) -> DataFrame:
    """i, j and one distance column per metric: the full matrix in long form.

    The result is the product of both sides by definition.  Rows are dealt into blocks of
    about ``CHUNK`` vectors; every block of the left meets every block of the right once,
    on equal keys, and distances are computed per block pair.
    """
    self_join = right is None
    right = left if self_join else right
    n_left, n_right = left.count(), right.count()
    lanes_l, lanes_r = max(1, -(-n_left // CHUNK)), max(1, -(-n_right // CHUNK))

    def packed(df: DataFrame, lanes: int, side: str) -> DataFrame:
        lane = F.pmod(F.xxhash64(ident), F.lit(lanes)).cast("int").alias(f"lane_{side}")
        return df.groupBy(lane).agg(F.collect_list(F.struct(F.col(ident).cast("bigint").alias("id"), F.col(x).alias("x"))).alias(f"items_{side}"))

    a = packed(left, lanes_l, "l").withColumn("lane_r", F.explode(F.sequence(F.lit(0), F.lit(lanes_r - 1))))
    both = a.join(packed(right, lanes_r, "r"), "lane_r").select("items_l", "items_r")

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                va = np.array([i["x"] for i in row.items_l], dtype=float)
                vb = np.array([i["x"] for i in row.items_r], dtype=float)
                ia = np.array([i["id"] for i in row.items_l])
                ib = np.array([i["id"] for i in row.items_r])
                diff = va[:, None, :] - vb[None, :, :]
                cols = {"i": np.repeat(ia, len(ib)), "j": np.tile(ib, len(ia))}
                cols.update({m: METRICS[m](diff, va, vb).ravel() for m in metrics})
                out = pd.DataFrame(cols)
                yield out[out["i"] < out["j"]] if self_join else out

    return both.mapInPandas(run, "i bigint, j bigint, " + ", ".join(f"{m} double" for m in metrics))


#: Metrics of the pivot index: how rows are prepared, the metric of the prepared rows, and how a
#: threshold and a distance translate (in, out). Angles are Euclidean distances of unit vectors.
_same = (lambda t: t, lambda d: d)
_angle = (lambda t: float(np.sqrt(2 * t)), lambda d: d * d / 2)
PIVOT_METRICS = {
    "euclidean": (None, "euclidean", *_same), "cityblock": (None, "cityblock", *_same), "chebyshev": (None, "chebyshev", *_same),
    "hamming": (None, "hamming", *_same), "jaccard": (None, "jaccard", *_same),
    "cosine": ("unit", "euclidean", *_angle), "pearson": ("centred", "euclidean", *_angle), "spearman": ("ranked", "euclidean", *_angle),
}


def _prepared(x: np.ndarray, how: str | None) -> np.ndarray:
    """Rows as the metric sees them; a row without direction becomes NaN and meets nothing."""
    if how is None:
        return x
    if how == "ranked":
        x = pd.DataFrame(x).rank(axis=1).to_numpy()
    if how in ("centred", "ranked"):
        x = x - x.mean(1, keepdims=True)
    norm = np.sqrt((x ** 2).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.full_like(x, np.nan), where=norm > 1e-12)


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows that stand beside one another (broadcast over leading axes)."""
    if metric == "euclidean":
        return np.sqrt(((a - b) ** 2).sum(-1))
    if metric == "cityblock":
        return np.abs(a - b).sum(-1)
    if metric == "chebyshev":
        return np.abs(a - b).max(-1)
    if metric == "hamming":
        return (a != b).mean(-1)
    either = ((a != 0) | (b != 0)).sum(-1)
    both = ((a != 0) & (b != 0)).sum(-1)
    return np.where(either > 0, 1 - both / np.maximum(either, 1), 0.0)


PIVOTS, PIVOT_SAMPLE, SHELLS = 4, 256, 4096
#: Vectors of this length on are sieved by a matrix product, as pivots rule out little there. Blocks grow with the table up
#: to a limit, so that the number of their pairs, and with it what is shuffled, grows with the rows up to about a million.
PRODUCT_FROM, BLOCKS, MOST_BLOCK_ROWS = 8, 64, 16_384


def _pivots(rows: DataFrame, metric: str) -> np.ndarray:
    """Rows far from one another, taken from a sample of ``PIVOT_SAMPLE`` rows; any choice gives the same result."""
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOT_SAMPLE).collect()
    x = np.array([r["x"] for r in sample], float)
    chosen, least = [0], _distances(x, x[0], metric)
    while len(chosen) < min(PIVOTS, len(x)):
        chosen.append(int(least.argmax()))
        least = np.minimum(least, _distances(x, x[chosen[-1]], metric))
    return x[chosen]


def within(left: DataFrame, right: DataFrame | None, ident: str, x: str, threshold: float, metric: str = "euclidean",
           nearest: int | None = None) -> DataFrame:
    """i, j, distance of all pairs with distance <= ``threshold``, exact; ``right=None`` gives i < j within one table.

    With ``nearest`` every i keeps its nearest so many (ties: smaller j), within one table among all others; a block keeps
    a list per row and no pair beyond it leaves a task. Metrics: see ``PIVOT_METRICS``; jaccard compares the places that are not zero, the angular ones (1 - r)
    take thresholds below 1. Vectors have one length; rows that are null or hold null, NaN or infinity, and for angular
    metrics rows without a direction, meet nothing. Empty tables give no pair.
    """
    how, inner, into, out_of = PIVOT_METRICS[metric]
    if threshold < 0 or (how and threshold >= 1):
        raise ValueError("a threshold is not negative, and below 1 for angular metrics")
    self_join = right is None
    limit = into(threshold)
    blur = 1e-12 if how else 0.0  # angles come back from unit vectors, other distances are as the metric gives them

    @F.pandas_udf("array<double>")
    def prepare(v: pd.Series) -> pd.Series:
        good = [a is not None and len(a) > 0 and np.isfinite(np.asarray(a, float)).all() for a in v]
        done = [None] * len(v)
        if any(good):
            made = _prepared(np.array([np.asarray(a, float) for a, g in zip(v, good, strict=True) if g]), how)
            for i, row in zip(np.flatnonzero(good), made, strict=True):
                done[i] = row if np.isfinite(row).all() else None
        return pd.Series(done, dtype=object)

    ready = lambda d: d.select(F.col(ident).cast("bigint").alias("id"), prepare(F.col(x)).alias("x")).where(F.col("x").isNotNull())
    schema = "i bigint, j bigint, distance double"
    lhs = reliable_checkpoint(ready(left))
    rhs = lhs if self_join else reliable_checkpoint(ready(right))
    if lhs.isEmpty() or rhs.isEmpty():
        return left.sparkSession.createDataFrame([], schema)
    pivots = _pivots(lhs, inner)

    @F.pandas_udf("array<double>")
    def to_pivots(v: pd.Series) -> pd.Series:
        rows = np.stack(v.to_numpy())
        return pd.Series(list(_distances(rows[:, None, :], pivots[None, :, :], inner)))

    def shelled(d: DataFrame, width: float) -> DataFrame:
        return d.withColumn("p", to_pivots("x")).select("id", "x", "p", F.floor(F.col("p")[0] / F.lit(width)).alias("cell"))

    far = lhs.select(to_pivots("x")[0].alias("d")).agg(F.max("d")).first()[0] if self_join else max(
        d.select(to_pivots("x")[0].alias("d")).agg(F.max("d")).first()[0] for d in (lhs, rhs))
    # a shell is at least as thick as the threshold; their number is bounded
    width = max(limit * (1 + 1e-9), far / SHELLS, 1e-12)
    slack = limit + 1e-9 * (1 + far)

    def sifted(ids_a: np.ndarray, a: list, ids_b: np.ndarray, b: list, most: np.ndarray, same: bool) -> Iterator[tuple]:
        """Places in a and b, inner and outer distance of the pairs within ``most`` (inner, by row of a) and the threshold."""
        wide = inner == "euclidean" and a[0].shape[1] >= PRODUCT_FROM
        if wide:  # one matrix product sieves with a margin, the distances decide
            n_a, n_b, turned = (a[0] ** 2).sum(1), (b[0] ** 2).sum(1), np.ascontiguousarray(b[0].T)
        for lo in range(0, len(ids_a), 256):
            part = slice(lo, lo + 256)
            bound = most[part][:, None] + (slack - limit)
            if wide:
                both = n_a[part][:, None] + n_b[None, :]
                near = both - 2 * (a[0][part] @ turned) <= bound * bound + 1e-9 * both
            else:
                near = np.abs(a[1][part, 0][:, None] - b[1][:, 0][None, :]) <= bound
                for k in range(1, len(pivots)):
                    near &= np.abs(a[1][part, k][:, None] - b[1][:, k][None, :]) <= bound
            if same:
                near &= ids_a[part][:, None] < ids_b[None, :]
            i, j = np.nonzero(near)
            for at in range(0, len(i), 65_536):
                m, n = i[at : at + 65_536] + lo, j[at : at + 65_536]
                e = _distances(a[0][m], b[0][n], inner)
                d = out_of(e)
                hit = d <= threshold + blur
                yield m[hit], n[hit], e[hit], d[hit]

    def compare(_: int, ids_a: np.ndarray, a: list, ids_b: np.ndarray, b: list, same: bool) -> pd.DataFrame:
        found = [(ids_a[m], ids_b[n], d) for m, n, _, d in sifted(ids_a, a, ids_b, b, np.full(len(ids_a), limit), same)]
        first, second, d = (np.concatenate([f[k] for f in found]) if found else np.zeros(0) for k in range(3))
        if self_join:
            first, second = np.minimum(first, second), np.maximum(first, second)
        return pd.DataFrame({"i": first.astype(np.int64), "j": second.astype(np.int64), "distance": d})

    def fold(ids_a: np.ndarray, a: list, others: Iterator[tuple]) -> pd.DataFrame:
        most = np.full(len(ids_a), limit)
        who, whom, inside, how = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        for ids_b, b in others:
            # parts of the other block, so that lists fill and reach less far before the next part is met
            for at in range(0, len(ids_b), 256):
                seen = slice(at, at + 256)
                for m, n, e, d in sifted(ids_a, a, ids_b[seen], [v[seen] for v in b], most, False):
                    other = ids_b[seen][n]
                    if self_join:
                        apart = ids_a[m] != other
                        m, other, e, d = m[apart], other[apart], e[apart], d[apart]
                    who, whom, inside, how = (np.concatenate(v) for v in ((who, m), (whom, other), (inside, e), (how, d)))
                    order = np.lexsort((whom, how, who))
                    order = order[np.arange(len(who)) - np.searchsorted(who[order], who[order]) < nearest]
                    who, whom, inside, how = who[order], whom[order], inside[order], how[order]
                last = np.flatnonzero(np.arange(len(who)) - np.searchsorted(who, who) == nearest - 1)
                most[who[last]] = inside[last]
        return pd.DataFrame({"i": ids_a[who], "j": whom, "distance": how})

    count = max(lhs.count(), 1 if self_join else rhs.count())
    block_rows = min(max(blocks.BLOCK_ROWS, -(-count // BLOCKS)), MOST_BLOCK_ROWS)
    if nearest is not None:
        if int(nearest) < 1:
            return left.sparkSession.createDataFrame([], schema)
        nearest = int(nearest)
        reach = lambda cell: F.sequence(F.greatest(cell - 1, F.lit(0)), cell + 1)
        return blocks.strips(shelled(lhs, width), shelled(rhs, width), ["x", "p"], reach, fold, schema, block_rows)
    reach = lambda cell: F.sequence(cell if self_join else F.greatest(cell - 1, F.lit(0)), cell + 1)
    return blocks.meet(shelled(lhs, width), None if self_join else shelled(rhs, width), ["x", "p"], reach, compare, schema, block_rows)


def column_distances(df: DataFrame, cols: list[str], absolute: bool = False) -> DataFrame:
    """1 - r (or 1 - |r|) between columns, long form."""
    r = linalg.moments(df, cols).corr
    rows = [(a, b, float(1 - (abs(r[i, j]) if absolute else r[i, j])))
            for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j]
    return df.sparkSession.createDataFrame(rows, "a string, b string, distance double")
