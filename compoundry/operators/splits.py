"""Train / validation / test splits by count, by stratum and by structure group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from compoundry.functions.skew import join_stats, with_global_rank, with_range_rank

# Seeded places are 64-bit hashes; chunks of 2^44 keep about a million places each apart.
HASH_CHUNK = 2 ** 44


def split_counts(n: int, test: float, validation: float) -> tuple[int, int]:
    """Rows for test and validation: rounded half to even, at least one each, train not empty."""
    n_test, n_val = int(round(test * n)), int(round(validation * n))
    if test > 0 and n_test == 0 and n >= 2:
        n_test = 1
    if validation > 0 and n_val == 0 and n - n_test >= 2:
        n_val = 1
    over = n_test + n_val - (n - 1)
    if n > 1 and over > 0:
        cut = min(over, n_val)
        n_val -= cut
        n_test = max(0, n_test - (over - cut))
    return max(0, n_test), max(0, n_val)


def check_fractions(test: float, validation: float) -> None:
    if test < 0 or validation < 0 or test + validation >= 1.0:
        raise ValueError("test and validation sizes must be >= 0 and sum to less than 1")


def seeded_place(ident: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(int(seed)), ident)


def random_split(df: DataFrame, ident: str, test: float = 0.2, validation: float = 0.1, seed: int = 42) -> DataFrame:
    """Exact counts per split by seeded place; repeatable for the same rows and seed."""
    check_fractions(test, validation)
    n_test, n_val = split_counts(df.count(), test, validation)
    ranked = with_global_rank(df.withColumn("_h", seeded_place(F.col(ident), seed)), "_h", "_h", "_r", chunk=HASH_CHUNK).drop("_h")
    part = F.when(F.col("_r") <= n_test, "test").when(F.col("_r") <= n_test + n_val, "validation").otherwise("train")
    return ranked.withColumn("split", part).drop("_r")


def rank_bins(df: DataFrame, value: str, ident: str, n_bins: int = 5, name: str = "bin") -> DataFrame:
    """Equal-count bins floor(rank * bins / n) of the values in ascending order (ties by id)."""
    n = df.count()
    bins = max(2, min(int(n_bins), n))
    ranked = with_global_rank(df, value, ident, "_r")
    return ranked.withColumn(name, F.floor((F.col("_r") - 1) * bins / F.lit(n)).cast("int")).drop("_r")


def stratified_split(df: DataFrame, ident: str, label: str, test: float = 0.2, validation: float = 0.1, seed: int = 42) -> DataFrame:
    """Every stratum is split by the same fractions; the counts add up exactly.

    Whole quotas per stratum, remaining rows to the largest fractional parts.  A stratum
    with a single row cannot be split: then the plain random split is used.
    """
    check_fractions(test, validation)
    rows = df.withColumn("_l", F.col(label).cast("string"))
    sizes = rows.groupBy("_l").agg(F.count(F.lit(1)).alias("_n"))
    if sizes.where(F.col("_n") < 2).limit(1).count():
        return random_split(df, ident, test, validation, seed)
    n = df.count()
    n_test, n_val = math.ceil(test * n), math.ceil(validation * n)

    def quota(sizes: DataFrame, total: int, of: str, name: str) -> DataFrame:
        share = F.col(of) * total / F.lit(max(n if of == "_n" else n - n_test, 1))
        s = sizes.withColumn("_w", F.floor(share)).withColumn("_f", share - F.floor(share))
        left = s.agg((F.lit(total) - F.sum("_w")).alias("_left"))
        # the remaining rows go to the largest fractions, by a rank over all strata however many there are
        s = with_range_rank(s, [F.desc("_f"), F.col("_l")], "_p").crossJoin(F.broadcast(left))
        return s.withColumn(name, (F.col("_w") + (F.col("_p") <= F.col("_left")).cast("int")).cast("bigint")).drop("_w", "_f", "_p", "_left")

    sizes = quota(sizes, n_test, "_n", "_t").withColumn("_m", F.col("_n") - F.col("_t"))
    sizes = quota(sizes, n_val, "_m", "_v")
    # Place inside the stratum = global seeded rank among equal labels: rank by (label, hash).
    ranked = stratum_rank(rows, "_l", ident, seed)
    joined = join_stats(ranked, sizes.select("_l", "_n", "_t", "_v"), ["_l"], "_n")
    part = F.when(F.col("_r") <= F.col("_t"), "test").when(F.col("_r") <= F.col("_t") + F.col("_v"), "validation").otherwise("train")
    return joined.withColumn("split", part).drop("_l", "_r", "_n", "_t", "_v")


def stratum_rank(rows: DataFrame, label: str, ident: str, seed: int) -> DataFrame:
    """1-based seeded position ``_r`` inside each label, spread over hash chunks."""
    from compoundry.functions.skew import with_group_rank

    hashed = rows.withColumn("_h", seeded_place(F.col(ident), seed))
    return with_group_rank(hashed, [label], "_h", "_r", chunk=HASH_CHUNK).drop("_h")


def _runs(deficit: list[float], size: int, count: int, floor_first: int = 0) -> list[tuple[int, int, list[int]]]:
    """Greedy choices for ``count`` equal groups as runs (from, to, repeating pattern).

    Always give the next group to the split that lacks most (a tie goes to train, then to
    the earlier split).  With equal sizes the choice is one split until it meets the next
    one, then a fixed cycle, so a few runs describe any number of groups.
    """
    runs, at = [], 0
    key = lambda j: (deficit[j], j == 0, -j)
    while at < count:
        order = sorted(range(len(deficit)), key=key, reverse=True)
        top, second = order[0], order[1]
        lone = int((deficit[top] - deficit[second]) // size)
        if lone > 1:
            steps = min(lone - 1, count - at)
            runs.append((at + 1, at + steps, [top]))
            deficit[top] -= steps * size
            at += steps
            continue
        # Play one window and see whether it repeats.
        pattern, start = [], list(deficit)
        for _ in range(min(len(deficit), count - at)):
            j = max(range(len(deficit)), key=key)
            pattern.append(j)
            deficit[j] -= size
        runs.append((at + 1, at + len(pattern), pattern))
        at += len(pattern)
        used = set(pattern)
        if len(used) == len(pattern) and at < count:
            # Each split of the cycle lost the same amount: the order is unchanged as
            # long as no outside split overtakes the lowest of them.
            outside = [deficit[j] for j in range(len(deficit)) if j not in used]
            low = min(deficit[j] for j in used)
            rounds = (count - at) // len(pattern)
            if outside:
                rounds = min(rounds, max(0, int((low - max(outside)) // size) - 1))
            if rounds > 0:
                runs.append((at + 1, at + rounds * len(pattern), pattern))
                for j in used:
                    deficit[j] -= rounds * size
                at += rounds * len(pattern)
    return runs


def group_split(df: DataFrame, group: str, train: float = 0.7, validation: float = 0.15, test: float = 0.15, seed: int = 42) -> DataFrame:
    """Whole groups to splits: largest first, each to the split that lacks most rows.

    The greedy pass only depends on group sizes, so the driver walks the histogram of
    sizes (at most about sqrt(2n) entries) and sends back short runs per size; groups look
    up their run by seeded position among groups of equal size.  The largest groups seed
    one split each.
    """
    total = train + validation + test
    if total <= 0:
        raise ValueError("at least one split fraction must be positive")
    names = ["train", "validation", "test"]
    fractions = [train / total, validation / total, test / total]
    groups = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    hist = groups.groupBy("_n").agg(F.count(F.lit(1)).alias("_m")).orderBy(F.desc("_n")).collect()
    n = sum(r["_n"] * r["_m"] for r in hist)
    deficit = [f * n for f in fractions]
    seeds = [j for j, f in enumerate(fractions) if f > 0]
    table: list[tuple[int, int, int, list[int]]] = []
    for r in hist:
        size, count, at = int(r["_n"]), int(r["_m"]), 0
        while seeds and at < count:
            j = seeds.pop(0)
            deficit[j] -= size
            at += 1
            table.append((size, at, at, [j]))
        table += [(size, a + at, b + at, p) for a, b, p in _runs(deficit, size, count - at)]
    spark = df.sparkSession
    # A few runs per distinct size.
    runs = spark.createDataFrame(table, "_n bigint, _from bigint, _to bigint, _pattern array<int>")
    from compoundry.functions.skew import with_group_rank

    placed = groups.withColumn("_h", F.xxhash64(F.lit(int(seed)), F.col(group)))
    placed = with_group_rank(placed, ["_n"], "_h", "_r", chunk=HASH_CHUNK)
    runs = runs.withColumnRenamed("_n", "_size")
    hit = (F.col("_n") == F.col("_size")) & F.col("_r").between(F.col("_from"), F.col("_to"))
    placed = placed.join(F.broadcast(runs), hit)
    which = F.element_at("_pattern", (F.pmod(F.col("_r") - F.col("_from"), F.size("_pattern")) + 1).cast("int"))
    placed = placed.select(group, "_n", F.element_at(F.array(*[F.lit(x) for x in names]), which + 1).alias("split"))
    out = join_stats(df, placed, [group], "_n").drop("_n")
    return out.withColumn("split", F.coalesce("split", F.lit("invalid")))


def split_summary(df: DataFrame) -> DataFrame:
    """split, count, fraction of all rows."""
    counts = df.groupBy("split").agg(F.count(F.lit(1)).alias("count"))
    total = counts.agg(F.sum("count").alias("_t"))
    return counts.crossJoin(F.broadcast(total)).select("split", "count", F.round(F.col("count") / F.col("_t"), 4).alias("fraction"))


def groups_by_split(df: DataFrame, group: str) -> DataFrame:
    """Number of groups per split and of groups that occur in several splits."""
    per = df.groupBy(group).agg(F.collect_set("split").alias("s"))
    return per.select(F.explode("s").alias("split"), (F.size("s") > 1).cast("int").alias("shared")).groupBy("split").agg(
        F.count(F.lit(1)).alias("n_groups"), F.sum("shared").alias("n_shared"))


def split_dataset(df: DataFrame, method: str, ident: str, test: float = 0.2, validation: float = 0.1, seed: int = 42,
                  target: str | None = None, group: str | None = None) -> DataFrame:
    """Split by method: random, stratified / activity_stratified (bins or labels), scaffold."""
    check_fractions(test, validation)
    method = (method or "random").strip().lower()
    if method == "random":
        return random_split(df, ident, test, validation, seed)
    if method == "scaffold":
        return group_split(df, group, 1 - test - validation, validation, test, seed)
    if method in ("stratified", "activity_stratified"):
        if target is None:
            raise ValueError("a stratified split needs a target column")
        numeric = dict(df.dtypes)[target] in ("double", "float", "int", "bigint")
        if not numeric:
            return stratified_split(df, ident, target, test, validation, seed)
        if df.where(F.col(target).isNull() | F.isnan(F.col(target).cast("double"))).limit(1).count():
            return random_split(df, ident, test, validation, seed)
        return stratified_split(rank_bins(df, target, ident, name="_bin"), ident, "_bin", test, validation, seed).drop("_bin")
    raise ValueError(f"unsupported split method: {method!r}")
