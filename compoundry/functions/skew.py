"""Grouped statistics and ranks that stay spread out when one key is hot.

One identity key may hold a third of all rows.  A plain window over such a key
puts those rows into one task.  These helpers only ever window over

* pre-aggregated tables, whose rows per key are bounded, or
* chunks of a key, whose rows are bounded by construction,

so the work per task does not grow with the size of the hottest key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 1_000_000
SALTS = 64


def null_safe(keys: list[str], left: DataFrame, right: DataFrame) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def hot_key_table(counts: DataFrame, keys: list[str], count_col: str,
                  hot_rows: int = CHUNK_ROWS, most: int = 10_000) -> DataFrame | None:
    """Keys with more than ``hot_rows`` members as a small table, None when there are none.

    The table is proven small before it is used: while more than ``most`` keys pass,
    the limit is raised tenfold.
    """
    limit = hot_rows
    while True:
        found = counts.where(F.col(count_col) > limit).select(*keys).take(most + 1)
        if len(found) <= most:
            break
        limit *= 10
    if not found:
        return None
    schema = counts.select(*keys).schema
    return counts.sparkSession.createDataFrame([tuple(r) for r in found], schema)


def join_stats(rows: DataFrame, stats: DataFrame, keys: list[str], count_col: str,
               hot_rows: int = CHUNK_ROWS, salts: int = SALTS, how: str = "left", counts: DataFrame | None = None) -> DataFrame:
    """Attach one-row-per-key ``stats`` to ``rows`` without gathering a hot key.

    ``counts`` names a written table with ``keys`` and ``count_col`` where ``stats`` itself is dear to compute.

    Without a hot key this is a plain join.  Rows of a hot key are dealt out over
    ``salts`` sub-keys and the single stats row of that key is copied to each.
    """
    def renamed(df: DataFrame, extra: list[str] = []) -> DataFrame:
        return df.select(*[F.col(k).alias(f"_r_{k}") for k in keys + extra],
                         *[c for c in df.columns if c not in keys + extra])

    def on(left: DataFrame, right: DataFrame, extra: list[str] = []) -> Column:
        return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_r_{k}"]) for k in keys + extra])

    hot = hot_key_table(stats if counts is None else counts, keys, count_col, hot_rows)
    if hot is None:
        right = renamed(stats)
        return rows.join(right, on(rows, right), how).drop(*[f"_r_{k}" for k in keys])
    mark = F.broadcast(renamed(hot.withColumn("_hot", F.lit(True))))
    drop_keys = [f"_r_{k}" for k in keys]
    left = rows.join(mark, on(rows, mark), "left").drop(*drop_keys)
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")
    left = left.withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(F.lit(0))).drop("_hot")
    right = stats.join(mark, on(stats, mark), "left").drop(*drop_keys)
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = renamed(right.withColumn("_salt", F.explode(copies)).drop("_hot"), ["_salt"])
    return left.join(right, on(left, right, ["_salt"]), how).drop("_salt", "_r__salt", *drop_keys)


def with_group_rank(df: DataFrame, keys: list[str], order: str, rank_col: str,
                    count_col: str | None = None, chunk: int = CHUNK_ROWS) -> DataFrame:
    """1-based position inside each key by a unique whole-number ``order`` column.

    The key is cut into chunks of ``chunk`` consecutive order values, so no window
    partition holds more than ``chunk`` rows.  The offset of a chunk is a running
    sum over the per-chunk counts, a table reduced before any shuffle.
    ``count_col`` adds the size of the whole group.
    """
    df = df.withColumn("_rk_chunk", F.floor(F.col(order) / F.lit(chunk)))
    counts = df.groupBy(*keys, "_rk_chunk").agg(F.count(F.lit(1)).alias("_rk_n"))
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy("_rk_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_rk_before", F.coalesce(F.sum("_rk_n").over(before), F.lit(0)))
    if count_col:
        offsets = offsets.withColumn(count_col, F.sum("_rk_n").over(by_key))
    offsets = offsets.drop("_rk_n")
    renamed = offsets.select(*[F.col(k).alias(f"_o_{k}") for k in keys + ["_rk_chunk"]],
                             *[c for c in offsets.columns if c not in keys + ["_rk_chunk"]])
    cond = reduce(lambda a, b: a & b, [df[k].eqNullSafe(renamed[f"_o_{k}"]) for k in keys + ["_rk_chunk"]])
    joined = df.join(renamed, cond).drop(*[f"_o_{k}" for k in keys + ["_rk_chunk"]])
    inside = Window.partitionBy(*keys, "_rk_chunk").orderBy(order)
    ranked = joined.withColumn(rank_col, (F.col("_rk_before") + F.row_number().over(inside)).cast("bigint"))
    return ranked.drop("_rk_chunk", "_rk_before")


MAX_BUCKETS = 20_000


def bucket_number(n_rows: int, per_bucket: int = CHUNK_ROWS) -> int:
    """Buckets for a table of this size: about a million rows each, between 16 and 20,000."""
    return int(min(MAX_BUCKETS, max(16, n_rows // per_bucket)))


def with_bucket(df: DataFrame, value: str, name: str, buckets: int) -> DataFrame:
    """Bucket number of a double column by approximate quantile cuts (nulls come last).

    The cuts are a bounded list; each row finds its bucket by binary search.
    """
    from pyspark.ml.feature import Bucketizer

    probs = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(df.where(F.col(value).isNotNull()).approxQuantile(value, probs, 1.0 / (4 * buckets))))
    inf = float("inf")
    splits = [-inf] + [c for c in cuts if -inf < c < inf] + [inf]
    if len(splits) == 2:
        splits.insert(1, 0.0)
    cell = Bucketizer(splits=splits, inputCol=value, outputCol=name, handleInvalid="keep")
    return cell.transform(df).withColumn(name, F.col(name).cast("int"))


def with_global_rank(df: DataFrame, value: str, tie: str, rank_col: str,
                     descending: bool = False, buckets: int | None = None, chunk: int = CHUNK_ROWS) -> DataFrame:
    """1-based position over the whole table by (value, unique whole-number tie).

    Values are cut into quantile buckets, equal values into chunks of the tie
    column; offsets come from running sums over those counts.  Nothing is sorted in
    a single task.
    """
    key = (-F.col(value) if descending else F.col(value)).cast("double")
    # Missing values come last; as NaN they also meet themselves in the joins below.
    df = df.withColumn("_gr_v", F.coalesce(key, F.lit(float("nan"))))
    df = with_bucket(df, "_gr_v", "_gr_b", buckets or bucket_number(df.count()))
    df = df.withColumn("_gr_c", F.floor(F.col(tie) / F.lit(chunk)))
    cells = df.groupBy("_gr_b", "_gr_v", "_gr_c").agg(F.count(F.lit(1)).alias("_gr_n"))
    per_bucket = df.groupBy("_gr_b").agg(F.count(F.lit(1)).alias("_gr_bn"))
    # At most `buckets` rows: the only single-partition window.
    before = Window.orderBy("_gr_b").rowsBetween(Window.unboundedPreceding, -1)
    bucket_offset = per_bucket.select("_gr_b", F.coalesce(F.sum("_gr_bn").over(before), F.lit(0)).alias("_gr_boff"))
    inside = Window.partitionBy("_gr_b").orderBy("_gr_v", "_gr_c").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_gr_coff", F.coalesce(F.sum("_gr_n").over(inside), F.lit(0))).drop("_gr_n")
    joined = df.join(cells, ["_gr_b", "_gr_v", "_gr_c"]).join(F.broadcast(bucket_offset), "_gr_b")
    rows = Window.partitionBy("_gr_b", "_gr_v", "_gr_c").orderBy(tie)
    ranked = joined.withColumn(rank_col, (F.col("_gr_boff") + F.col("_gr_coff") + F.row_number().over(rows)).cast("bigint"))
    return ranked.drop("_gr_b", "_gr_v", "_gr_c", "_gr_boff", "_gr_coff")


def with_range_rank(df: DataFrame, order: list, name: str) -> DataFrame:
    """1-based position over the whole table by any sort columns: a row number per range plus the rows before it.

    No tie column is needed and no window holds rows; equal rows share out their positions.
    """
    from compoundry.session import reliable_checkpoint

    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_rr_id", F.monotonically_increasing_id())
    dealt = reliable_checkpoint(dealt).withColumn("_rr_part", F.shiftright("_rr_id", 33))
    per = dealt.groupBy("_rr_part").agg(F.min("_rr_id").alias("_low"), F.count(F.lit(1)).alias("_n"))
    # As many rows as the exchange has ranges: the only single-partition window.
    before = F.sum("_n").over(Window.orderBy("_rr_part").rowsBetween(Window.unboundedPreceding, -1))
    shift = per.select("_rr_part", (F.coalesce(before, F.lit(0)) - F.col("_low") + 1).alias("_rr_shift"))
    return dealt.join(F.broadcast(shift), "_rr_part").withColumn(name, F.col("_rr_id") + F.col("_rr_shift")).drop("_rr_id", "_rr_part", "_rr_shift")


def running_counts(hist: DataFrame, group: str, value: str, count: str, name: str) -> DataFrame:
    """``name``: rows of the same group below each value of a (group, value, count) table; null values come last.

    One range exchange by (group, value) serves all groups; a window holds the values of one range.
    """
    from compoundry.session import reliable_checkpoint

    order = [F.col(group), F.col(value).asc_nulls_last()]
    dealt = reliable_checkpoint(hist.repartitionByRange(*order).withColumn("_rc_part", F.spark_partition_id()))
    per = dealt.groupBy(group, "_rc_part").agg(F.sum(count).alias("_rc_n"))
    before = Window.partitionBy(group).orderBy("_rc_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(F.col(group).alias("_rc_g"), F.col("_rc_part").alias("_rc_p"), F.coalesce(F.sum("_rc_n").over(before), F.lit(0)).alias("_rc_off"))
    inside = Window.partitionBy(group, "_rc_part").orderBy(order[1]).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn("_rc_in", F.coalesce(F.sum(count).over(inside), F.lit(0)))
    out = out.join(offsets, out[group].eqNullSafe(F.col("_rc_g")) & (F.col("_rc_part") == F.col("_rc_p")))
    return out.withColumn(name, F.col("_rc_off") + F.col("_rc_in")).drop("_rc_part", "_rc_in", "_rc_g", "_rc_p", "_rc_off")


def hottest_group(df: DataFrame, keys: list[str]) -> int:
    """Size of the largest group (one reduced job)."""
    row = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("m")).first()
    return int(row["m"] or 0)


def group_quantiles(df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float],
                    hot_rows: int = CHUNK_ROWS, buckets: int | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles per group, one column per requested name.

    ``percentile`` keeps all distinct values of a group in one task, which is fine
    until a group is hot.  Beyond ``hot_rows`` rows the quantile is located by
    counting: value buckets first, then only the bucket that holds the position.
    """
    names = list(quantiles)
    value_ok = df.where(F.col(value).isNotNull())
    largest = hottest_group(value_ok, keys)
    if largest <= hot_rows:
        # One value map per group serves all requested positions.
        at = F.percentile(value, F.array(*[F.lit(float(q)) for q in quantiles.values()])).alias("_q")
        return value_ok.groupBy(*keys).agg(at).select(*keys, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    rows = value_ok.select(*keys, F.col(value).cast("double").alias("_v"))
    rows = with_bucket(rows, "_v", "_b", buckets or max(256, bucket_number(largest)))
    cells = rows.groupBy(*keys, "_b", "_v").agg(F.count(F.lit(1)).alias("_n"))
    per_bucket = cells.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn"))
    by_key = Window.partitionBy(*keys)
    run = by_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.withColumn("_off", F.coalesce(F.sum("_bn").over(run), F.lit(0)))
    per_bucket = per_bucket.withColumn("_total", F.sum("_bn").over(by_key))
    wanted = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("q")) for n, q in quantiles.items()])
    targets = per_bucket.withColumn("_w", F.explode(wanted))
    pos = F.col("_w.q") * (F.col("_total") - 1)
    targets = targets.withColumn("_lo", F.floor(pos)).withColumn("_hi", F.ceil(pos)).withColumn("_frac", pos - F.floor(pos))
    touch = lambda p: (F.col(p) >= F.col("_off")) & (F.col(p) < F.col("_off") + F.col("_bn"))
    targets = targets.where(touch("_lo") | touch("_hi")).drop("_bn", "_total")
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_cum", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    hit = cells.join(targets, keys + ["_b"])
    first = F.col("_off") + F.col("_cum")
    inside_cell = lambda p: (F.col(p) >= first) & (F.col(p) < first + F.col("_n"))
    part = hit.where(inside_cell("_lo") | inside_cell("_hi")).groupBy(*keys, F.col("_w.name").alias("_name")).agg(
        F.max(F.when(inside_cell("_lo"), F.col("_v"))).alias("_a"),
        F.max(F.when(inside_cell("_hi"), F.col("_v"))).alias("_z"),
        F.max("_frac").alias("_f"))
    part = part.withColumn("_q", F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_f"))
    return part.groupBy(*keys).pivot("_name", names).agg(F.max("_q"))
