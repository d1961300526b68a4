"""Mixing sources to target weights by Pfair scheduling.

The texts of a source form blocks of ``block_words`` words (a text belongs to the block of its
first word). The weights are taken as they are, as exact fractions e_i / p of their least common
period p. Block j of source i is released at slot floor(j p / e_i) and due at
ceil((j + 1) p / e_i); every slot goes to the released block with the earliest deadline. With
one block per slot and weights that add up to one this meets all deadlines, so at every slot
before a source is used up its share deviates from its target by less than one block, however
many slots there are.

A period of at most ``period`` slots, or one slot for each source, is laid out once; block j of
source i then stands at slot ``(j div e_i) p + slot[i][j mod e_i]``, an equi-join on (source,
j mod e_i). Other weights have no short period: there the blocks that the data has, one for
every ``block_words`` words, are settled one after another in a task that reads the sources'
numbers of blocks only and streams the slots into a table; an equi-join on (source, block)
gives them to the texts. Positions inside a source come from range-partitioned partial sums,
never from a window over a whole source.

All texts are kept: a source that runs out leaves its later slots empty, or, without a short
period, to blocks that are released. ``_within`` marks
the slots before the first source is used up, where the targets hold.

Defined cases: a null source is a source of its own; null or empty texts have no words and stay
with the block before them; without given weights the sources get their own share of words;
a source without weight goes behind all slots; ties of id are ordered by a hash of the text.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice
from math import floor, gcd, lcm

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from compoundry.llm import common as C

PERIOD, ROWS = 1_000, 65_536
PLAN = "_s string, _j long, _r long, _d long, _t long"


def quotas(weights: dict[str | None, float], period: int) -> dict[str | None, int]:
    """Slots of each source in a period of a given length, rounded: at least one, by largest remainders; they add up to the period."""
    total = float(sum(weights.values()))
    exact = {s: period * w / total for s, w in weights.items() if w > 0}
    out = {s: max(1, floor(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (-(exact[s] - floor(exact[s])), str(s)))
    i = 0
    while sum(out.values()) != period:
        step = 1 if sum(out.values()) < period else -1
        s = order[i % len(order)] if step > 0 else max(out, key=lambda s: (out[s] - exact[s], out[s]))
        if step > 0 or out[s] > 1:
            out[s] += step
        i += 1
    return out


def exact_quotas(weights: dict[str | None, float]) -> dict[str | None, int]:
    """The weights as whole slots of their least common period, without rounding."""
    exact = {s: Fraction(w) for s, w in weights.items() if w > 0}
    scale = lcm(*(x.denominator for x in exact.values()))
    out = {s: int(x * scale) for s, x in exact.items()}
    common = gcd(*out.values())
    return {s: e // common for s, e in out.items()}


def settle(quota: dict[str | None, int], blocks: dict[str | None, int]) -> Iterator[tuple[str | None, int, int, int, int]]:
    """(source, block, release, deadline, slot) of the first blocks of each source, earliest deadline first.

    A source's next block waits until the one before stands: its deadline is later in any case.
    """
    period, slot = sum(quota.values()), 0
    names = sorted((s for s in quota if blocks.get(s, 0) > 0), key=str)
    share, done = [quota[s] for s in names], [0] * len(names)
    waiting, ready = [(0, i) for i in range(len(names))], []
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            i = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(done[i] + 1) * period // share[i]), i))
        due, i = heapq.heappop(ready)
        yield names[i], done[i], done[i] * period // share[i], due, slot
        done[i] += 1
        if done[i] < blocks[names[i]]:
            heapq.heappush(waiting, (done[i] * period // share[i], i))
        slot += 1


def one_period(quota: dict[str | None, int]) -> list[tuple[str | None, int, int, int, int]]:
    """(source, block, release, deadline, slot) of every slot of a period, earliest deadline first."""
    return list(settle(quota, quota))


def _settled(quota: dict[str | None, int], blocks: dict[str | None, int]):
    """mapInArrow on one row: the slots of all blocks, some at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = settle(quota, blocks) if batch.num_rows else iter(())
            while some := list(islice(rows, ROWS)):
                s, *numbers = zip(*some, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.string()), *[pa.array(x, pa.int64()) for x in numbers]], ["_s", "_j", "_r", "_d", "_t"])
    return run


def _placed(blocks: DataFrame, quota: dict[str | None, int], period: int) -> DataFrame:
    """``blocks`` with ``_release``, ``_deadline`` and ``_slot``; null for sources without weight."""
    spark, length = blocks.sparkSession, sum(quota.values())
    own = F.col("_source").eqNullSafe(F.col("_s"))
    if length <= max(period, len(quota)):
        plan = spark.createDataFrame([(*x, quota[x[0]]) for x in one_period(quota)], PLAN + ", _e long")
        share = spark.createDataFrame(list(quota.items()), "_q string, _e0 long")
        if length <= period:
            plan, share = F.broadcast(plan), F.broadcast(share)
        turned = blocks.join(share, F.col("_source").eqNullSafe(F.col("_q")), "left")
        out = turned.join(plan, own & (F.pmod("_block", "_e0") == F.col("_j")), "left")
        turn = F.floor(F.col("_block") / F.col("_e0")) * F.lit(length)
    else:
        # one row per source
        last = blocks.groupBy("_source").agg(F.max("_block").alias("m")).collect()
        plan = spark.range(0, 1, 1, 1).mapInArrow(_settled(quota, {r["_source"]: r["m"] + 1 for r in last}), PLAN)
        out = blocks.join(C.write_once(plan, "slots"), own & (F.col("_block") == F.col("_j")), "left")
        turn = F.lit(0)
    return out.select("_id", "_tie", "_source", "_words", "_block", (turn + F.col("_r")).alias("_release"), (turn + F.col("_d")).alias("_deadline"),
                      (turn + F.col("_t")).alias("_slot"))


RESULTS = ("_block", "_release", "_deadline", "_slot", "_within")


def _running_words(rows: DataFrame) -> DataFrame:
    """``_before``: words of the same source before each row, by (id, text hash).

    Rows come range-partitioned by source and id, with the partition as ``_chunk``: sums per
    (source, chunk) give offsets, and the running sum stays inside one chunk.
    """
    sums = rows.groupBy("_source", "_chunk").agg(F.sum("_words").alias("_sum"))
    # one row per source and range partition, however many texts a source has
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(
        Window.partitionBy("_source").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inside = Window.partitionBy("_source", "_chunk").orderBy("_id", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_local", F.coalesce(F.sum("_words").over(inside), F.lit(0)))
    return local.join(offsets.toDF("_s", "_c", "_offset"), F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_chunk") == F.col("_c"))) \
        .withColumn("_before", F.col("_local") + F.col("_offset")).drop("_s", "_c", "_chunk", "_local", "_offset")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block_words: int = 10_000, period: int = PERIOD,
        temper: float = 1.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """All rows plus ``_block``, ``_release``, ``_deadline``, ``_slot`` and ``_within``.

    ``weights`` maps sources to positive numbers; without it each source gets its words to the
    power ``temper``. Weights with an exact period of at most ``period`` slots repeat it.
    The names and weights of all sources are held by the driver and by the task that settles slots.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    n_words = F.size(F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")).cast("long")
    small = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(C.NULL_ID)).alias("_id"), F.xxhash64(text).alias("_tie"),
                        F.col(f"`{source_col}`").cast("string").alias("_source"), n_words.alias("_words"))
    ranged = small.repartitionByRange(C.groups_for(docs.sparkSession, 2), "_source", "_id", "_tie")
    small = C.write_once(ranged.withColumn("_chunk", F.spark_partition_id()), "lengths")
    if weights is None:
        shares = small.groupBy("_source").agg(F.sum("_words").alias("w")).where("w > 0").orderBy("_source").collect()
        weights = {r["_source"]: float(r["w"]) ** temper for r in shares}
    placed = _running_words(small).withColumn("_block", F.floor(F.col("_before") / F.lit(block_words)))
    placed = _placed(placed, exact_quotas(weights), period)
    last = placed.where("_slot is not null").groupBy("_source").agg(F.max("_slot").alias("m")).agg(F.min("m")).first()[0]
    placed = placed.withColumn("_within", F.coalesce(F.col("_slot") <= F.lit(-1 if last is None else last), F.lit(False)))
    key = placed.drop("_source", "_words").groupBy("_id", "_tie").agg(*[F.min(c).alias(c) for c in ("_block", "_release", "_deadline", "_slot")],
                                                                      F.min("_within").alias("_within"))
    # helper names are new to the input; results take the place of columns named like them
    ours = [C.free_name(docs.columns, c) for c in ("_i", "_t", "_of", "_same")]
    rows = docs.withColumns({ours[0]: F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(C.NULL_ID)), ours[1]: F.xxhash64(text)})
    rows = rows.drop(*[c for c in RESULTS if c not in (id_col, text_col, source_col)])
    key = key.withColumnsRenamed({"_id": ours[2], "_tie": ours[3]})
    return rows.join(key, (F.col(ours[0]) == F.col(ours[2])) & (F.col(ours[1]) == F.col(ours[3]))).drop(*ours)


def op7_pfair_mix(spark, sf_dir: str) -> DataFrame:
    """Blocks, releases, deadlines and slots of all documents; the sources have equal weights."""
    docs = C.documents_of(spark, sf_dir)
    sources = [r[0] for r in docs.select("source").distinct().orderBy("source").collect()]
    out = mix(docs, {s: 1.0 for s in sources})
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.col("_block").alias("block"), F.col("_release").alias("release"),
                      F.col("_deadline").alias("deadline"), F.col("_slot").alias("slot"), F.col("_within").alias("within"))
