"""Rows packed into bounded blocks for exact pairwise work without emitting pairs.

A block is one row holding up to about ``block_rows`` records of one small cell (a bit
count, a slice of a projection).  Blocks of a hot cell are cut by hash, so no block
grows with the hottest value.  Pairwise operators join blocks on equal block keys and
compare the two sides inside the task with one matrix product; only results leave it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 2048
#: Blocks a cell is cut into before its blocks may grow: what is shuffled then grows with the rows, not with the pairs of blocks.
CELL_BLOCKS = 64


def cell_sizes(df: DataFrame, cell: str, block_rows: int = BLOCK_ROWS, growth: int = 1) -> DataFrame:
    """cell, n_sub: how many blocks each cell is cut into. Blocks of cells beyond ``CELL_BLOCKS`` blocks grow up to ``growth`` times."""
    sizes = df.groupBy(cell).agg(F.count(F.lit(1)).alias("_n"))
    rows = F.least(F.greatest(F.col("_n") / CELL_BLOCKS, F.lit(float(block_rows))), F.lit(float(growth * block_rows)))
    return sizes.select(cell, F.ceil(F.col("_n") / rows).cast("int").alias("n_sub"))


def pack(df: DataFrame, cell: str, ident: str, fields: list[str], sizes: DataFrame) -> DataFrame:
    """cell, sub, items: one row per block.  ``sizes`` has one row per cell (bounded)."""
    placed = df.join(F.broadcast(sizes), cell).withColumn(
        "sub", F.pmod(F.xxhash64(ident), F.col("n_sub")).cast("int"))
    return placed.groupBy(cell, "sub").agg(F.collect_list(F.struct(ident, *fields)).alias("items"))


def block_keys(sizes: DataFrame, cell: str) -> DataFrame:
    """Every (cell, sub) key."""
    return sizes.select(cell, F.explode(F.sequence(F.lit(0), F.col("n_sub") - 1)).alias("sub"))


def key_text(cell: Column, sub: Column) -> Column:
    return F.concat_ws(":", cell.cast("string"), sub.cast("string"))


def tasks_for(df: DataFrame) -> int:
    """Number of tasks for work that grows with the pairs: blocks are few bytes, so sizes in bytes would merge them into one task."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def dealt(todo: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """``todo`` over ``tasks`` tasks by ``keys``, with the column ``task``.

    The keys themselves would not do: where a join before has dealt the rows by the same keys into as many partitions, Spark
    drops the repartition, and the join's few bytes end up in a few tasks.
    """
    return todo.withColumn("task", F.xxhash64(*keys)).repartition(tasks, "task")


def block_side(batch: pa.RecordBatch, row: int, side: str, fields: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """ids and one matrix per field of the block on one side of a row."""
    read = lambda c: batch.column(f"{c}_{side}")[row].values.to_numpy(zero_copy_only=False)
    ids = read("ids")
    return ids, [read(f).reshape(len(ids), -1) for f in fields]


def meet(left: DataFrame, right: DataFrame | None, fields: list[str], reach: Callable[[Column], Column],
         compare: Callable[..., pd.DataFrame], schema: str, block_rows: int = BLOCK_ROWS, growth: int = 1) -> DataFrame:
    """Compare rows of cells that can reach each other, block against block.

    Both sides have ``cell`` (whole number, a bounded number of values), ``id`` and ``fields`` (number arrays of one
    length). ``reach`` lists the cells of the right side that a left cell meets; for a self-join (``right=None``)
    only cells from its own on. Which block meets which is decided on the directories, a row per block.
    ``compare(cell_a, ids_a, fields_a, ids_b, fields_b, same)`` returns the hits (a frame, or arrays by column), with one matrix per field;
    ``same`` marks a block that meets itself. With ``growth`` blocks of large cells travel up to so many times larger;
    ``compare`` still sees at most ``block_rows`` rows a side.
    """
    self_join = right is None
    rhs = left if self_join else right
    l_sizes = cell_sizes(left, "cell", block_rows, growth)
    r_sizes = l_sizes if self_join else cell_sizes(rhs, "cell", block_rows, growth)
    side = lambda d, s: d.toDF(*[f"{c}_{s}" for c in d.columns])
    # numbers travel as flat arrays, which arrive in the task without an object per row
    flat = lambda d, sizes: pack(d, "cell", "id", fields, sizes).select("cell", "sub", F.col("items.id").alias("ids"), *[
        F.flatten(f"items.{f}").alias(f) for f in fields])
    todo = side(block_keys(l_sizes, "cell"), "a").withColumn("cell_b", F.explode(reach(F.col("cell_a"))))
    todo = todo.join(side(block_keys(r_sizes, "cell"), "b"), "cell_b")
    if self_join:
        todo = todo.where((F.col("cell_a") < F.col("cell_b")) | (F.col("sub_a") <= F.col("sub_b")))
    todo = todo.join(side(flat(left, l_sizes), "a"), ["cell_a", "sub_a"]).join(side(flat(rhs, r_sizes), "b"), ["cell_b", "sub_b"])

    todo = dealt(todo, tasks_for(left), "cell_a", "sub_a", "cell_b", "sub_b")

    kinds = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    form = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                cell_a, cell_b, sub_a, sub_b = (batch.column(c)[row].as_py() for c in ("cell_a", "cell_b", "sub_a", "sub_b"))
                same = self_join and cell_a == cell_b and sub_a == sub_b
                (ids_a, mine), (ids_b, theirs) = (block_side(batch, row, s, fields) for s in "ab")
                for lo in range(0, len(ids_a), block_rows):
                    a = slice(lo, lo + block_rows)
                    for start in range(lo if same else 0, len(ids_b), block_rows):
                        b = slice(start, start + block_rows)
                        hits = compare(cell_a, ids_a[a], [m[a] for m in mine], ids_b[b], [t[b] for t in theirs], same and lo == start)
                        yield (pa.RecordBatch.from_pydict(hits, schema=form) if isinstance(hits, dict) else
                               pa.RecordBatch.from_pandas(hits, schema=form, preserve_index=False))

    return todo.mapInArrow(run, schema)


def strips(left: DataFrame, right: DataFrame, fields: list[str], reach: Callable[[Column], Column], fold: Callable[..., pd.DataFrame],
           schema: str, block_rows: int = BLOCK_ROWS, growth: int = 1) -> DataFrame:
    """Every block of the left folds over all blocks of the right that its cell can reach, in one task.

    Tables and ``reach`` as in ``meet``, both sides whole. ``fold(ids_a, fields_a, others)`` reads ``others``, an iterator of
    (ids_b, fields_b), and returns rows about the left block: what leaves a task grows with its rows, not with the pairs.
    With ``growth`` blocks grow as in ``meet``; one of ``others`` then has the fewer rows the more the left block has.
    """
    l_sizes, r_sizes = cell_sizes(left, "cell", block_rows, growth), cell_sizes(right, "cell", block_rows, growth)
    flat = lambda d, sizes, s: pack(d, "cell", "id", fields, sizes).select(F.col("cell").alias(f"cell_{s}"), F.col("sub").alias(f"sub_{s}"), F.col("items.id").alias(
        f"ids_{s}"), *[F.flatten(f"items.{f}").alias(f"{f}_{s}") for f in fields])
    todo = block_keys(l_sizes, "cell").toDF("cell_a", "sub_a").withColumn("cell_b", F.explode(reach(F.col("cell_a"))))
    todo = todo.join(block_keys(r_sizes, "cell").toDF("cell_b", "sub_b"), "cell_b")
    todo = todo.join(flat(right, r_sizes, "b"), ["cell_b", "sub_b"]).join(flat(left, l_sizes, "a"), ["cell_a", "sub_a"])
    names = [c.split()[0] for c in schema.split(", ")]

    def run(_: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        first = next(batches)
        mine = block_side(first, 0, "a", fields)
        step = max(1, block_rows * block_rows // max(block_rows, len(mine[0])))
        whole = (block_side(b, r, "b", fields) for part in ([first], batches) for b in part for r in range(b.num_rows))
        rest = ((ids[lo:lo + step], [t[lo:lo + step] for t in theirs]) for ids, theirs in whole for lo in range(0, len(ids), step))
        out = fold(*mine, rest)
        yield pa.RecordBatch.from_pandas(out[names], preserve_index=False)

    # few groups and long ones: more tasks than groups keep two of them from meeting in one
    return dealt(todo, max(tasks_for(left), 2 * CELL_BLOCKS), "cell_a", "sub_a").groupBy("task", "cell_a", "sub_a").applyInArrow(run, schema)
