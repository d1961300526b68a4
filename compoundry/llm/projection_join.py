"""Embedding near-dedup by collision-counting projections.

Every vector is projected on many random directions. A table combines the signs of ``k``
directions (a cell) with one more direction on which the members of the cell are sorted; two
vectors collide in the table where they share the cell and the query-centred window of half
width ``w`` on the sorted direction. The collisions of a pair are counted over all tables, and
pairs with at least ``c`` of them are verified by their cosine in double precision.

Calibration. At the threshold angle a pair shares a sign with probability ``1 - angle / pi`` and
the window with 0.999. ``calibrate`` lets k follow the number of vectors (about 128 of
unlike vectors per cell), and takes the fewest tables, and then the largest count c, for which a pair
at the threshold itself is missed with a probability under 0.00002; closer pairs are missed less.

Equal vectors are one class. Cells above ``BLOCK`` members are cut into blocks that meet
pairwise, so no task holds a cell. A pair is judged only in the first table where it collides,
so links are counted, not emitted: a block gives each member its number of links and the
smallest member it reaches inside the block, and components are connected from those. Cosines within
``EDGE`` of the threshold are worked out again as dot over norms.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing; vectors of different length link with nothing; rows that share an id are separate
vectors; a null id counts as the smallest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import acos, ceil, comb, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compoundry.llm import common as C
from compoundry.llm.components import connect

CELL, BLOCK, MISS, WINDOW_SIGMAS, SEED, EDGE = 128, 2_048, 2e-5, 3.3, 91, 1e-12


def calibrate(n: int, threshold: float) -> tuple[int, int, int]:
    """(k, tables, least count) for n vectors."""
    k = max(4, min(40, round(log2(max(2, n / CELL)))))
    p = (1 - acos(threshold) / pi) ** k * 0.999
    tables = 1
    while (1 - p) ** tables + tables * p * (1 - p) ** (tables - 1) > MISS:
        tables += 1
    least = 1
    while sum(comb(tables, i) * p**i * (1 - p) ** (tables - i) for i in range(least + 1)) <= MISS:
        least += 1
    return k, tables, least


@lru_cache(maxsize=8)
def _directions(dim: int, k: int, tables: int) -> np.ndarray:
    return np.random.default_rng(SEED + dim).standard_normal((dim, tables * (k + 1)))


def codes_of(unit: np.ndarray, k: int, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells and window values of unit vectors, one column per table."""
    z = unit @ _directions(unit.shape[1], k, tables)
    z = z.reshape(len(unit), tables, k + 1)
    return (z[:, :, :k] > 0) @ (1 << np.arange(k, dtype=np.int64)), np.ascontiguousarray(z[:, :, k])


def _units(blobs: list[bytes], dtype: str) -> np.ndarray:
    x = _scaled(blobs, dtype)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _scaled(blobs: list[bytes], dtype: str) -> np.ndarray:
    """Vectors in double precision, by a power of two so that no square overflows or vanishes."""
    x = np.frombuffer(b"".join(blobs), dtype).reshape(len(blobs), -1).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _join(root: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Hang the members that the pairs (p, q) link below the smallest place of their piece, in place."""
    while len(p):
        a, b = root[p], root[q]
        apart = a != b
        p, q, a, b = p[apart], q[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while np.any((up := root[root]) != root):
            root[:] = up


def _by_length(blobs: list[bytes]) -> Iterator[np.ndarray]:
    size = np.array([len(b) for b in blobs])
    for s in np.unique(size):
        yield np.flatnonzero(size == s)


def _valid(dtype: str):
    """mapInArrow: (id, array) to (id, vector bytes or null)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column("v"):
                raw = x.as_py()
                v = np.array(raw, dtype) if raw and None not in raw else None
                good = v is not None and np.isfinite(v).all() and v.any()
                out.append((v + np.array(0, dtype)).tobytes() if good else None)  # -0 is 0
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "vec"])
    return run


def _cells(dtype: str, k: int, tables: int):
    """mapInArrow: (cid, vec) to a row (cid, table, cell) per table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cid, blobs = batch.column("cid").to_numpy(zero_copy_only=False), batch.column("vec").to_pylist()
            for who in _by_length(blobs):
                for at in range(0, len(who), 4096):
                    w = who[at : at + 4096]
                    cell, _ = codes_of(_units([blobs[i] for i in w], dtype), k, tables)
                    cell = C.mix(cell.astype(np.uint64) * np.uint64(C.WORD_BASE) + np.uint64(len(blobs[w[0]])))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cid[w], tables)), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(w))),
                                                      pa.array(cell.ravel().view(np.int64))], ["cid", "t", "cell"])
    return run


def _deal(dtype: str, k: int, tables: int, groups: int):
    """mapInArrow: vectors to the block pairs of their cells."""
    names = ["part", "t", "cell", "x", "y", "k", "cid", "m", "vec"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                rows = some.to_pylist()
                blobs = [r["vec"] for r in rows]
                for who in _by_length(blobs):
                    cell, _ = codes_of(_units([blobs[i] for i in who], dtype), k, tables)
                    cell = C.mix(cell.astype(np.uint64) * np.uint64(C.WORD_BASE) + np.uint64(len(blobs[who[0]]))).view(np.int64)
                    out: list[tuple] = []
                    for i, cells in zip(who, cell, strict=True):
                        r = rows[i]
                        hot = {h["t"]: h["blocks"] for h in r["hot"] or ()}
                        for t, c in enumerate(cells.tolist()):
                            n = hot.get(t, 1)
                            own = int(C.mix(np.array([r["cid"] * tables + t]).view(np.uint64))[0] % np.uint64(n)) if n > 1 else 0
                            out += [(t, c, min(own, o), max(own, o), own, r["cid"], r["m"], r["vec"]) for o in range(n)]
                    cols = list(zip(*out, strict=True))
                    t, c, x, y = (np.array(v, np.int64) for v in cols[:4])
                    part = (C.mix((c ^ (t << 50) ^ (x << 24) ^ y).view(np.uint64)) % np.uint64(groups)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(part), *[pa.array(v, pa.int64()) for v in (t, c, x, y, *cols[4:7])], pa.array(cols[7], pa.binary())], names)
    return run


def _judge(dtype: str, k: int, tables: int, least: int, threshold: float):
    """applyInArrow on a group of block pairs: links per member and the smallest member it reaches there."""
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        if not table.num_rows:
            return
        t, cell, x, y, own, cid, m = (table.column(c).to_numpy() for c in ("t", "cell", "x", "y", "k", "cid", "m"))
        blobs = table.column("vec").to_pylist()
        order = np.lexsort((cid, y, x, cell, t))
        cuts = np.flatnonzero(np.any([v[order][1:] != v[order][:-1] for v in (t, cell, x, y)], axis=0)) + 1
        for rows in np.split(order, cuts):
            if len(rows) < 2:
                continue
            unit = _units([blobs[i] for i in rows], dtype)
            cells, values = codes_of(unit, k, tables)
            w = WINDOW_SIGMAS * sqrt(2 - 2 * threshold)  # a direction has independent normal components
            here = int(t[rows[0]])
            # members in the order of the sorted direction: each with those in its window, once
            by = np.argsort(values[:, here], kind="stable")
            ends = np.searchsorted(values[by, here], values[by, here] + w, "right")
            links, root = np.zeros(len(rows), np.int64), np.arange(len(rows))  # rows ascend by cid
            diagonal, sizes, ids, side = x[rows[0]] == y[rows[0]], m[rows], cid[rows], own[rows]
            for lo in range(0, len(by), 256):
                hi = min(lo + 256, len(by))
                i = np.repeat(np.arange(lo, hi), ends[lo:hi] - np.arange(lo, hi) - 1)
                if not len(i):
                    continue
                start = np.cumsum(ends[lo:hi] - np.arange(lo, hi) - 1) - (ends[lo:hi] - np.arange(lo, hi) - 1)
                j = i + 1 + np.arange(len(i)) - np.repeat(start, ends[lo:hi] - np.arange(lo, hi) - 1)
                a, b = by[i], by[j]
                if not diagonal:
                    across = side[a] != side[b]
                    a, b = a[across], b[across]
                for at in range(0, len(a), 50_000):
                    p, q = a[at : at + 50_000], b[at : at + 50_000]
                    hit = (cells[p] == cells[q]) & (np.abs(values[p] - values[q]) <= w)
                    mine = (hit.argmax(1) == here) & (hit.sum(1) >= least)
                    p, q = p[mine], q[mine]
                    cosine = np.einsum("ij,ij->i", unit[p], unit[q])
                    edge = np.flatnonzero(np.abs(cosine - threshold) <= EDGE)
                    if len(edge):
                        v, u = (_scaled([blobs[rows[i]] for i in side_of[edge]], dtype) for side_of in (p, q))
                        cosine[edge] = (v * u).sum(1) / (np.sqrt((v * v).sum(1)) * np.sqrt((u * u).sum(1)))
                    near = cosine >= threshold
                    p, q = p[near], q[near]
                    np.add.at(links, p, sizes[q])
                    np.add.at(links, q, sizes[p])
                    _join(root, p, q)
            got = np.flatnonzero(links)
            if len(got):
                yield pa.RecordBatch.from_arrays([pa.array(ids[got]), pa.array(links[got]), pa.array(ids[root[got]])], ["cid", "links", "low"])
    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``_id``, ``_n_links`` and ``_component`` of every row (null ids as the smallest integer)."""
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)[vector_col]
    dtype = "<f4" if kind == "array<float>" else "<f8"
    rows = vectors.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(C.NULL_ID)).alias("id"),
                          F.col(f"`{vector_col}`").cast("array<float>" if dtype == "<f4" else "array<double>").alias("v"))
    rows = C.write_once(rows.mapInArrow(_valid(dtype), "id long, vec binary"), "vectors")
    classes = rows.where("vec is not null").groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("m"))
    classes = C.write_once(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    k, tables, least = calibrate(max(2, classes.count()), threshold)
    light = classes.select("cid", "vec").mapInArrow(_cells(dtype, k, tables), "cid long, t int, cell long")
    hot = C.write_once(light.groupBy("t", "cell").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
                       .select("t", "cell", F.ceil(F.col("n") / F.lit(BLOCK // 2)).cast("long").alias("blocks")), "hot-cells")
    marks = C.write_once(light.join(hot, ["t", "cell"]).groupBy("cid").agg(F.collect_list(F.struct("t", "blocks")).alias("hot")), "marks")
    groups = C.groups_for(spark, 8)
    dealt = classes.join(marks, "cid", "left").select("cid", "m", "vec", "hot").mapInArrow(
        _deal(dtype, k, tables, groups), "part int, t long, cell long, x long, y long, k long, cid long, m long, vec binary")
    found = C.write_once(dealt.groupBy("part").applyInArrow(_judge(dtype, k, tables, least, threshold), "cid long, links long, low long"), "links")
    parts = C.write_once(connect(found.select(F.col("cid").alias("a"), F.col("low").alias("b")).where("a <> b").distinct(), classes.select(F.col("cid").alias("id"))), "components")
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    named = classes.join(parts.toDF("cid", "root"), "cid")
    lowest = C.write_once(named.groupBy("root").agg(F.min("id").alias("component")), "lowest")
    members = C.write_once(named.join(lowest, "root").join(counts, "cid", "left").select("vec", "component", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n")), "members")
    return rows.join(members, "vec", "left").select(F.col("id").alias("_id"), F.coalesce("n", F.lit(0)).cast("long").alias("_n_links"),
                                                    F.coalesce("component", "id").alias("_component"))


def op3_projection_join(spark, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.9."""
    out = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    name = lambda c: F.when(F.col(c) != C.NULL_ID, F.col(c))
    return out.select(name("_id").alias("vec_id"), F.col("_n_links").alias("n_links"), name("_component").alias("component_id"),
                      (F.col("_id") == F.col("_component")).alias("kept"))
