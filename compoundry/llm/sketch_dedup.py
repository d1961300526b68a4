"""MinHash near-dedup with SetSketch registers.

A document's set is its distinct k-word shingles (A-Z lower-cased; with fewer words, the whole
sequence as one). Documents of equal sets form one class; only classes are compared.

Sketch. Register i is ``1 - floor(log_b(min_x h_i(x)))`` with h_i exponential: an exponentially
spaced truncated minimum. Registers merge by maximum, and equal registers grow with
similarity. With b = 1.001 equality is nearly the Jaccard similarity itself.

Search. Bands of registers are hashed; classes that share a band are candidates. Within a
band no pairs are emitted: every class is proposed to the band's smallest class only. The
proposals are estimated jointly by maximum likelihood from both sketches and set sizes, those
that may reach the threshold are confirmed on the full sets, and confirmed links merge
components. In the next round a band matters only while its members lie in different
components, and the proposals go to a centre drawn anew; the last round takes what is left,
member against member in bounded blocks, so that no link between components is missed. A
group of thousands of copies so costs a few proposals per member.

Miss probability at the threshold (similarity 0.8, 128 registers, 4 per band): below 1e-6 by
the bands, below 1e-4 by the estimate's margin.

Defined cases: null or empty text has an empty set, links with nothing and is kept; a null id
counts as the smallest; rows that share an id are one document whose set is the set of the
row with the smallest set hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compoundry.llm import common as C
from compoundry.llm.components import connect

REGISTERS, BAND, BASE = 128, 4, 1.001
MARGIN = 0.14
ROUNDS = 2
BLOCK, BLOCK_BYTES = 512, 8 << 20
CACHE_SHINGLES = 16_384

_rng = np.random.default_rng(77)
_factors = _rng.integers(1 << 62, 1 << 63, REGISTERS, dtype=np.uint64) | np.uint64(1)
_masks = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of all rows, and each row's count."""
    words = C.words_of(data, offsets)
    n = len(words.row)
    hashes = words.hashes(True)
    at = np.flatnonzero(words.row[: n - size + 1] == words.row[size - 1 :]) if n >= size else np.zeros(0, np.int64)
    short = np.flatnonzero((words.per_row > 0) & (words.per_row < size))
    first = words.first
    starts = np.concatenate([at, first[short]])
    ends = np.concatenate([at + size, first[short + 1]])
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    row = words.row[starts]
    out = C.range_hashes(hashes, starts, ends, C.WORD_BASE)
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    keep = np.concatenate([[True], (out[1:] != out[:-1]) | (row[1:] != row[:-1])])
    return out[keep], np.bincount(row[keep], minlength=len(offsets) - 1)


def registers_of(sets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """SetSketch registers, one row of uint16 per non-empty set (counts are positive)."""
    starts = np.cumsum(counts) - counts
    out = np.empty((len(counts), REGISTERS), np.uint64)
    lo = 0
    while lo < len(counts):  # a few thousand shingles at a time stay in the cache
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + CACHE_SHINGLES, "right")) - 1)
        part = sets[starts[lo] : starts[hi - 1] + counts[hi - 1]]
        at = starts[lo:hi] - starts[lo]
        for i in range(REGISTERS):
            out[lo:hi, i] = np.minimum.reduceat((part ^ _masks[i]) * _factors[i], at)
        lo = hi
    # minimum of uniforms to minimum of exponentials; both keep the order
    low = -np.log1p(-(out.astype(np.float64) + 0.5) / 2.0**64)
    return np.clip(np.floor(1 - np.log(low) / np.log(BASE)) + 1_000, 0, 65_535).astype(np.uint16)


def likely_jaccard(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of pairs of register rows with known set sizes.

    The counts of registers that are larger, smaller and equal follow a trinomial whose
    probabilities depend on the similarity alone; its logarithm is maximised over a grid.
    """
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u = (size_a / (size_a + size_b))[:, None]
    v = 1 - u
    grid = np.linspace(0, 1, 51)[None, :] * np.minimum(u / v, v / u)

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = chance(u - v * grid), chance(v - u * grid)
    with np.errstate(divide="ignore", invalid="ignore"):
        value = (np.where(more[:, None] > 0, more[:, None] * np.log(up), 0) + np.where(less[:, None] > 0, less[:, None] * np.log(down), 0)
                 + np.where(same[:, None] > 0, same[:, None] * np.log(np.clip(1 - up - down, 0, 1)), 0))
    return grid[np.arange(len(grid)), np.nanargmax(value, axis=1)]


def _set_rows(size: int, with_sets: bool, with_sketch: bool = True):
    """mapInArrow: (id, text) to (id, n, sig, sketch, bands) or (id, n, shingles)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = C.ids_of(batch.column("id"))
            for lo, hi, data, offsets in C.text_slices(batch.column("text")):
                sets, counts = shingle_sets(data, offsets, size)
                full = np.flatnonzero(counts > 0)
                ends = np.cumsum(counts)
                sig = C.mix(np.add.reduceat(sets, (ends - counts)[full]) + counts[full].astype(np.uint64)) if len(full) else np.zeros(0, np.uint64)
                sig2 = np.bitwise_xor.reduceat(C.mix(sets), (ends - counts)[full]) if len(full) else sig
                cols = {"id": ids[lo:hi], "n": counts.astype(np.int64)}
                key = np.zeros((hi - lo, 2), np.uint64)
                key[full, 0], key[full, 1] = sig, sig2
                arrays = [pa.array(cols["id"]), pa.array(cols["n"]),
                          pa.array([k.tobytes() if n else None for k, n in zip(key, counts, strict=True)], pa.binary())]
                names = ["id", "n", "sig"]
                if with_sketch:
                    reg = registers_of(sets, counts[full]) if len(full) else np.zeros((0, REGISTERS), np.uint16)
                    sketch: list = [None] * (hi - lo)
                    for k, r in zip(full, reg, strict=True):
                        sketch[k] = r.tobytes()
                    arrays.append(pa.array(sketch, pa.binary()))
                    names.append("sketch")
                if with_sets:
                    arrays.append(pa.array([sets[e - c : e].tobytes() for e, c in zip(ends, counts, strict=True)], pa.binary()))
                    names.append("shingles")
                yield pa.RecordBatch.from_arrays(arrays, names)
    return run


def _bands_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: one row (class, band key) for each band of a sketch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        reg = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(len(ids), -1, BAND).astype(np.uint64)
        key = np.zeros(reg.shape[:2], np.uint64) + np.arange(reg.shape[1], dtype=np.uint64)
        for j in range(BAND):
            key = C.mix(key * np.uint64(C.WORD_BASE) + reg[:, :, j])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, key.shape[1])), pa.array(key.ravel().view(np.int64))], ["id", "band"])


def _likely(threshold: float):
    """mapInArrow: pairs with sketches that may reach the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            na, nb = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("na", "nb"))
            keep = np.concatenate([likely_jaccard(a[i : i + 1024], b[i : i + 1024], na[i : i + 1024], nb[i : i + 1024])
                                   for i in range(0, len(a), 1024)]) >= threshold - MARGIN
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in PAIR], PAIR).filter(pa.array(keep))
    return run


PAIR = ["a", "b", "ga", "gb"]


def _confirmed(percent: int):
    """mapInArrow: pairs whose full sets reach the threshold; a set must be that of its class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            own = zip(*(batch.column(c) for c in ("ga", "ra", "gb", "rb")), strict=True)
            for (ga, ra, gb, rb), x, y in zip(own, batch.column("xa"), batch.column("xb"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(ga == ra and gb == rb and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _confirm(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes (a, b) that truly reach the threshold, written."""
    side = classes.select("id", "n", "sketch", "sig")
    # sizes alone rule out most pairs of unlike length, before any sketch is read
    joined = (pairs.join(side.toDF("a", "na", "sa", "ga"), "a").join(side.toDF("b", "nb", "sb", "gb"), "b")
              .where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
    likely = joined.mapInArrow(_likely(percent / 100), "a long, b long, ga binary, gb binary")
    both = likely.join(sets.toDF("a", "ra", "xa"), "a").join(sets.toDF("b", "rb", "xb"), "b")
    return C.write_once(both.mapInArrow(_confirmed(percent), "a long, b long").distinct(), "links")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_doc``, ``_n_shingles`` and ``_component`` of every distinct id (null as the smallest).

    Linked are documents with ``100 * intersection >= percent * union`` of their shingle sets.
    """
    texts = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(C.NULL_ID)).alias("id"),
                        F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = texts.mapInArrow(_set_rows(size, False), "id long, n long, sig binary, sketch binary")
    rows = C.write_once(rows.groupBy("id").agg(F.min(F.struct("sig", "n", "sketch")).alias("s")).select("id", "s.*"), "sketches")
    # equal sets: the smallest id stands for its class
    classes = C.write_once(rows.where("sig is not null").groupBy("sig").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "classes")
    bands = classes.mapInArrow(_bands_of, "id long, band long")
    # aggregates are written before they are joined: a hot band's join can then be split
    centre = C.write_once(bands.groupBy("band").agg(F.count("*").alias("m"), F.min("id").alias("c")).where("m > 1").select("band", "c"), "centres")
    open_bands = C.write_once(bands.join(centre, "band"), "bands")
    nodes = C.write_once(open_bands.select("id").distinct(), "nodes")
    sets = C.write_once(texts.join(nodes, "id", "left_semi").mapInArrow(
        _set_rows(size, True, False), "id long, n long, sig binary, shingles binary").where("n > 0").select("id", "sig", "shingles"), "sets")
    links = _confirm(open_bands.where("id <> c").select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")).distinct(),
                     classes, sets, percent)
    parts = C.write_once(connect(links, nodes), "components")
    for turn in range(1, ROUNDS + 1):
        last = turn == ROUNDS
        # bands whose members have met are done; the others propose to a centre drawn anew
        members = C.write_once(open_bands.select("band", "id").join(parts, "id"), "members")
        draw = F.xxhash64("id", F.lit(turn))
        centre = C.write_once(members.groupBy("band").agg(
            F.count("*").alias("m"), F.min("component").alias("x"), F.max("component").alias("y"), F.min_by("id", draw).alias("c"),
            F.min_by("component", draw).alias("cc")).where("x <> y").drop("x", "y"), "centres")
        if centre.isEmpty():  # every band's members have met
            break
        open_bands = members.join(centre, "band")
        if last:
            found = _settle(C.write_once(open_bands.select("id", "c", "component"), "open"), classes, sets, percent)
        else:
            pairs = open_bands.where("component <> cc").select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b")).distinct()
            found = _confirm(pairs, classes, sets, percent)
        if found.isEmpty():
            continue
        moved = found.join(parts.toDF("a", "ca"), "a").join(parts.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        merged = connect(moved, parts.select(F.col("component").alias("id")).distinct())
        parts = C.write_once(parts.join(merged.toDF("component", "to"), "component").select("id", F.col("to").alias("component")), "components")
    members = C.write_once(classes.select("sig", "id").join(parts, "id", "left").select("sig", F.coalesce("component", "id").alias("component")), "members")
    out = rows.select("id", "n", "sig").join(members, "sig", "left")
    return out.select(F.col("id").alias("_doc"), F.col("n").alias("_n_shingles"), F.coalesce("component", "id").alias("_component"))


def _settle(rows: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components that still share a band, one for each merge.

    Classes that hang together by open bands are a cluster, cut into blocks of at most ``BLOCK``
    classes and ``BLOCK_BYTES`` of sets. Each block meets each other block of its cluster in a task,
    which compares members of different components there and returns links only.
    """
    nodes = rows.select("id", "component").distinct()
    cluster = C.write_once(connect(rows.select(F.col("id").alias("a"), F.col("c").alias("b")), nodes.select("id")).toDF("id", "cluster"), "clusters")
    full = C.write_once(cluster.join(nodes, "id").join(classes.select("id", "n", "sketch", "sig"), "id").join(
        sets.select("id", F.col("sig").alias("_sig"), "shingles"), "id").where("sig = _sig").drop("_sig"), "cluster-rows")
    sizes = C.write_once(full.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("n") * 8 / F.lit(BLOCK_BYTES))).cast("long").alias("blocks")), "cluster-sizes")
    dealt = full.join(sizes, "cluster").withColumn("k", F.pmod(F.xxhash64("id"), F.col("blocks")))
    dealt = dealt.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keyed = dealt.select("cluster", F.least("k", "o").alias("x"), F.greatest("k", "o").alias("y"), "k", "id", "component", "n", "sketch", "shingles")
    return C.write_once(keyed.groupBy("cluster", "x", "y").applyInArrow(_settled(percent), "a long, b long"), "links")


def _settled(percent: int):
    """applyInArrow on one block pair: links that join components not yet joined here."""
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        k, ids, comp, n = (table.column(c).to_numpy() for c in ("k", "id", "component", "n"))
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(len(ids), -1)
        shingles = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        x, y = key[1].as_py(), key[2].as_py()
        left, right = np.flatnonzero(k == x), np.flatnonzero(k == y)
        least = int(REGISTERS * (percent / 100 - 2 * MARGIN))
        root = {int(c): int(c) for c in comp}

        def top(c: int) -> int:
            while root[c] != c:
                c = root[c]
            return c

        out: list[tuple[int, int]] = []
        for at in range(0, len(left), 64):
            rows = left[at : at + 64]
            same = np.stack([(sketch[right] == sketch[i]).sum(1) for i in rows])
            close = (same >= least) & (comp[rows][:, None] != comp[right][None, :])
            i, j = np.nonzero(close & ((ids[rows][:, None] < ids[right][None, :]) | (x != y)))
            i, j = rows[i], right[j]
            keep = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
            i, j = i[keep], j[keep]
            good = [likely_jaccard(sketch[i[s : s + 1024]], sketch[j[s : s + 1024]], n[i[s : s + 1024]].astype(float), n[j[s : s + 1024]].astype(float))
                    >= percent / 100 - MARGIN for s in range(0, len(i), 1024)]
            if not good:
                continue
            keep = np.concatenate(good)
            i, j = i[keep], j[keep]
            both = _common(shingles, i, j)
            linked = 100 * both >= percent * (n[i] + n[j] - both)
            for a, b in zip(i[linked].tolist(), j[linked].tolist(), strict=True):
                ra, rb = top(int(comp[a])), top(int(comp[b]))
                if ra != rb:
                    root[max(ra, rb)] = min(ra, rb)
                    out.append((int(ids[a]), int(ids[b])))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], ["a", "b"])
    return run


def _common(shingles: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of many pairs: products of 0/1 columns, some columns at a time."""
    if len(i) < 64:
        return np.array([len(np.intersect1d(shingles[a], shingles[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], np.int64)
    p, ip = np.unique(i, return_inverse=True)
    q, jq = np.unique(j, return_inverse=True)
    right = np.concatenate([shingles[b] for b in q])
    owner = np.repeat(np.arange(len(q)), [len(shingles[b]) for b in q])
    vocabulary = np.unique(np.concatenate([shingles[a] for a in p]))
    at = np.minimum(np.searchsorted(vocabulary, right), len(vocabulary) - 1)
    there = vocabulary[at] == right
    at, owner = at[there], owner[there]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    mine = np.concatenate([np.searchsorted(vocabulary, shingles[a]) for a in p])
    who = np.repeat(np.arange(len(p)), [len(shingles[a]) for a in p])
    order = np.argsort(mine, kind="stable")
    mine, who = mine[order], who[order]
    counts = np.zeros((len(p), len(q)), np.float32)
    for lo in range(0, len(vocabulary), 4096):
        x, y = np.zeros((len(p), 4096), np.float32), np.zeros((len(q), 4096), np.float32)
        s = slice(*np.searchsorted(mine, [lo, lo + 4096]))
        x[who[s], mine[s] - lo] = 1
        s = slice(*np.searchsorted(at, [lo, lo + 4096]))
        y[owner[s], at[s] - lo] = 1
        counts += x @ y.T
    return counts[ip, jq].astype(np.int64)


def op9_setsketch_dedup(spark, sf_dir: str) -> DataFrame:
    """Components of all documents: 4-word shingles, similarity 0.8."""
    out = near_duplicates(C.documents_of(spark, sf_dir), 4, 80)
    ident = F.when(F.col("_doc") != C.NULL_ID, F.col("_doc"))
    part = F.when(F.col("_component") != C.NULL_ID, F.col("_component"))
    return out.select(ident.alias("doc_id"), F.col("_n_shingles").alias("n_shingles"), part.alias("component_id"),
                      (F.col("_doc") == F.col("_component")).alias("kept"))
