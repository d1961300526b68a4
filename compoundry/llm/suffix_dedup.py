"""Suffix-array dedup: every byte of a repeated string of ``length`` bytes is removed.

Suffixes of a whole corpus do not fit one sorter, so equal strings are brought together first,
by exact steps that lose no repeat:

1. Anchors. The hash of every ``GRAM`` bytes is taken; a window of ``length`` bytes is owned by the
   smallest hash in it (leftmost of equal ones). Equal windows have equal anchors at equal offsets,
   so a window can repeat only where its anchor repeats. About one place in 70 is an anchor; only
   (anchor hash, context hash, place) travels, a context being the bytes of all windows its anchor owns.
2. Anchors that occur once are dropped with their windows; a context that occurs again is a repeat as
   a whole. Where an anchor has several contexts, the distinct contexts of a shard of anchors are
   sorted as one text by external induced sorting (``induced_sort``): its disk-backed queues carry
   suffixes and common prefixes, and a window repeats where the common prefix with a neighbour
   reaches ``length``.
3. An anchor with over ``HOT`` distinct contexts in a group (the edge of a passage that a large part of
   all documents shares) would fill one sorter. Its contexts are cut into their single windows,
   which meet by their own hash instead.

Repeats meet the texts again by document and merge into maximal runs. Hashes are 64-bit sums over
random byte values (contexts: with their anchor's, 128 bits).

Defined cases: a null or empty text has no bytes; texts under ``length`` lose nothing; a document is an id
with its text: rows that share an id (or have none) but not the text are documents of their own,
rows that share both are one text given twice; matches never cross documents; very long
texts are cut into contexts like all others (at most 2^32 bytes each); an empty table gives no rows; other columns
pass through under any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compoundry.llm import common as C
from compoundry.llm.induced_sort import MEMORY, repeated_places

LENGTH, GRAM, HOT, FLUSH_ANCHORS, PLACE_BITS = 200, 64, 256, 400_000, 32


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, anchor place, first and last owned window, and anchor hash of each anchor (places in ``data``)."""
    n, w = len(data), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.view(np.uint64)
    up, down = C.powers(C.BYTE_BASE, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(C._values[data] * up[:n], out=sums[1:])
    grams = C.mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    m = len(grams)
    # smallest in every window of w: the hash's upper bits, then the place inside the block pair
    pad = -(-m // w) * w
    bits = np.uint64(PLACE_BITS)  # the same for all slices, so that ties fall alike
    if pad >> PLACE_BITS:
        raise ValueError(f"a text has at most {1 << PLACE_BITS} bytes")
    key = np.full(pad, np.iinfo(np.uint64).max)
    key[:m] = (grams >> bits << bits) | np.arange(m, dtype=np.uint64)
    blocks = key.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    place = (np.minimum(behind[: m - w + 1], ahead[w - 1 : m]) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    sizes = np.maximum(np.diff(offsets) - length + 1, 0)
    r = np.repeat(np.arange(len(sizes)), sizes)
    if not len(r):
        return none, none, none, none, none.view(np.uint64)
    start = np.arange(len(r)) + np.repeat(offsets[:-1] - np.cumsum(sizes) + sizes, sizes)
    p = place[start]
    new = np.concatenate([[True], (p[1:] != p[:-1]) | (r[1:] != r[:-1])])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(start)) - 1
    return r[at], p[at], start[at], start[last], grams[p[at]]


def _put(*columns: np.ndarray) -> bytes:
    planes = [np.ascontiguousarray(c.astype(np.int64).view(np.uint8).reshape(-1, 8).T) for c in columns]
    return C.pack(np.array([len(columns[0])], np.int64), *planes)


def _get(blob: bytes, columns: int) -> list[np.ndarray]:
    raw = C.unpack(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    return [np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 8 + 8 * n * i).reshape(8, n).T).view(np.int64).ravel() for i in range(columns)]


def _all(batches: Iterator[pa.RecordBatch], columns: int, name: str = "blob") -> list[np.ndarray]:
    got = [_get(x.as_py(), columns) for batch in batches for x in batch.column(name)]
    return [np.concatenate(x) for x in zip(*got, strict=True)]


def _dealt(part: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
    """One packed row per part."""
    order = np.argsort(part, kind="stable")
    rows = [(p, _put(*[c[order[lo:hi]] for c in columns])) for p, lo, hi in C.pieces(part[order])]
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], ["part", "blob"])


def _part(values: np.ndarray, groups: int) -> np.ndarray:
    return (C.mix(values.view(np.uint64)) % np.uint64(groups)).astype(np.int32)


def _anchor_rows(length: int, gram: int, groups: int):
    """mapInArrow: texts to packed (anchor, context, document, place) by anchor hash.

    Of equal (anchor, context) pairs a buffer sends the first two places; the others are repeats for
    sure and go to part ``groups`` + bucket of their document.
    """
    def flush(held: list) -> pa.RecordBatch:
        anchor, context, doc, place = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((place, doc, context, anchor))
        anchor, context, doc, place = anchor[order], context[order], doc[order], place[order]
        twice = np.zeros(len(anchor), bool)
        twice[2:] = (anchor[2:] == anchor[:-2]) & (context[2:] == context[:-2]) & ((doc[2:] != doc[:-2]) | (place[2:] != place[:-2])) \
            & ((doc[1:-1] != doc[:-2]) | (place[1:-1] != place[:-2]))
        part = np.where(twice, groups + _part(doc, groups), _part(anchor, groups))
        return _dealt(part.astype(np.int32), [anchor, context, doc, place])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids = C.ids_of(batch.column("id"))
            for lo, _, data, offsets in C.text_slices(batch.column("text")):
                row, place, first, last, anchor = anchors_of(data, offsets, length, gram)
                if not len(row):
                    continue
                context = C.range_hashes(C._values[data], first, last + length, C.WORD_BASE) + (place - first).astype(np.uint64) * np.uint64(C.BYTE_BASE)
                held.append((anchor.view(np.int64), context.view(np.int64), ids[lo + row], place - offsets[row]))
                size += len(row)
                if size >= FLUSH_ANCHORS:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)
    return run


#: What becomes of the windows of an anchor place: all are repeats, as the whole context occurs again;
#: the context is sorted with the anchor's other contexts; the context is cut into windows. A context
#: that occurs again is itself sorted or cut once, for the others to meet it.
WHOLE, SORT, SORT_WHOLE, CUT, CUT_WHOLE = 0, 1, 2, 3, 4


def _repeated_anchors(groups: int):
    """applyInArrow on one part: (document bucket, packed (document, place, what)) of repeated anchors."""
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, context, doc, place = _all(batches, 4)
        if key[0].as_py() >= groups:
            yield _dealt(_part(doc, groups), [doc, place, np.full(len(doc), WHOLE)])
            return
        order = np.lexsort((place, doc, context, anchor))
        anchor, context, doc, place = anchor[order], context[order], doc[order], place[order]
        # a place given twice counts once
        fresh = np.ones(len(anchor), bool)
        fresh[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1]) | (context[1:] != context[:-1]) | (anchor[1:] != anchor[:-1])
        anchor, context, doc, place = anchor[fresh], context[fresh], doc[fresh], place[fresh]
        head = np.ones(len(anchor), bool)
        head[1:] = anchor[1:] != anchor[:-1]
        lead = head.copy()
        lead[1:] |= context[1:] != context[:-1]
        kinds = np.cumsum(lead) - 1
        copies = np.bincount(kinds)[kinds]
        groups_of = np.cumsum(head) - 1
        places, contexts = np.bincount(groups_of)[groups_of], np.bincount(groups_of, weights=lead).astype(np.int64)[groups_of]
        what = np.full(len(anchor), -1)
        what[(places > 1) & (copies > 1)] = WHOLE
        again = (copies > 1) & lead & (places > 1)
        what[again & (contexts > 1)] = SORT_WHOLE
        what[(copies == 1) & (contexts > 1)] = SORT
        hot = contexts > HOT
        what[hot & (what == SORT)] = CUT
        what[hot & (what == SORT_WHOLE)] = CUT_WHOLE
        keep = what >= 0
        yield _dealt(_part(doc[keep], groups), [doc[keep], place[keep], what[keep]])
    return run


def _by_document(columns: int):
    """applyInArrow on one document bucket: one packed row per document."""
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _all(batches, columns)
        order = np.argsort(got[0], kind="stable")
        got = [c[order] for c in got]
        rows = [(d, _put(*[c[lo:hi] for c in got[1:]])) for d, lo, hi in C.pieces(got[0])]
        yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([b for _, b in rows], pa.binary())], ["id", "marks"])
    return run


def _contexts(length: int, gram: int, groups: int):
    """mapInArrow on texts with their marks: contexts to sort, cut windows, and whole repeats.

    kind 0: (shard, document, first window, bytes) to sort; 1: packed window hashes; 2: packed
    (document, first, last) of windows that repeat, by document bucket.
    """
    names = ["kind", "part", "doc", "first", "blob"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = C.ids_of(batch.column("id"))
            marks = batch.column("marks")
            out: list[tuple] = []
            cut: list[tuple] = []
            whole: list[tuple] = []
            for lo, _, data, offsets in C.text_slices(batch.column("text")):
                row, place, first, last, anchor = anchors_of(data, offsets, length, gram)
                cuts = np.searchsorted(row, np.arange(len(offsets)))
                values = None
                for r in range(len(offsets) - 1):
                    s = slice(cuts[r], cuts[r + 1])
                    at, what = _get(marks[lo + r].as_py(), 2)
                    own, doc = place[s] - offsets[r], ids[lo + r]
                    if not len(own):
                        continue
                    # several buffers may speak of one place: sorting and cutting say more than "whole"
                    order = np.lexsort((what, at))
                    at, what = at[order], what[order]
                    tail = np.append(at[1:] != at[:-1], True)
                    at, what = at[tail], what[tail]
                    i = np.minimum(np.searchsorted(own, at), len(own) - 1)
                    good = own[i] == at
                    i, what = i[good], what[good]
                    f, t, a = first[s][i], last[s][i], anchor[s][i]
                    sure = (what == WHOLE) | (what == SORT_WHOLE) | (what == CUT_WHOLE)
                    whole.append((np.full(int(sure.sum()), doc), f[sure] - offsets[r], t[sure] - offsets[r]))
                    for j in np.flatnonzero((what == SORT) | (what == SORT_WHOLE)):
                        shard = int(C.mix(a[j : j + 1])[0] % np.uint64(max(1, groups // 2)))  # a sorter likes long texts
                        out.append((0, shard, doc, int(f[j] - offsets[r]), data[f[j] : t[j] + length].tobytes()))
                    single = np.flatnonzero((what == CUT) | (what == CUT_WHOLE))
                    if len(single):
                        if values is None:
                            values = C._values[data]
                        starts = np.concatenate([np.arange(f[j], t[j] + 1) for j in single])
                        lo_b, hi_b = int(starts.min()), int(starts.max()) + length
                        h = C.range_hashes(values[lo_b:hi_b], starts - lo_b, starts - lo_b + length, C.BYTE_BASE)
                        cut.append((h.view(np.int64), np.full(len(starts), doc), starts - offsets[r]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names)
            for kind, held, by in ((1, cut, 0), (2, whole, 0)):
                if not held:
                    continue
                cols = [np.concatenate(c) for c in zip(*held, strict=True)]
                packed = _dealt(_part(cols[by], groups), cols)
                n = packed.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), packed.column("part"), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()),
                                                  packed.column("blob")], names)
    return run


def _sorted_shard(length: int, groups: int, memory: int):
    """applyInArrow on one (kind, part): packed (document, first, last) of repeated windows by document bucket."""
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = key[0].as_py()
        if kind == 2:
            doc, first, last = _all(batches, 3)
            yield _dealt(_part(doc, groups), [doc, first, last])
            return
        if kind == 1:
            h, doc, start = _all(batches, 3)
            order = np.lexsort((start, doc, h))
            h, doc, start = h[order], doc[order], start[order]
            fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])])
            h, doc, start = h[fresh], doc[fresh], start[fresh]
            new = np.concatenate([[True], h[1:] != h[:-1]])
            runs = np.cumsum(new) - 1
            hit = np.bincount(runs)[runs] > 1
            yield _dealt(_part(doc[hit], groups), [doc[hit], start[hit], start[hit]])
            return
        docs, firsts, texts, seen = [], [], [], set()
        for batch in batches:
            for d, f, text in zip(batch.column("doc").to_pylist(), batch.column("first").to_pylist(), batch.column("blob"), strict=True):
                if (d, f) not in seen:  # else a row given twice
                    seen.add((d, f))
                    docs.append(d)
                    firsts.append(f)
                    texts.append(text.as_py())
        sizes = np.array([len(t) + 1 for t in texts])
        starts = np.cumsum(sizes) - sizes
        text = np.zeros(int(sizes.sum()), np.uint16)
        body = np.ones(len(text), bool)
        body[starts + sizes - 1] = False
        text[body] = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16) + 1
        flags = repeated_places(text, length, memory)
        hit = np.flatnonzero(flags)
        owner = np.searchsorted(starts, hit, "right") - 1
        doc, place = np.array(docs)[owner], np.array(firsts)[owner] + hit - starts[owner]
        yield _dealt(_part(doc, groups), [doc, place, place])
    return run


def _removed(length: int, digest: bool, names: list[str]):
    """mapInArrow on texts with their repeats: maximal runs and what is left."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: dict[str, list] = {"n": [], "removed": [], "spans": [], "kept": []}
            for text, marks in zip(batch.column("text"), batch.column("marks"), strict=True):
                raw = (text.as_py() or "").encode()
                removed = spans = 0
                if marks.is_valid:
                    first, last = _get(marks.as_py(), 2)
                    good = last + length <= len(raw)
                    delta = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(delta, first[good], 1)
                    np.add.at(delta, last[good] + length, -1)
                    gone = np.cumsum(delta[:-1]) > 0
                    removed = int(gone.sum())
                    spans = int(np.count_nonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)) > 0))
                    raw = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                cols["n"].append(len(raw) + removed)
                cols["removed"].append(removed)
                cols["spans"].append(spans)
                cols["kept"].append(hashlib.sha256(raw).hexdigest() if digest else raw)
            kept = pa.array(cols["kept"], pa.string() if digest else pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *[pa.array(cols[c], pa.int64()) for c in ("n", "removed", "spans")], kept],
                                             [*names, "_n_bytes", "_n_removed", "_n_spans", "_kept"])
    return run


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, memory: int = MEMORY, id_col: str = "doc_id", text_col: str = "text",
                          digest: bool = False) -> DataFrame:
    """All rows plus ``_n_bytes``, ``_n_removed``, ``_n_spans`` and ``_kept`` (the remaining bytes, or
    their sha256 where ``digest`` is set; a cut may fall inside a character)."""
    if not 0 < gram <= length:
        raise ValueError("an anchor is at most as long as a window")
    groups = C.groups_for(docs.sparkSession, 2)
    ident = F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"))
    keep = [id_col] if digest else docs.columns
    names = [f"c{i}" for i in range(len(keep))]
    texts = docs.select(ident.alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    packed = texts.mapInArrow(_anchor_rows(length, gram, groups), "part int, blob binary")
    marks = packed.groupBy("part").applyInArrow(_repeated_anchors(groups), "part int, blob binary")
    marks = marks.groupBy("part").applyInArrow(_by_document(3), "id long, marks binary")
    pieces = texts.join(marks, "id").mapInArrow(_contexts(length, gram, groups), "kind int, part int, doc long, first long, blob binary")
    found = pieces.groupBy("kind", "part").applyInArrow(_sorted_shard(length, groups, memory), "part int, blob binary")
    found = found.groupBy("part").applyInArrow(_by_document(3), "id long, marks binary")
    side = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], ident.alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    joined = side.join(found, "id", "left")
    schema = ", ".join(f"{n} {t}" for n, t in side.select(*names).dtypes)
    out = joined.mapInArrow(_removed(length, digest, names), f"{schema}, _n_bytes long, _n_removed long, _n_spans long, _kept {'string' if digest else 'binary'}")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "_n_bytes", "_n_removed", "_n_spans", "_kept")


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Digest of the operator over all documents, strings of 200 bytes."""
    out = remove_repeated_bytes(C.documents_of(spark, sf_dir), digest=True)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"),
                      F.col("_n_spans").alias("n_spans"), F.col("_kept").alias("kept_sha256"))
