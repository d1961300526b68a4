"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

1. Each task hashes all windows of its texts with rolling sums. Of a window that repeats
   inside the task's buffer, only the earliest place is sent to the hash's group; the others
   are repeats whatever happens elsewhere, and go straight to their documents. That is the
   map-side combine: a passage of a third of all documents costs one row per buffer.
2. Each hash group sorts its windows by (hash, document, start); all but the first place of a
   hash are repeats.
3. Repeats meet the texts again by document, overlapping windows merge into maximal removal
   intervals, and the kept words are joined.

Windows travel packed (hash, document run, start), about 11 bytes each, so one exchange of
the windows and one of the texts is all that moves. Equality is that of 64-bit hashes of
random word values; n windows collide by chance with probability n*n / 2**65.

Defined cases: a null or empty text has no words and stays empty; a text shorter than a window
loses nothing; a null id counts as smaller than all others (ids are at least ``-2**62``). Rows that
share an id and a text are one document given several times, so equal places of theirs are never
"earlier" than one another; rows that share an id, or have none, but differ in their texts are documents
of their own, in the order of a hash of the text. A text of any length is held once, by its task. All
input columns stay, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from compoundry.llm import common as C

FLUSH_WINDOWS = 2_000_000


def _packed(part: np.ndarray, hashes: np.ndarray, doc: np.ndarray, tie: np.ndarray, start: np.ndarray, sent: np.ndarray) -> pa.RecordBatch:
    """One row per group: hashes as they are; documents as runs and starts as steps, compressed."""
    order = np.lexsort((start, tie, doc, part))
    part, hashes, doc, tie, start = part[order], hashes[order], doc[order], tie[order], start[order]
    rows: dict[str, list] = {"part": [], "hashes": [], "places": []}
    for p, lo, hi in C.pieces(part):
        rows["part"].append(p)
        rows["hashes"].append(hashes[lo:hi].tobytes() if sent[p] else b"")
        rows["places"].append(_places(doc[lo:hi], tie[lo:hi], start[lo:hi]))
    return pa.RecordBatch.from_arrays([pa.array(rows["part"], pa.int32()), pa.array(rows["hashes"], pa.binary()),
                                       pa.array(rows["places"], pa.binary())], ["part", "hashes", "places"])


def _changes(doc: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Where a run of one document begins."""
    return np.flatnonzero(np.concatenate([[len(doc) > 0], (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1])])[: len(doc)])


def _places(doc: np.ndarray, tie: np.ndarray, start: np.ndarray) -> bytes:
    first = _changes(doc, tie)
    steps = np.diff(start, prepend=0)
    steps[first] = start[first]
    ids = doc[first]
    return C.pack(np.array([len(first), len(doc)], np.int64), np.diff(ids, prepend=0), tie[first],
                  np.diff(np.append(first, len(doc))).astype(np.uint32), steps.astype(np.uint32))


def _read_places(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, tie and start of every place."""
    raw = C.unpack(blob)
    runs, n = np.frombuffer(raw, np.int64, 2)
    ids = np.cumsum(np.frombuffer(raw, np.int64, runs, 16))
    ties = np.frombuffer(raw, np.int32, runs, 16 + 8 * runs)
    counts = np.frombuffer(raw, np.uint32, runs, 16 + 12 * runs)
    steps = np.frombuffer(raw, np.uint32, n, 16 + 16 * runs).astype(np.int64)
    total = np.cumsum(steps)
    first = np.cumsum(counts) - counts
    base = np.concatenate([[0], total])[first]
    return np.repeat(ids, counts), np.repeat(ties, counts), total - np.repeat(base, counts)


def window_rows(window: int, groups: int, id_name: str, text_name: str):
    """mapInArrow: texts to packed windows (group >= 0) and known repeats (group ``groups``)."""
    sent = np.ones(groups + 1, bool)
    sent[groups] = False

    def flush(kept: list) -> pa.RecordBatch:
        hashes, doc, tie, start = (np.concatenate(x) for x in zip(*kept, strict=True))
        order = np.lexsort((start, tie, doc, hashes))
        hashes, doc, tie, start = hashes[order], doc[order], tie[order], start[order]
        part = (hashes % np.uint64(groups)).astype(np.int32)
        again = np.zeros(len(hashes), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & ((doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (start[1:] != start[:-1]))
        # equal places of one document stay with the first of their hash
        part[again] = groups
        return _packed(part, hashes, doc, tie, start, sent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for batch in batches:
            ids, ties = (batch.column(c).to_numpy(zero_copy_only=False) for c in (id_name, "tie"))
            for lo, _, data, offsets in C.text_slices(batch.column(text_name)):
                words = C.words_of(data, offsets)
                at = np.flatnonzero(words.row[: 1 - window or None] == words.row[window - 1 :]) if len(words.row) >= window else []
                if not len(at):
                    continue
                hashes = C.range_hashes(words.hashes(False), at, at + window, C.WORD_BASE)
                row = words.row[at]
                kept.append((hashes, ids[lo + row], ties[lo + row], at - words.first[row]))
                size += len(at)
                if size >= FLUSH_WINDOWS:
                    yield flush(kept)
                    kept, size = [], 0
        if kept:
            yield flush(kept)
    return run


def _repeats(groups: int):
    """applyInArrow on one group: all places but the earliest of each hash, one row per document."""
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key[0].as_py() == groups:
            for batch in batches:
                for blob in batch.column("places"):
                    yield _dealt(*_read_places(blob.as_py()), groups)
            return
        hashes, places = [], []
        for batch in batches:
            for h, blob in zip(batch.column("hashes"), batch.column("places"), strict=True):
                places.append(_read_places(blob.as_py()))
                hashes.append(np.frombuffer(h.as_py(), np.uint64))
        h = np.concatenate(hashes)
        d, t, s = (np.concatenate(x) for x in zip(*places, strict=True))
        order = np.lexsort((s, t, d, h))
        h, d, t, s = h[order], d[order], t[order], s[order]
        begin = np.concatenate([[True], h[1:] != h[:-1]])
        first = np.maximum.accumulate(np.where(begin, np.arange(len(h)), 0))
        again = (d != d[first]) | (t != t[first]) | (s != s[first])
        yield _dealt(d[again], t[again], s[again], groups)
    return run


def _dealt(doc: np.ndarray, tie: np.ndarray, start: np.ndarray, groups: int) -> pa.RecordBatch:
    """Repeats of all documents of a bucket as one row."""
    bucket = (C.mix(doc.view(np.uint64)) % np.uint64(groups)).astype(np.int32)
    order = np.lexsort((start, tie, doc, bucket))
    bucket, doc, tie, start = bucket[order], doc[order], tie[order], start[order]
    runs = list(C.pieces(bucket))
    return pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in runs], pa.int32()),
                                       pa.array([_places(doc[lo:hi], tie[lo:hi], start[lo:hi]) for _, lo, hi in runs], pa.binary())], ["bucket", "places"])


def _by_document(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """applyInArrow on one bucket: one row per document with the starts of its repeats."""
    got = [_read_places(blob.as_py()) for batch in batches for blob in batch.column("places")]
    doc, tie, start = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.lexsort((start, tie, doc))
    doc, tie, start = doc[order], tie[order], start[order].astype(np.uint32)
    first = _changes(doc, tie)
    yield pa.RecordBatch.from_arrays([
        pa.array(doc[first]), pa.array(tie[first]),
        pa.array([start[lo:hi].tobytes() for lo, hi in zip(first, np.append(first[1:], len(doc)), strict=True)], pa.binary())], ["_doc", "_tie", "_starts"])


def document_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """Order of a row among all documents, and a hash of its text that tells rows of one id apart."""
    ident, same = F.col(f"`{id_col}`").cast("long"), F.xxhash64(F.col(f"`{text_col}`").cast("string"))
    return F.coalesce(ident, F.lit(C.NULL_ID) + F.shiftrightunsigned(same, 2)), same.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def repeated_windows(docs: DataFrame, window: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_doc``, ``_tie`` (see ``document_key``) and ``_starts`` (packed uint32) of windows that also start earlier."""
    groups = C.groups_for(docs.sparkSession)
    key, tie = document_key(id_col, text_col)
    rows = docs.select(key.alias("id"), tie.alias("tie"), F.col(f"`{text_col}`").cast("string").alias("text"))
    packed = rows.mapInArrow(window_rows(window, groups, "id", "text"), "part int, hashes binary, places binary")
    # known repeats are dealt out evenly: their key carries a salt
    packed = packed.withColumn("salt", F.when(F.col("part") == groups, F.pmod(F.xxhash64("places"), F.lit(groups))).otherwise(F.lit(0)))
    found = packed.groupBy("part", "salt").applyInArrow(_repeats(groups), "bucket int, places binary")
    return found.groupBy("bucket").applyInArrow(_by_document, "_doc long, _tie int, _starts binary")


def _cut(window: int, names: list[str], text_at: str, digest: bool):
    """mapInArrow on texts joined with their repeats: merged intervals, kept words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"n_words": [], "n_removed": [], "n_spans": [], "kept": []}
            for text, blobs in zip(batch.column(text_at), batch.column("_starts"), strict=True):
                words = (text.as_py() or "").encode().split()
                marks = blobs.as_py()
                spans = 0
                if marks:
                    starts = np.frombuffer(marks, np.uint32).astype(np.int64)
                    starts = starts[starts + window <= len(words)]
                    delta = np.zeros(len(words) + 1, np.int64)
                    np.add.at(delta, starts, 1)
                    np.add.at(delta, starts + window, -1)
                    keep = np.cumsum(delta[:-1]) == 0
                    spans = int(np.count_nonzero(np.diff(np.concatenate([[True], keep]).astype(np.int8)) < 0))
                    left = list(compress(words, keep))
                else:
                    left = words
                joined = b" ".join(left)
                out["n_words"].append(len(words))
                out["n_removed"].append(len(words) - len(left))
                out["n_spans"].append(spans)
                if digest:
                    out["kept"].append(hashlib.sha256(joined).hexdigest())
                else:  # an untouched text keeps its own white space
                    out["kept"].append(joined.decode() if marks else text.as_py())
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()),
                                                     pa.array(out["n_spans"], pa.int64()), pa.array(out["kept"], pa.string())],
                [*names, "_n_words", "_n_removed", "_n_spans", "_kept"])
    return run


def remove_repeated_windows(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text",
                            digest: bool = False) -> DataFrame:
    """All rows and columns, plus ``_n_words``, ``_n_removed``, ``_n_spans`` (removal intervals)
    and ``_kept``: the remaining text, or its sha256 where ``digest`` is set.

    The kept text is the kept words joined by one space; without ``digest`` a text that loses
    nothing stays as it is.
    """
    if window < 1:
        raise ValueError("a window has at least one word")
    found = repeated_windows(docs, window, id_col, text_col)
    key, tie = document_key(id_col, text_col)
    keep = [id_col] if digest else docs.columns
    side = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)],
                       F.col(f"`{text_col}`").cast("string").alias("_text"), key.alias("_doc"), tie.alias("_tie"))
    joined = side.join(found, ["_doc", "_tie"], "left").drop("_doc", "_tie")
    names = [f"c{i}" for i in range(len(keep))]
    schema = ", ".join(f"{n} {t}" for n, t in side.select(*names).dtypes)
    out = joined.mapInArrow(_cut(window, names, "_text", digest),
                            f"{schema}, _n_words long, _n_removed long, _n_spans long, _kept string")
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "_n_words", "_n_removed", "_n_spans", "_kept")


def op4_substring_words(spark, sf_dir: str) -> DataFrame:
    """Digest of the operator over all documents, windows of 20 words."""
    out = remove_repeated_windows(C.documents_of(spark, sf_dir), 20, digest=True)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_n_words").alias("n_words"),
                      F.col("_n_removed").alias("n_removed"), F.col("_kept").alias("kept_sha256"),
                      F.col("_n_spans").alias("n_spans"))
