"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of segments. A segment holds some hundred thousand consecutive words of
whole documents: the distinct terms (64-bit word hashes, sorted), their counts, and for every
term the ascending places of its postings, numbered through all documents of the segment, as
compressed steps. Counts are columns of their own: choosing terms reads no postings.

1. Benchmark items become windows of ``window`` words (an item of fewer words is one window);
   equal windows are one, whichever items hold them.
2. Terms of segments meet terms of windows by an equi-join; their counts add up to the
   frequency of each test term in the whole corpus. Every window orders its terms from the
   rarest to the most frequent; one that holds a term the corpus lacks cannot occur.
3. A window goes to the segments that hold its rarest term. There the lists of its terms,
   each moved back by the term's offset in the window, are intersected from the rarest on, for
   all windows at once by binary search; what is left are exact phrase matches that lie in one
   document. ``near_matches`` intersects the same lists up to a distance and returns the
   smallest spans that hold all terms in any order.

Scale: nothing is replicated but windows to segments that hold their rarest term, in chunks of
``CHUNK_WINDOWS``; a very frequent term is a list in every segment, never one list of its own, so
no group grows with the corpus. Candidates are expanded a bounded number at a time. The index is written to
the shared folder and serves any number of tests.

Words: A-Z lower-cased, runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]``. Terms are equal where their
64-bit hashes are. Defined cases: null and empty texts have no words, never match, and still
give a row; every input row is a document of its own, also where ids are null or shared; items
without words have no window; rows that share an item id are one item, a null item id counts as
the empty text; extra columns play no part whatever their names; a document longer than a
segment is a segment of its own. Empty tables on either side give no match.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compoundry.llm import common as C

SEGMENT_WORDS, SEGMENT_DOCS = 500_000, 20_000
CHUNK_WINDOWS = 65_536
CANDIDATES = 1_000_000

#: Bytes as the words see them: separators become spaces, A-Z become a-z.
_fold = np.full(256, 32, np.uint8)
for _lo, _hi in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    _fold[_lo : _hi + 1] = np.arange(_lo, _hi + 1)
_fold[0x41:0x5B] = np.arange(0x61, 0x7B)

_INDEX = "segment long, doc_ids array<long>, n_words array<int>, terms array<long>, counts array<int>, postings binary"


def _list(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _word_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, word hashes and words per row of slices of a text column."""
    for lo, hi, data, offsets in C.text_slices(column):
        words = C.words_of(_fold[data], offsets)
        yield lo, hi, words.hashes(False), words.per_row


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow on (id, text): one row per segment."""
    task, done = TaskContext.get().partitionId(), 0

    def flush(hashes: list, per_row: list, ids: list) -> pa.RecordBatch:
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")  # words come in order of place, so lists do too
        h = h[order]
        first = np.flatnonzero(np.concatenate([[len(h) > 0], h[1:] != h[:-1]])[: len(h)])
        steps = np.diff(order, prepend=0)
        steps[first] = order[first]
        counts = np.diff(np.append(first, len(h)))
        return pa.RecordBatch.from_arrays([
            pa.array([(task << 32) + done], pa.int64()), _list(pa.concat_arrays(ids)), _list(pa.array(np.concatenate(per_row).astype(np.int32))),
            _list(pa.array(h[first].view(np.int64))), _list(pa.array(counts.astype(np.int32))),
            pa.array([C.pack(steps.astype(np.uint32))], pa.binary())], ["segment", "doc_ids", "n_words", "terms", "counts", "postings"])

    hashes, per_row, ids, words, docs = [], [], [], 0, 0
    for batch in batches:
        id_column = batch.column("id").cast(pa.int64())
        for lo, hi, h, n in _word_hashes(batch.column("text")):
            hashes.append(h)
            per_row.append(n)
            ids.append(id_column.slice(lo, hi - lo))
            words, docs = words + len(h), docs + hi - lo
            if words >= SEGMENT_WORDS or docs >= SEGMENT_DOCS:
                yield flush(hashes, per_row, ids)
                hashes, per_row, ids, words, docs, done = [], [], [], 0, 0, done + 1
    if ids:
        yield flush(hashes, per_row, ids)


@dataclass(frozen=True)
class PositionalIndex:
    """The written segments of a corpus."""

    segments: DataFrame

    def documents(self) -> DataFrame:
        """``segment``, ``place``, ``doc_id`` and ``n_words`` of every indexed row."""
        return self.segments.select("segment", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("place", "d")).select(
            "segment", "place", F.col("d.doc_ids").alias("doc_id"), F.col("d.n_words").cast("long").alias("n_words"))


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> PositionalIndex:
    """Index every row of ``docs``; no shuffle, one write."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return PositionalIndex(C.write_once(rows.mapInArrow(_segments, _INDEX), "postings"))


def _windows(size: int):
    """mapInArrow on (item, text): the windows of every item with their terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("item").to_pylist()
            for lo, _, hashes, per_row in _word_hashes(batch.column("text")):
                length = np.minimum(per_row, size)
                many = np.where(per_row > 0, per_row - length + 1, 0)
                begin = np.repeat(np.cumsum(per_row) - per_row - (np.cumsum(many) - many), many) + np.arange(many.sum())
                length = np.repeat(length, many)
                if not len(begin):
                    continue
                ends = np.cumsum(length)
                terms = hashes[np.repeat(begin - (ends - length), length) + np.arange(ends[-1])]
                yield pa.RecordBatch.from_arrays([
                    pa.array([names[lo + r] for r in np.repeat(np.arange(len(many)), many)], pa.string()),
                    pa.array(C.range_hashes(hashes, begin, begin + length, C.WORD_BASE).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(terms.view(np.int64)))],
                    ["item", "window", "terms"])
    return run


def item_windows(items: DataFrame, size: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item``, ``window`` (hash) and ``terms`` of every window of the test items."""
    if size < 1:
        raise ValueError("a window has at least one word")
    rows = items.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("item"),
                        F.col(f"`{text_col}`").cast("string").alias("text"))
    return C.write_once(rows.mapInArrow(_windows(size), "item string, window long, terms array<long>"), "windows")


def _asked(index: PositionalIndex, windows: DataFrame, any_order: bool) -> DataFrame:
    """``segment``, ``chunk`` and the windows to look for there, terms from the rarest on."""
    terms = windows.select(F.explode("terms").alias("term")).distinct()
    listed = index.segments.select("segment", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select(
        "segment", F.col("t.terms").alias("term"), F.col("t.counts").alias("n"))
    listed = C.write_once(listed.join(terms, "term", "left_semi"), "listed")
    frequency = listed.groupBy("term").agg(F.sum("n").alias("n"))
    each = windows.groupBy("window").agg(F.first("terms").alias("terms"))
    if any_order:
        each = each.withColumn("terms", F.array_distinct("terms"))
    each = C.write_once(each, "distinct-windows")
    chunks = max(1, -(-each.count() // CHUNK_WINDOWS))
    known = each.select("window", F.posexplode("terms").alias("at", "term")).join(frequency, "term", "left")
    # at most one row per word of a window: the groups are bounded by its length
    plans = known.groupBy("window").agg(F.sort_array(F.collect_list(F.struct("n", "at", "term"))).alias("plan"))
    plans = plans.where(~F.exists("plan", lambda t: t["n"].isNull()))
    plans = plans.select(F.col("plan")[0]["term"].alias("term"), "window", F.transform("plan", lambda t: F.struct(t["at"], t["term"])).alias("plan"))
    found = listed.select("segment", "term").join(plans, "term").withColumn("chunk", F.pmod("window", F.lit(chunks)))
    return found.groupBy("segment", "chunk").agg(F.collect_list(F.struct("window", "plan")).alias("asked"))


class _Segment:
    """One segment's lists, ready to be searched."""

    def __init__(self, n_words, terms, counts, postings):
        self.terms, self.counts = terms.view(np.uint64), counts.astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        total = np.cumsum(np.frombuffer(C.unpack(postings), np.uint32).astype(np.int64))
        self.places = total - np.repeat(np.concatenate([[0], total])[self.first], self.counts)
        #: (term, place) of all postings as one ascending number
        self.keys = np.repeat(np.arange(len(terms)) << 32, self.counts) | self.places
        self.doc_first = np.concatenate([[0], np.cumsum(n_words.astype(np.int64))])

    def slots(self, terms: np.ndarray) -> np.ndarray:
        """Number of each term, -1 where the segment lacks it."""
        at = np.minimum(np.searchsorted(self.terms, terms.view(np.uint64)), len(self.terms) - 1)
        return np.where(self.terms[at] == terms.view(np.uint64), at, -1)

    def next_place(self, slot: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The first posting of each term at or behind a place; beyond all places where there is none."""
        at = np.searchsorted(self.keys, (slot << 32) | place)
        key = self.keys[np.minimum(at, len(self.keys) - 1)]
        return np.where((at < len(self.keys)) & (key >> 32 == slot), key & 0xFFFFFFFF, 1 << 40)

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_first, place, "right") - 1


def _expansions(segment: _Segment, slot: np.ndarray, begin: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window number, place of its rarest term), a bounded number at a time; a list may be split."""
    size = segment.counts[slot[begin]]
    edges, total = np.concatenate([[0], np.cumsum(size)]), int(size.sum())
    for lo in range(0, total, CANDIDATES):
        at = np.arange(lo, min(total, lo + CANDIDATES))
        w = np.searchsorted(edges, at, "right") - 1
        yield w, segment.places[segment.first[slot[begin[w]]] + at - edges[w]]


def _asked_arrays(asked: pa.ListScalar) -> tuple[np.ndarray, ...]:
    """Window hashes, then for the flat plans: first term, length, offsets and terms."""
    window, plan = asked.values.flatten()
    at, term = plan.flatten().flatten()
    begin = plan.offsets.to_numpy() - plan.offsets[0].as_py()
    return window.to_numpy(), begin[:-1].astype(np.int64), np.diff(begin).astype(np.int64), at.to_numpy().astype(np.int64), term.to_numpy()


def _phrases(segment: _Segment, begin, length, offset, slot) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(window number, first place) of exact matches inside one document."""
    for w, place in _expansions(segment, slot, begin):
        doc = segment.document(place)
        start = place - offset[begin[w]]
        good = (start >= segment.doc_first[doc]) & (start + length[w] <= segment.doc_first[doc + 1])
        w, start = w[good], start[good]
        for rank in range(1, int(length.max(initial=0))):
            more = length[w] > rank
            at = begin[w[more]] + rank
            want = start[more] + offset[at]
            good = np.ones(len(w), bool)
            good[more] = segment.next_place(slot[at], want) == want
            w, start = w[good], start[good]
        yield w, start


def _spans_near(segment: _Segment, begin, length, slot, within: int) -> Iterator[tuple[int, int, int]]:
    """(window number, first place, end) of the smallest spans that hold all terms of a window."""
    seen = set()
    for w, place in _expansions(segment, slot, begin):
        doc = segment.document(place)
        for rank in range(1, int(length.max(initial=0))):
            more = length[w] > rank
            low = np.maximum(place[more] - within + 1, segment.doc_first[doc[more]])
            high = np.minimum(place[more] + within, segment.doc_first[doc[more] + 1])
            good = np.ones(len(w), bool)
            good[more] = segment.next_place(slot[begin[w[more]] + rank], low) < high
            w, place, doc = w[good], place[good], doc[good]
        seen |= set(zip(w.tolist(), doc.tolist(), strict=True))
    for w, doc in sorted(seen):
        lo, hi = segment.doc_first[doc], segment.doc_first[doc + 1]
        marks = []
        for s in slot[begin[w] : begin[w] + length[w]]:
            mine = segment.places[segment.first[s] : segment.first[s] + segment.counts[s]]
            marks += [(int(p), int(s)) for p in mine[np.searchsorted(mine, lo) : np.searchsorted(mine, hi)]]
        marks.sort()
        inside: dict[int, int] = {}
        left = 0
        last = None
        for place, s in marks:
            inside[s] = inside.get(s, 0) + 1
            while inside[marks[left][1]] > 1:
                inside[marks[left][1]] -= 1
                left += 1
            if len(inside) == length[w] and place - marks[left][0] < within:
                span = (marks[left][0], place + 1)
                # a span that begins where the last one did holds it
                if last is None or span[0] != last[0]:
                    yield w, *span
                    last = span


def _matches(within: int | None):
    """mapInArrow on segments joined with what is asked of them."""
    def found(segment: _Segment, asked: pa.ListScalar) -> tuple[np.ndarray, ...]:
        window, begin, length, offset, term = _asked_arrays(asked)
        slot = segment.slots(term) if len(segment.terms) else np.full(len(term), -1)
        here = np.logical_and.reduceat(slot >= 0, begin) if len(begin) else np.zeros(0, bool)
        window, begin, length = window[here], begin[here], length[here]
        if within is None:
            got = list(_phrases(segment, begin, length, offset, slot))
            w, start = (np.concatenate([g[i] for g in got]) if got else np.zeros(0, np.int64) for i in (0, 1))
            end = start + length[w]
        else:
            w, start, end = np.array(list(_spans_near(segment, begin, length, slot, within)), np.int64).reshape(-1, 3).T
        doc = segment.document(start)
        order = np.lexsort((end, start, doc))
        base = segment.doc_first[doc]
        return tuple(x[order] for x in (doc, start - base, end - base, window[w]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                parts = [batch.column(c)[i].values.to_numpy() for c in ("n_words", "terms", "counts")]
                doc, start, end, window = found(_Segment(*parts, batch.column("postings")[i].as_py()), batch.column("asked")[i])
                ids = batch.column("doc_ids")[i].values
                for lo in range(0, len(doc), CANDIDATES):
                    cut = slice(lo, lo + CANDIDATES)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(doc[cut]), batch.column("segment")[i].as_py()), pa.int64()), pa.array(doc[cut].astype(np.int32)),
                        ids.take(pa.array(doc[cut])), pa.array(start[cut]), pa.array(end[cut]), pa.array(window[cut])],
                        ["segment", "place", "doc_id", "start", "end", "window"])
    return run


_MATCH = "segment long, place int, doc_id long, start long, end long, window long"


def _searched(index: PositionalIndex, windows: DataFrame, within: int | None) -> DataFrame:
    return index.segments.join(_asked(index, windows, within is not None), "segment").mapInArrow(_matches(within), _MATCH)


def phrase_matches(index: PositionalIndex, windows: DataFrame) -> DataFrame:
    """Every occurrence of every distinct window: ``segment``, ``place`` (row of the segment), ``doc_id``,
    ``start``, ``end`` (words) and ``window``; join ``windows`` on ``window`` for the items."""
    return _searched(index, windows, None)


def near_matches(index: PositionalIndex, windows: DataFrame, within: int) -> DataFrame:
    """Smallest spans of at most ``within`` words that hold all different words of a window, in any order."""
    return _searched(index, windows, within)


def _union(spans):
    """Number of words in the union of sorted spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    return F.aggregate(spans, start, lambda acc, s: F.struct(
        (acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["to"]), F.lit(0))).alias("n"),
        F.greatest(acc["to"], s["end"]).alias("to")))["n"]


def contamination(index: PositionalIndex, items: DataFrame, window: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per indexed row: ``doc_id``, ``n_words``, ``n_hit`` (words inside a match), ``spans`` (start, end of the
    merged matches) and ``items`` (sorted ids, as text, of the items with a matching window)."""
    windows = item_windows(items, window, id_col, text_col)
    matches = C.write_once(phrase_matches(index, windows), "matches")
    doc = ["segment", "place"]
    # matches that start at one word are one span, and spans that touch merge: runs by the furthest end so far
    spans = matches.groupBy(*doc, "start").agg(F.max("end").alias("end"))
    spans = spans.groupBy(*doc).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("all"))
    spans = spans.select(*doc, _union(F.col("all")).alias("n_hit"), F.aggregate(
        "all", F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (s["start"] <= F.element_at(acc, -1)["end"]),
                              F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
                                  F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(s)))).alias("spans"))
    owners = windows.select("window", "item").distinct()
    named = matches.select(*doc, "window").distinct().join(owners, "window").select(*doc, "item").distinct()
    named = named.groupBy(*doc).agg(F.sort_array(F.collect_list("item")).alias("items"))
    out = index.documents().join(spans.join(named, doc), doc, "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
                      F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("spans"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op12_positional_index(spark, sf_dir: str) -> DataFrame:
    """Hits of ten-word windows of all benchmark items in all documents."""
    index = build_index(C.documents_of(spark, sf_dir))
    out = contamination(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
