"""Katz backoff language model: Good-Turing discounts, exact backoff weights, scores per document.

Tokens are the words of a text (A-Z lower-cased) and one end. The model has bigrams that back
off to single words, and single words that back off to one unknown word:

    P(b | a) = d2(r) r / C(a)            where the pair was seen r > 0 times
             = alpha(a) P(b)             else; alpha is 1 for a context never seen
    P(b)     = d1(c) c / N               where the word was seen c > 0 times
             = the mass left over        for the unknown word

Discounts of counts 1 to 5 are Good-Turing's in Katz's form; counts above keep 99.9 % (so that
a context whose followers are all frequent still leaves mass). alpha(a) is the left-over mass
of a divided by ``1 - sum of P(b) over the followers of a``, both from integer sums over
the followers, so every context's distribution adds up to one.

Flow. (1) Words are counted. (2) Every pair occurrence goes once, packed, to the group of its
second word (about 5 bytes per token): there the pair's count r and the word's count c meet,
so all terms but alpha are known at once. Frequent words are salted by the first word; their
counts come with a table of at most 65,536 words. Each group writes its part of the bigram
table, of the context sums and of the document sums. (3) Context sums give alpha. (4) Pairs
that were never seen (they occur only in texts outside the training set) are joined with
alpha and complete the sums.

Defined cases: a null or empty text is a lone end token; null ids are one document; rows that
share an id are one document whose tokens add up; without training texts every probability is
that of the unknown word, 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compoundry.llm import common as C

K = 5
KEEP_LARGE = 0.999
CODED = 65_536
FLUSH_TOKENS = 2_000_000
START, END = np.uint64(1 << 62), np.uint64((1 << 62) + 1)
TOP = np.uint64(1 << 63)
SCALE = float(1 << 26)


def discounts(counts: list[int]) -> np.ndarray:
    """Katz's discount of counts 0..K and, last, of larger ones; ``counts[r - 1]`` items have count r.

    Where Good-Turing gives no value in (0, 1), half a count is taken off.
    """
    out = np.full(K + 2, KEEP_LARGE)
    out[0] = 0.0
    n = np.array([0, *counts], float)
    for r in range(1, K + 1):
        d = -1.0
        if n[1] > 0 and n[r] > 0:
            tail = (K + 1) * n[K + 1] / n[1]
            if tail < 1:
                d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail)
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


@dataclass
class Vocabulary:
    """Word figures that every task knows: totals, discounts, and the coded frequent words."""

    total: int
    distinct: int
    unknown: float
    d1: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray
    groups: int
    order: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.order = np.argsort(self.hashes)
        self.sorted = self.hashes[self.order]
        self.salts = np.maximum(1, np.ceil(self.counts * 4.0 * self.groups / max(1, self.total))).astype(np.uint64)

    def code(self, hashes: np.ndarray) -> np.ndarray:
        """Rank of frequent words, the hash with its top bit set for others."""
        if not len(self.sorted):
            return hashes
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.order[at].astype(np.uint64), hashes)

    def word_probability(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.d1[np.minimum(c, K + 1)] * c / max(1, self.total), self.unknown)


def _word_hashes(words: C.Words) -> np.ndarray:
    return words.hashes(True) | TOP


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow on training texts: partial word counts."""
    held, size = [], 0

    def flush() -> pa.RecordBatch:
        w, c = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c)], ["w", "c"])

    for batch in batches:
        for lo, hi, data, offsets in C.text_slices(batch.column("text")):
            held += [_word_hashes(C.words_of(data, offsets)), np.full(hi - lo, END)]
            size += len(held[-2]) + hi - lo
            if size >= 2 * FLUSH_TOKENS:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _planes(x: np.ndarray) -> np.ndarray:
    """Bytes of 64-bit integers by significance: the empty high ones compress away."""
    return np.ascontiguousarray(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T)


def _unplane(raw: bytes, n: int, at: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T).view(np.int64).ravel()


def _put(*columns: np.ndarray) -> bytes:
    """Columns of 64-bit integers of one length."""
    return C.pack(np.array([len(columns[0])], np.int64), *[_planes(c) for c in columns])


def _get(blob: bytes, columns: int) -> list[np.ndarray]:
    raw = C.unpack(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    return [_unplane(raw, n, 8 + 8 * n * i) for i in range(columns)]


def _put_words(w: np.ndarray) -> bytes:
    """Coded words in two bytes, others in eight."""
    small = w < np.uint64(CODED)
    return C.pack(np.array([len(w), small.sum()], np.int64), np.packbits(small), w[small].astype(np.uint16), w[~small])


def _get_words(blob: bytes) -> np.ndarray:
    raw = C.unpack(blob)
    n, k = (int(x) for x in np.frombuffer(raw, np.int64, 2))
    bits = -(-n // 8)
    small = np.unpackbits(np.frombuffer(raw, np.uint8, bits, 16), count=n).astype(bool)
    out = np.empty(n, np.uint64)
    out[small] = np.frombuffer(raw, np.uint16, k, 16 + bits)
    out[~small] = np.frombuffer(raw, np.uint64, n - k, 16 + bits + 2 * k)
    return out


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal tuples in sorted columns."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = False
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _joined(held: list[tuple]) -> list[np.ndarray]:
    """Columns of the held pieces, which are let go: at no time are all columns there twice."""
    columns = [list(x) for x in zip(*held, strict=True)]
    held.clear()
    for i, c in enumerate(columns):
        columns[i] = np.concatenate(c)
        c.clear()
    return columns


def _picked(columns: list[np.ndarray], at: np.ndarray) -> list[np.ndarray]:
    """The columns in a new order."""
    for i in range(len(columns)):
        columns[i] = columns[i][at]
    return columns


def _deal_pairs(v: Vocabulary):
    """mapInArrow: texts to packed pair occurrences per group: words b, their a, documents, times."""
    def flush(held: list) -> Iterator[pa.RecordBatch]:
        a, b, doc, train = _joined(held)
        a, b = v.code(a), v.code(b)
        salt = np.zeros(len(b), np.uint64)
        hot = b < np.uint64(len(v.salts))
        salt[hot] = C.mix(a[hot]) % v.salts[b[hot].astype(np.int64)]
        part = (C.mix(b * np.uint64(C.WORD_BASE) + salt) % np.uint64(v.groups)).astype(np.int32)
        order = np.lexsort((doc, a, b, part))
        a, b, doc, train, part = _picked([a, b, doc, train, part], order)
        entry = _runs(part, b, a, doc)
        times = np.diff(np.append(entry, len(a)))
        a, b, doc, train, part = _picked([a, b, doc, train, part], entry)
        out: list[tuple] = []
        for p, lo, hi in C.pieces(part):
            pair = _runs(b[lo:hi], a[lo:hi])
            word = _runs(b[lo:hi][pair])
            ids, index = np.unique(doc[lo:hi], return_inverse=True)
            flags = np.zeros(len(ids), np.int64)
            flags[index] = train[lo:hi]
            out.append((p, _put_words(b[lo:hi][pair][word]), _put(np.diff(np.append(word, len(pair)))), _put_words(a[lo:hi][pair]),
                        _put(np.diff(np.append(pair, hi - lo))), _put(index, times[lo:hi]), _put(np.diff(ids, prepend=0), flags)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int32()] + 6 * [pa.binary()], strict=True)],
                                         ["part", "b", "nb", "a", "na", "docs", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids = C.ids_of(batch.column("id"))
            flags = batch.column("train").to_numpy(zero_copy_only=False).astype(bool)
            for lo, hi, data, offsets in C.text_slices(batch.column("text")):
                words = C.words_of(data, offsets)
                # every row: its words, then the end
                at = words.first[1:] + np.arange(hi - lo)
                b = np.empty(len(words.row) + hi - lo, np.uint64)
                is_end = np.zeros(len(b), bool)
                is_end[at] = True
                b[is_end], b[~is_end] = END, _word_hashes(words)
                a = np.empty_like(b)
                a[0], a[1:] = START, np.where(is_end[:-1], START, b[:-1])
                row = np.repeat(np.arange(hi - lo), words.per_row + 1)
                held.append((a, b, ids[lo + row], flags[lo + row]))
                size += len(b)
                if size >= FLUSH_TOKENS:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)
    return run


def _count_pairs(v: Vocabulary):
    """applyInArrow on one group: rows of the bigram table, context sums, document sums, unseen pairs."""
    names = ["kind", "bucket", "blob", *[f"n{r}" for r in range(1, K + 2)]]

    def rows(kind: int, key: np.ndarray, columns: list[np.ndarray], counts: list[int] | None = None) -> pa.RecordBatch:
        bucket = (C.mix(key.astype(np.uint64) if key.dtype == np.uint64 else key.view(np.uint64)) % np.uint64(v.groups)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        got = [(int(p), _put(*[c[order[lo:hi]] for c in columns])) for p, lo, hi in C.pieces(bucket[order])]
        if counts is not None and not got:
            got = [(0, _put(*[np.zeros(0, np.int64) for _ in columns]))]
        hist = [[x if i == 0 else 0 for i in range(len(got))] for x in (counts or [0] * (K + 1))]
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(got), pa.int32()), pa.array([p for p, _ in got], pa.int32()),
                                           pa.array([x for _, x in got], pa.binary()), *[pa.array(h, pa.int64()) for h in hist]], names)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i].as_py() for c in ("b", "nb", "a", "na", "docs", "ids")}
                na = _get(r["na"], 1)[0]
                index, count = _get(r["docs"], 2)
                steps, flags = _get(r["ids"], 2)
                held.append((np.repeat(_get_words(r["a"]), na), np.repeat(np.repeat(_get_words(r["b"]), _get(r["nb"], 1)[0]), na),
                             np.cumsum(steps)[index], flags[index].astype(bool), count.astype(np.int32)))
        columns = _joined(held)
        ids, doc = np.unique(columns[2], return_inverse=True)
        columns[2] = doc.astype(np.int32)
        del doc
        order = np.lexsort(columns[:2])
        a, b, doc, train, times = _picked(columns, order)
        del columns, order
        pair = _runs(b, a)
        of_pair = np.diff(np.append(pair, len(a))).astype(np.int32)
        r = np.add.reduceat(times * train, pair, dtype=np.int64)
        a, b = a[pair], b[pair]
        del train, pair
        word = _runs(b)
        c = np.add.reduceat(r, word)
        known = b[word] < np.uint64(len(v.counts))
        c[known] = v.counts[b[word][known].astype(np.int64)]
        c = np.repeat(c, np.diff(np.append(word, len(b))))
        # the bigram table and the context sums: followers by their count and by their word's count
        seen = r > 0
        hist = np.bincount(np.minimum(r[seen], K + 2), minlength=K + 3)
        columns = [b[seen].view(np.int64), a[seen].view(np.int64), r[seen]]
        yield rows(2, columns[0], columns, [int(x) for x in hist[1 : K + 2]])
        ctx, where = np.unique(a[seen], return_inverse=True)
        columns = [ctx.view(np.int64)]
        for n in (r[seen], c[seen]):
            columns += [np.bincount(where[n == k], minlength=len(ctx)) for k in range(1, K + 1)]
            columns.append(np.bincount(where, weights=np.where(n > K, n, 0), minlength=len(ctx)).astype(np.int64))
        del where, n
        if len(ctx):
            yield rows(1, ctx, columns)
        del ctx, columns
        # the document sums: tokens, known ones, base, score without discounts 1..K and without alpha
        # (terms are made per pair and spread over its documents one at a time)
        with np.errstate(divide="ignore"):
            value = np.where(r > K, np.log10(np.maximum(r, 1) * KEEP_LARGE), 0.0) + np.where(r == 0, np.log10(v.word_probability(c)), 0.0)
            value -= np.where((b != end_code(v)) & (c > 0), np.log10(np.maximum(c, 1)), 0.0)
        del b
        add = lambda of: np.bincount(doc, weights=np.repeat(of, of_pair) * times, minlength=len(ids))
        columns = [ids, np.bincount(doc, weights=times, minlength=len(ids)), add(c > 0), np.rint(add(np.log10(c + 1.0)) * SCALE), np.rint(add(value) * SCALE)]
        columns += [add(r == k) for k in range(1, K + 1)]
        yield rows(0, ids, [x.astype(np.int64) for x in columns])
        del c, value, columns
        none = np.repeat(r == 0, of_pair)
        if none.any():
            a = np.repeat(a[r == 0], of_pair[r == 0])
            yield rows(3, a, [ids[doc[none]], a.view(np.int64), times[none]])
    return run


def end_code(v: Vocabulary) -> np.uint64:
    return v.code(np.array([END]))[0]


def _sum_columns(n: int):
    """applyInArrow on packed rows of one bucket: columns added up by the first one."""
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [_get(x.as_py(), n) for batch in batches for x in batch.column("blob")]
        columns = [np.concatenate(x) for x in zip(*got, strict=True)]
        order = np.argsort(columns[0], kind="stable")
        at = _runs(columns[0][order])
        yield pa.RecordBatch.from_arrays([pa.array(columns[0][order][at])] + [pa.array(np.add.reduceat(c[order], at)) for c in columns[1:]],
                                         [f"x{i}" for i in range(n)])
    return run


def _unpacked(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("blob"):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in _get(x.as_py(), n)], [f"x{i}" for i in range(n)])
    return run


def _schema(n: int) -> str:
    return ", ".join(f"x{i} long" for i in range(n))


@dataclass
class KatzModel:
    """The written tables: ``words`` (w, c), ``bigrams`` (b, a, r), ``contexts`` (a, total, alpha).

    Words are 64-bit hashes in ``words``; in the other tables the most frequent ones are coded
    by their rank (``vocabulary.code``).
    """

    vocabulary: Vocabulary
    d2: np.ndarray
    words: DataFrame
    parts: str
    contexts: DataFrame

    def bigrams(self) -> DataFrame:
        spark = self.words.sparkSession
        return spark.read.parquet(f"{self.parts}/kind=2").where("blob is not null").mapInArrow(_unpacked(3), _schema(3)).toDF("b", "a", "r")


def fit_and_score(docs: DataFrame, train, id_col: str = "doc_id", text_col: str = "text") -> tuple[KatzModel, DataFrame]:
    """Learn from the rows where the boolean column ``train`` holds, score all rows.

    The scores have one row per id: ``_doc``, ``n_tokens``, ``n_known``, ``base_score`` (add-one
    over single words) and ``score``, both log10.
    """
    spark = docs.sparkSession
    groups = C.groups_for(spark, 1)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"),
                       F.coalesce(train, F.lit(False)).alias("train"))
    counted = rows.where("train").select("text").mapInArrow(_count_words, "w long, c long")
    words = C.write_once(counted.groupBy("w").agg(F.sum("c").alias("c")), "words")
    figures = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), *[F.count(F.when(F.col("c") == r, 1)) for r in range(1, K + 2)]).first()
    total, distinct, n = int(figures[0]), int(figures[1]), [int(x) for x in figures[2:]]
    # a code for the most frequent words: the counts fall into at most 1,024 steps of a logarithmic
    # scale, and the steps from the top that hold at most CODED words are read
    step = F.floor(F.log2("c") * 16)
    steps = sorted(((r["s"], r["n"]) for r in words.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, held = 1 << 20, 0
    for s, n_words in steps:
        held += n_words
        if held > CODED:
            break
        least = s
    top = sorted(words.where(step >= least).collect(), key=lambda x: (-x["c"], x["w"]))
    d1 = discounts(n)
    kept = sum(d1[r] * r * n[r - 1] for r in range(1, K + 1)) + KEEP_LARGE * (total - sum(r * n[r - 1] for r in range(1, K + 1)))
    unknown = 1.0 - kept / total if total else 1.0
    v = Vocabulary(total, distinct, unknown, d1, np.array([x["w"] for x in top], np.int64).view(np.uint64),
                   np.array([x["c"] for x in top], np.int64), groups)
    pairs = rows.mapInArrow(_deal_pairs(v), "part int, b binary, nb binary, a binary, na binary, docs binary, ids binary")
    done = pairs.groupBy("part").applyInArrow(_count_pairs(v), "kind int, bucket int, blob binary, " + ", ".join(f"n{r} long" for r in range(1, K + 2)))
    parts = C.table_path(spark, "katz")
    # an empty input still has all four kinds of rows to read
    none = spark.range(4).select(F.col("id").cast("int").alias("kind"), F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("blob"),
                                 *[F.lit(0).cast("long").alias(f"n{r}") for r in range(1, K + 2)])
    done.union(none).write.partitionBy("kind").parquet(parts)
    kind = lambda k: spark.read.parquet(f"{parts}/kind={k}").where("blob is not null")
    n2 = spark.read.parquet(f"{parts}/kind=2").agg(*[F.coalesce(F.sum(f"n{r}"), F.lit(0)) for r in range(1, K + 2)]).first()
    d2 = discounts([int(x) for x in n2])

    sums = kind(1).groupBy("bucket").applyInArrow(_sum_columns(2 + 2 * K + 1), _schema(2 + 2 * K + 1))
    col = lambda i: F.col(f"x{i}")
    context_total = sum((col(r) * r for r in range(1, K + 1)), col(K + 1))
    left = context_total - sum((col(r) * float(r * d2[r]) for r in range(1, K + 1)), col(K + 1) * KEEP_LARGE)
    lower = 1 - sum((col(K + 1 + r) * float(r * d1[r]) for r in range(1, K + 1)), col(2 * K + 2) * KEEP_LARGE) / max(1, total)
    contexts = C.write_once(sums.select(col(0).alias("a"), context_total.alias("total"), (left / context_total / lower).alias("alpha")), "contexts")
    model = KatzModel(v, d2, words, parts, contexts)

    per_doc = kind(0).groupBy("bucket").applyInArrow(_sum_columns(5 + K), _schema(5 + K))
    first = F.log10(F.lit(float(max(1, texts_in_training(model)))))
    score = col(4) / SCALE + sum((col(4 + r) * float(np.log10(r * d2[r])) for r in range(1, K + 1)), F.lit(0.0))
    head = per_doc.select(col(0).alias("_doc"), col(1).alias("n_tokens"), col(2).alias("n_known"), (col(3) / SCALE).alias("_base"), score.alias("_score"),
                          F.lit(1).alias("_rows"))
    # an unseen pair was charged its context's total above: alpha takes its place
    unseen = kind(3).mapInArrow(_unpacked(3), _schema(3)).toDF("_doc", "a", "times")
    mend = unseen.join(contexts, "a").select("_doc", F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0.0).alias("_base"),
                                             (F.col("times") * F.log10(F.col("alpha") * F.col("total"))).alias("_score"), F.lit(0).alias("_rows"))
    ends = rows.groupBy(F.coalesce("id", F.lit(C.NULL_ID)).alias("_doc")).agg(F.count("*").alias("times"))
    starts = ends.select("_doc", F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0.0).alias("_base"),
                         (-F.col("times") * first).alias("_score"), F.lit(0).alias("_rows"))
    whole = head.unionByName(mend).unionByName(starts).groupBy("_doc").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
                                                                         F.sum("_base").alias("_base"), F.sum("_score").alias("score"))
    base = F.col("_base") - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1)))
    return model, whole.select("_doc", "n_tokens", "n_known", base.alias("base_score"), "score")


def texts_in_training(model: KatzModel) -> int:
    """Times the end was seen in training: once per training text."""
    code = end_code(model.vocabulary)
    if code < np.uint64(CODED):
        return int(model.vocabulary.counts[int(code)])
    got = model.words.where(F.col("w") == int(END.astype(np.int64))).first()
    return int(got["c"]) if got else 0


def op1_katz_scores(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from those whose crc32 modulo 7 is not 2."""
    docs = C.documents_of(spark, sf_dir)
    rest = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7
    model, scores = fit_and_score(docs, rest != 2)
    ident = F.when(F.col("_doc") != C.NULL_ID, F.col("_doc"))
    out = scores.withColumn("doc_id", ident)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.vocabulary.total).cast("long").alias("train_tokens"),
                      "base_score", "score")
