"""SentencePiece encoding and decoding with N-best segmentation.

A text becomes its pieces by scores that add up. The file is a merge model: its own scores are ranks
of merges, and their sum says nothing of how likely a segmentation is. ``piece_weights`` therefore
estimates log probabilities from the documents: the pieces of the model's own encoding are counted over
all texts, half a count is added to each, and the search ranks by the sum of logs. The piece lattice has a node at
every character and an edge for every piece; characters without a piece fall back to their
bytes, at a score below every piece. A forward Viterbi pass gives the best score from
the start to every node. Those scores are exact heuristics for an A-star search that runs
backward from the end: the first N paths that reach the start are the N best, in order.

Pieces never hold a space mark after another character (checked when the file is read), so the lattice of a text falls apart
before every run of space marks into independent units. The forward pass runs over all
distinct units of a slice of texts at once (numpy, one lattice position after the other) and
keeps the two best scores per node, so each unit's loss of leaving its best segmentation is
known. The N best segmentations of a text are the N best combinations of unit alternatives,
and only its N - 1 units of smallest loss can differ from the best: those are searched by
A-star, and their alternatives merged.

The model state is the vocabulary file (a parameter) and one weight per piece; memory is bounded by the slice.
Every text is encoded whole, and decoding gives back the text.

Defined cases: null and empty texts have no pieces; a space mark in the text itself becomes a
space when decoded (the file's own convention) and so counts as not round; invalid ids raise
an error; repeated rows give repeated results. Without any text all weights are equal; an empty table gives an
empty result. Very long texts are one slice of their own. Extra columns stay, whatever their names.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compoundry.llm import common as C

MARK = "▁"
BYTE_LOSS = 10.0
CACHE_UNITS = 50_000
COUNTED_UNITS = 500_000
VECTOR_LENGTH = 32
SLICE_CHARS = 2_000_000
NOTHING = -(1 << 40)
SLOT_MASK = np.uint64((1 << 20) - 1)
SLOT_SHIFT, OTHER_SHIFT = np.uint64(44), np.uint64(20)
BEGIN_SHIFT = np.uint64(42)

Alternatives = list[tuple]


class Pieces:
    """The vocabulary of a model file: piece scores and byte fallbacks."""

    def __init__(self, path: str, weights: np.ndarray | None = None) -> None:
        """``weights``: one score per piece id in place of the file's own."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        usable = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        if any(MARK in self.pieces[i].lstrip(MARK) for i in usable):
            raise ValueError("a piece holds a space mark behind another character")
        self.scores = {self.pieces[i]: (model.get_score(i) if weights is None else float(weights[i]), i) for i in usable}
        self.longest = max(map(len, self.scores), default=1)
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.worst = min((s for s, _ in self.scores.values()), default=0.0) - BYTE_LOSS
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.known: dict[tuple[str, int], Alternatives] = {}
        # hashes of all pieces, sorted, as the forward pass finds them
        codes = [np.array([ord(c) for c in x], np.uint64) for x in self.scores]
        flat = C.mix(np.concatenate(codes) + np.uint64(1))
        ends = np.cumsum([len(x) for x in codes])
        keys = C.range_hashes(flat, ends - [len(x) for x in codes], ends, C.WORD_BASE)
        order = np.argsort(keys)
        values = np.array(list(self.scores.values()))
        self.keys, self.ordered_scores, self.ordered_ids = keys[order], values[order, 0], values[order, 1].astype(np.int64)
        # two direct tables by different bits of the hash; pieces that collide in both are refused
        self.slots = np.zeros(int(SLOT_MASK) + 1, np.int32)
        self.slots[self.keys >> SLOT_SHIFT] = np.arange(len(self.keys))
        lost = np.flatnonzero(self.slots[self.keys >> SLOT_SHIFT] != np.arange(len(self.keys)))
        self.others = np.zeros(int(SLOT_MASK) + 1, np.int32)
        self.others[(self.keys[lost] >> OTHER_SHIFT) & SLOT_MASK] = lost
        if (self.find(self.keys) != np.arange(len(self.keys))).any():
            raise ValueError("the vocabulary is too large for its tables")
        # whether a piece may begin with a text, by bits of its hash: a lookup goes on only from such texts
        size = np.array([len(x) for x in codes], np.int64)
        first, long = np.repeat(ends - size, size), np.arange(int(size.sum())) - np.repeat(ends - size, size) + 1
        self.begins = np.zeros(1 << (64 - int(BEGIN_SHIFT)), bool)
        self.begins[C.range_hashes(flat, first, first + long, C.WORD_BASE) >> BEGIN_SHIFT] = True
        self.byte_ids = np.array([self.bytes.get(b, -1) for b in range(256)], np.int64)
        self.texts = [bytes([self.byte_of[i]]) if i in self.byte_of else x.encode() for i, x in enumerate(self.pieces)]

    def edges(self, unit: str, at: int) -> list[tuple[int, float, tuple[int, ...]]]:
        """(end, score, ids) of the pieces that start at a character."""
        out = []
        for end in range(at + 1, min(len(unit), at + self.longest) + 1):
            got = self.scores.get(unit[at:end])
            if got:
                out.append((end, got[0], (got[1],)))
        if not out or out[0][0] != at + 1:
            raw = unit[at].encode()
            out.append((at + 1, self.worst * len(raw), tuple(self.bytes[b] for b in raw)))
        return out

    def search(self, unit: str, n: int) -> Alternatives:
        """The n best segmentations of a unit: forward Viterbi, then backward A-star."""
        size = len(unit)
        best = [0.0] + [-np.inf] * size
        into: list[list] = [[] for _ in range(size + 1)]
        for at in range(size):
            for end, score, ids in self.edges(unit, at):
                into[end].append((at, score, ids))
                best[end] = max(best[end], best[at] + score)
        heap: list = [(-best[size], 0, size, 0.0, None)]
        order, out = 0, []
        while heap and len(out) < n:
            _, _, at, done, path = heapq.heappop(heap)
            if at == 0:
                ids, node = [], path
                while node:
                    ids += node[0]
                    node = node[1]
                out.append((done, tuple(ids)))
                continue
            for start, score, ids in into[at]:
                order += 1
                total = done + score
                heapq.heappush(heap, (-(total + best[start]), order, start, total, (ids, path)))
        return out

    def alternatives(self, unit: str, best: tuple[int, ...], n: int) -> Alternatives:
        """The n best of a unit, ``best`` first."""
        got = self.known.get((unit, n))
        if got is None:
            if len(self.known) >= CACHE_UNITS:
                self.known.clear()
            found = self.search(unit, n)
            got = [(found[0][0], best), *[x for x in found if x[1] != best]][:n]
            self.known[(unit, n)] = got
        return got

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece number in score order of each hash, -1 for none."""
        at = self.slots[hashes >> SLOT_SHIFT]
        at = np.where(self.keys[at] == hashes, at, self.others[(hashes >> OTHER_SHIFT) & SLOT_MASK])
        return np.where(self.keys[at] == hashes, at, -1)

    def forward(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Viterbi over many units: best scores, losses, the ids of all units in a row, their counts.

        Ids are piece ids, or -1 - code point for a character that falls back to bytes.
        """
        best, loss = np.zeros(len(starts)), np.full(len(starts), np.inf)
        flats, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        size = ends - starts
        sums = np.zeros(len(codes) + 1, np.uint64)
        up, down = C.powers(C.WORD_BASE, len(codes))
        np.cumsum(C.mix(codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)], out=sums[1:])
        for length in np.unique(size):
            length = int(length)
            who = np.flatnonzero(size == length)
            if length > VECTOR_LENGTH:
                for u in who:
                    text = "".join(map(chr, codes[starts[u] : ends[u]]))
                    found = self.search(text, 2)
                    best[u], loss[u] = found[0][0], found[0][0] - found[1][0] if len(found) > 1 else np.inf
                    flats.append(np.array(found[0][1], np.int64))
                    owners.append(np.full(len(found[0][1]), u))
                continue
            at = starts[who]
            b1 = np.full((length + 1, len(who)), -np.inf)
            b2 = b1.copy()
            back = np.zeros((length + 1, len(who)), np.int16)
            piece = np.full((length + 1, len(who)), -1, np.int64)
            b1[0] = 0
            for i in range(length):
                here, live = at + i, np.arange(len(who))
                base, inverse = sums[here], down[here]
                for step in range(1, min(self.longest, length - i) + 1):
                    hashes = C.mix((sums[here + step] - base) * inverse + np.uint64(step))
                    open_ = self.begins[hashes >> BEGIN_SHIFT]
                    if step == 1:
                        found, to = self.find(hashes), live
                        ok = found >= 0
                        score, number = self.ordered_scores[found], self.ordered_ids[found]
                        if not ok.all():
                            code = codes[here].astype(np.int64)
                            score, number = np.where(ok, score, self.worst * self.raw_bytes(code)), np.where(ok, number, -1 - code)
                        here, base, inverse, live = here[open_], base[open_], inverse[open_], live[open_]
                    else:
                        here, base, inverse, live = here[open_], base[open_], inverse[open_], live[open_]
                        found = self.find(hashes[open_])
                        ok = found >= 0
                        to, found = live[ok], found[ok]
                        score, number = self.ordered_scores[found], self.ordered_ids[found]
                    c1, c2 = b1[i, to] + score, b2[i, to] + score
                    o1, o2 = b1[i + step, to], b2[i + step, to]
                    better = c1 > o1
                    b2[i + step, to] = np.where(better, np.maximum(o1, c2), np.maximum(c1, o2))
                    b1[i + step, to] = np.where(better, c1, o1)
                    win = to[better]
                    back[i + step, win], piece[i + step, win] = step, number[better]
                    if not len(live):
                        break
            best[who], loss[who] = b1[length], b1[length] - b2[length]
            # walk back all units together; a unit that is done stays at node 0
            node, rows, column = np.full(len(who), length), [], np.arange(len(who))
            while (node > 0).any():
                rows.append(np.where(node > 0, piece[node, column], NOTHING))
                node = node - back[node, column]
            grid = np.array(rows[::-1]).T
            there = grid != NOTHING
            flats.append(grid[there])
            owners.append(np.repeat(who, there.sum(1)))
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return best, loss, np.concatenate(flats)[order], np.bincount(owner, minlength=len(starts))

    @staticmethod
    def raw_bytes(code: np.ndarray) -> np.ndarray:
        """UTF-8 bytes of code points."""
        return 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)

    def with_bytes(self, ids: np.ndarray) -> np.ndarray:
        """Fallback characters as the ids of their bytes."""
        if not (ids < 0).any():
            return ids
        code = np.where(ids < 0, -1 - ids, 0)
        raw = self.raw_bytes(code)
        first = np.cumsum(raw) - raw
        out = np.repeat(ids, raw)
        for n, lead in ((1, 0), (2, 0xC0), (3, 0xE0), (4, 0xF0)):
            mine = (ids < 0) & (raw == n)
            for k in range(n):
                part = code[mine] >> (6 * (n - 1 - k))
                out[first[mine] + k] = self.byte_ids[lead | part if k == 0 else 0x80 | (part & 0x3F)]
        return out

    def encode(self, texts: list[str], n: int) -> list[Alternatives]:
        """The n best segmentations of each text with their scores; none for an empty text."""
        full = [i for i, t in enumerate(texts) if t]
        out: list[Alternatives] = [[] for _ in texts]
        if not full:
            return out
        marked = [MARK + texts[i].replace(" ", MARK) for i in full]
        codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
        edge = np.cumsum([0, *map(len, marked)])
        mark, line = codes == ord(MARK), codes == 10
        begin = line.copy()
        begin[1:] |= (mark[1:] & ~mark[:-1]) | line[:-1]
        begin[edge[:-1]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(codes))
        key = C.range_hashes(C.mix(codes.astype(np.uint64)), starts, ends, C.BYTE_BASE)
        _, first, kind = np.unique(key, return_index=True, return_inverse=True)
        best, loss, ids, count = self.forward(codes, starts[first], ends[first])
        # fallback characters become bytes once per distinct unit
        raw = np.where(ids < 0, self.raw_bytes(-1 - ids), 1)
        count = np.bincount(np.repeat(np.arange(len(count)), count), weights=raw, minlength=len(count)).astype(np.int64)
        ids = self.with_bytes(ids)
        offset = np.cumsum(count) - count
        per_text = np.searchsorted(starts, edge)
        for t, i in enumerate(full):
            lo, hi = per_text[t], per_text[t + 1]
            k = kind[lo:hi]
            total = float(best[k].sum())
            sizes = count[k]
            here = np.cumsum(sizes) - sizes
            flat = ids[np.repeat(offset[k] - here, sizes) + np.arange(int(sizes.sum()))]
            out[i] = [(total, flat)]
            if n == 1:
                continue
            m = min(n - 1, hi - lo)
            close = np.argpartition(loss[k], m - 1)[:m] if m < hi - lo else np.arange(hi - lo)
            close = np.sort(close[np.isfinite(loss[k][close])])
            lists = {}
            for u in close:
                text = "".join(map(chr, codes[starts[lo + u] : ends[lo + u]]))
                own = tuple(ids[offset[k[u]] : offset[k[u]] + count[k[u]]].tolist())
                lists[int(u)] = self.alternatives(text, own, n)
            combos: list[tuple[float, tuple]] = [(0.0, ())]
            for u, a in lists.items():
                combos = heapq.nsmallest(n, ((lost + a[0][0] - score, (*changes, (u, j)) if j else changes)
                                             for lost, changes in combos for j, (score, _) in enumerate(a)))
            for lost, changes in combos[1:]:
                parts, at = [], 0
                for u, j in changes:
                    parts += [flat[at : here[u]], np.array(lists[u][j][1], np.int64)]
                    at = here[u] + sizes[u]
                out[i].append((total - lost, np.concatenate([*parts, flat[at:]])))
        return out

    def nbest(self, text: str, n: int) -> Alternatives:
        """The n best segmentations of one text."""
        return self.encode([text], n)[0]

    def decode(self, ids) -> str:
        """The text of a segmentation."""
        text = b"".join(map(self.texts.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=1)
def pieces_of(path: str, weights: bytes | None = None) -> Pieces:
    return Pieces(path, None if weights is None else np.frombuffer(weights))


_UNIT = re.compile(r"\n| *[^ \n]+| +")


class OwnPieces:
    """Counts the pieces of the model's own encoding, unit by distinct unit."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        # a line end in front keeps the encoder from adding its mark to the unit
        self.lead = len(self.model.encode("\n"))
        self.counts = np.zeros(self.model.get_piece_size(), np.int64)
        self.units: Counter = Counter()

    def add(self, text: str) -> None:
        self.units.update(_UNIT.findall(" " + text))
        if len(self.units) > COUNTED_UNITS:
            self.settle()

    def settle(self) -> None:
        """Encode the distinct units held and add their pieces by how often each unit was met."""
        units = list(self.units)
        for lo in range(0, len(units), CACHE_UNITS):
            some = units[lo : lo + CACHE_UNITS]
            ids = [x[self.lead :] for x in self.model.encode(["\n" + u for u in some], num_threads=1)]
            times = np.repeat([self.units[u] for u in some], [len(x) for x in ids])
            np.add.at(self.counts, np.fromiter((i for x in ids for i in x), np.int64, len(times)), times)
        self.units.clear()


def piece_counts(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """id, n: how often each piece stands in the model's own encoding of all texts (absent pieces: no row)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = OwnPieces(model_path)
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid and len(text.as_buffer()):
                    own.add(text.as_py())
        own.settle()
        there = np.flatnonzero(own.counts)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(own.counts[there], pa.int64())], ["id", "n"])

    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("_text"))
    return texts.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def piece_weights(docs: DataFrame, model_path: str, text_col: str = "text") -> bytes:
    """Log probability of every piece id as packed doubles, from the counts of all texts plus one half each.

    The driver holds one row per piece of the vocabulary.
    """
    import sentencepiece

    counts = np.full(sentencepiece.SentencePieceProcessor(model_file=model_path).get_piece_size(), 0.5)
    for r in piece_counts(docs, model_path, text_col).collect():
        counts[r["id"]] += r["n"]
    return np.log(counts / counts.sum()).tobytes()


#: What ``encode_nbest`` returns of the ids: all n lists, the best list, or the crc32 of each.
ID_FORMS = {"all": ("array<array<int>>", pa.list_(pa.list_(pa.int32()))), "best": ("array<int>", pa.list_(pa.int32())),
            "crc32": ("array<long>", pa.list_(pa.int64()))}


def _encoded(path: str, weights: bytes | None, n: int, form: str, names: list[str], text_at: str):
    kinds = [pa.int64(), pa.list_(pa.float64()), ID_FORMS[form][1], pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(path, weights)
        for batch in batches:
            for lo, hi, _, _ in C.text_slices(batch.column(text_at), SLICE_CHARS):
                some = batch.slice(lo, hi - lo)
                texts = [x or "" for x in some.column(text_at).to_pylist()]
                cols: list[list] = [[], [], [], []]
                for text, best in zip(texts, p.encode(texts, n), strict=True):
                    cols[0].append(len(best[0][1]) if best else 0)
                    cols[1].append([s for s, _ in best])
                    if form == "best":
                        cols[2].append(best[0][1].astype(np.int32) if best else [])
                    else:
                        cols[2].append([zlib.crc32(i.astype("<u4").tobytes()) if form == "crc32" else i.astype(np.int32) for _, i in best])
                    cols[3].append(all(p.decode(i.tolist()) == text for _, i in best[:1]))
                yield pa.RecordBatch.from_arrays([some.column(c) for c in names] + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                                 [*names, "_n_pieces", "_scores", "_ids", "_round"])
    return run


def encode_nbest(docs: DataFrame, model_path: str, n: int = 3, text_col: str = "text", form: str = "all", with_text: bool = True,
                 weights: bytes | None = None) -> DataFrame:
    """All rows (without the text unless ``with_text``) plus ``_n_pieces`` of the best, ``_scores``
    of the n best, ``_ids`` (see ``ID_FORMS``) and ``_round``: decoding the best gives the text back.

    ``weights`` are those of ``piece_weights``; without them the scores of the file count.
    """
    if n < 1:
        raise ValueError("n is at least one")
    keep = [c for c in docs.columns if with_text or c != text_col]
    side = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").cast("string").alias("_text"))
    names = [f"c{i}" for i in range(len(keep))]
    schema = "".join(f"{c} {t}, " for c, t in side.dtypes if c != "_text")
    out = side.mapInArrow(_encoded(model_path, weights, n, form, names, "_text"),
                          f"{schema}_n_pieces long, _scores array<double>, _ids {ID_FORMS[form][0]}, _round boolean")
    return out.select(*[F.col(c).alias(k) for c, k in zip(names, keep, strict=True)], "_n_pieces", "_scores", "_ids", "_round")


def decode_ids(rows: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """All rows plus ``_text``: the text of the id list; null stays null."""
    names = rows.columns
    side = rows.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(model_path)
        for batch in batches:
            got = [None if x is None else p.decode(x) for x in batch.column(names.index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], [*batch.schema.names, "_text"])

    schema = ", ".join(f"{c} {t}" for c, t in side.dtypes)
    out = side.mapInArrow(run, f"{schema}, _text string")
    return out.select(*[F.col(f"c{i}").alias(k) for i, k in enumerate(names)], "_text")


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op5_piece_nbest(spark, sf_dir: str) -> DataFrame:
    """The three best segmentations of all documents: scores, digests and the round trip."""
    docs = C.documents_of(spark, sf_dir).select("doc_id", "text")
    out = encode_nbest(docs, default_model(), 3, form="crc32", with_text=False, weights=piece_weights(docs, default_model()))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_n_pieces").alias("n_pieces"), F.col("_scores").alias("scores"),
                      F.col("_ids").alias("ids_crc32"), F.col("_round").alias("round_trip"))
