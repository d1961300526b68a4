"""Fill-in-middle transformation over piece tables.

A document is a table of descriptors (buffer, start, end) over two immutable buffers: its own
UTF-8 bytes and the sentinel texts. Cutting it in prefix, middle and suffix splits the one
descriptor of the text; an arrangement is a permutation of the descriptors; the inverse
permutation of the descriptors that the sentinels mark in an output restores the text. Hashes
stream the descriptors in their order, so nothing is joined to hash it.

The cut of a document depends on its id and the seed alone: the first four groups of eight hex
digits of ``sha256("<seed>:<id>")``, as numbers h1 to h4, give the two cuts (h1 and h2 modulo
the number of units plus one), whether it is transformed (h3 % 100 < rate) and in which form
(h4 % 100 < spm_rate: suffix first). Rows never meet: one pass over the texts without a shuffle,
and a lost task is its slice done again. Unit ends and code points are found for about a
megabyte of texts at once.

Defined cases: a null text is empty; an empty text, a text that holds a sentinel, and one
outside the rate stay as they are (form ``plain``, no lengths); a null id counts as the empty
text; a text without line ends is one unit, however long; equal rows give equal results, and
rows that share an id but not a text are cut by the same numbers, each on its own. All input
columns stay, except those with the name of a result column, which the result replaces. An
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compoundry.llm import common as C

#: Places of [prefix, middle, suffix, P, S, M] in each form's output.
ARRANGEMENTS = {"psm": (3, 0, 4, 2, 5, 1), "spm": (4, 2, 3, 0, 5, 1)}


@dataclass(frozen=True)
class FimRules:
    """Unit of the cuts (``line`` or ``char``), seed, percent transformed, percent of those
    suffix first, and the sentinels before prefix, suffix and middle."""

    unit: str = "line"
    seed: str = "7"
    rate: int = 100
    spm_rate: int = 50
    sentinels: tuple[str, str, str] = ("<P>", "<S>", "<M>")

    def __post_init__(self):
        if self.unit not in ("line", "char"):
            raise ValueError("a unit is a line or a char")
        marks = self.sentinels
        if len(set(marks)) != 3 or not all(marks):
            raise ValueError("three different sentinels are needed")
        for a in marks:
            for b in marks:
                # an output can be read back only if no sentinel can begin inside another
                if (a != b and a in b) or any(a[i:] == b[: len(a) - i] for i in range(1, len(a))):
                    raise ValueError("sentinels must not overlap")


class PieceTable:
    """Descriptors over immutable buffers; every change makes another list of descriptors."""

    __slots__ = ("buffers", "pieces")

    def __init__(self, buffers: tuple, pieces: list[tuple[int, int, int]]):
        self.buffers, self.pieces = buffers, pieces

    @classmethod
    def over(cls, *buffers) -> PieceTable:
        return cls(buffers, [(i, 0, len(b)) for i, b in enumerate(buffers)])

    def cut(self, piece: int, *at: int) -> PieceTable:
        """Split one descriptor at ascending offsets from its start; empty parts stay."""
        buffer, start, end = self.pieces[piece]
        edges = [start, *(start + x for x in at), end]
        parts = [(buffer, a, b) for a, b in zip(edges, edges[1:], strict=False)]
        return PieceTable(self.buffers, self.pieces[:piece] + parts + self.pieces[piece + 1 :])

    def arranged(self, order: tuple[int, ...]) -> PieceTable:
        return PieceTable(self.buffers, [self.pieces[i] for i in order])

    def restored(self, order: tuple[int, ...]) -> PieceTable:
        """Undo ``arranged(order)``."""
        back = [(0, 0, 0)] * len(order)
        for place, i in enumerate(order):
            back[i] = self.pieces[place]
        return PieceTable(self.buffers, back)

    def first(self, n: int) -> PieceTable:
        return PieceTable(self.buffers, self.pieces[:n])

    def views(self) -> Iterator:
        return (self.buffers[b][lo:hi] for b, lo, hi in self.pieces)

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for view in self.views():
            digest.update(view)
        return digest.hexdigest()

    def joined(self) -> bytes:
        return b"".join(self.views())


def transformed(text: memoryview, prefix: int, middle: int, form: str, marks: tuple[bytes, bytes, bytes]) -> PieceTable:
    """The arranged table of a text cut after ``prefix`` and ``middle`` bytes from its start."""
    joined = memoryview(b"".join(marks))
    ends = (len(marks[0]), len(marks[0]) + len(marks[1]))
    return PieceTable.over(text, joined).cut(1, *ends).cut(0, prefix, middle).arranged(ARRANGEMENTS[form])


def read_back(output: bytes, form: str, marks: tuple[bytes, bytes, bytes]) -> PieceTable:
    """The text of an output as descriptors over it: sentinels cut it, the inverse order restores."""
    view = memoryview(output)
    if form == "plain":
        return PieceTable.over(view)
    edges, at = [], 0
    for i in ARRANGEMENTS[form]:
        if i >= 3:
            at = output.index(marks[i - 3], at)
            edges += [at, at + len(marks[i - 3])]
            at = edges[-1]
    # the first sentinel starts the output: its left edge is no cut
    return PieceTable.over(view).cut(0, *edges[1:]).restored(ARRANGEMENTS[form]).first(3)


def _unit_ends(data: np.ndarray, unit: str) -> np.ndarray:
    """Ascending offsets just behind a unit; a last line without its end is not among them."""
    if unit == "line":
        return np.flatnonzero(data == 10) + 1
    return np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


def _numbers(seed: str, key: str) -> list[int]:
    digits = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]


_RESULT = "_n_units long, _form string, _prefix_chars long, _middle_chars long, _output_sha256 string, _restored_sha256 string"
RESULTS = tuple(c.split()[0] for c in _RESULT.split(", "))


def _rows(rules: FimRules, n_kept: int, with_text: bool):
    """mapInArrow: kept columns, id text and text to the results."""
    marks = tuple(s.encode() for s in rules.sentinels)

    def one(key: str, text: memoryview, whole: bytes | None, ends: np.ndarray, lo: int, hi: int, a: int, chars: np.ndarray) -> tuple:
        """``ends[lo:hi]`` are the unit ends of the text that starts at ``a``; ``whole`` is set to look for sentinels."""
        size = len(text)
        n = hi - lo + (rules.unit == "line" and size > 0 and (hi == lo or int(ends[hi - 1]) < a + size))
        h1, h2, h3, h4 = _numbers(rules.seed, key)
        if not size or h3 % 100 >= rules.rate or (whole is not None and any(m in whole for m in marks)):
            digest = PieceTable.over(text).sha256()
            return n, "plain", None, None, digest, digest, bytes(text) if with_text else None
        form = "spm" if h4 % 100 < rules.spm_rate else "psm"
        cuts = [0 if k == 0 else (int(ends[lo + k - 1]) - a if k <= hi - lo else size) for k in sorted((h1 % (n + 1), h2 % (n + 1)))]
        table = transformed(text, *cuts, form, marks)
        output = table.joined()
        counts = chars[a + cuts[0]] - chars[a], chars[a + cuts[1]] - chars[a + cuts[0]]
        return (n, form, int(counts[0]), int(counts[1]), table.sha256(), read_back(output, form, marks).sha256(),
                output if with_text else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(n_kept).to_pylist()
            for at, to, data, offsets in C.text_slices(batch.column(n_kept + 1)):
                raw = data.tobytes()
                view = memoryview(raw)
                ends = _unit_ends(data, rules.unit)
                chars = np.zeros(len(data) + 1, np.int64)
                np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
                lows, highs = np.searchsorted(ends, offsets[:-1], "right"), np.searchsorted(ends, offsets[1:], "right")
                marked = any(m in raw for m in marks)
                out = [one(keys[at + i], view[a:b], raw[a:b] if marked else None, ends, int(lows[i]), int(highs[i]), a, chars)
                       for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))]
                cols = [list(c) for c in zip(*out, strict=True)]
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=False)]
                names = list(RESULTS)
                if with_text:
                    arrays.append(pa.array([x.decode() for x in cols[6]], pa.string()))
                    names.append("_output")
                kept = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([kept.column(i) for i in range(n_kept)] + arrays,
                                                 [f"c{i}" for i in range(n_kept)] + names)
    return run


def fill_in_middle(docs: DataFrame, rules: FimRules = FimRules(), id_col: str = "doc_id", text_col: str = "text",
                   with_text: bool = True) -> DataFrame:
    """All rows with ``_n_units``, ``_form``, ``_prefix_chars``, ``_middle_chars``, ``_output_sha256``,
    ``_restored_sha256`` and, where asked for, ``_output``: the transformed text.

    Without ``with_text`` only the id stays of the input columns.
    """
    keep = [c for c in (docs.columns if with_text else [id_col]) if c not in (*RESULTS, "_output")]
    side = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)],
                       F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("key"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = ", ".join(f"{n} {t}" for n, t in side.dtypes[: len(keep)])
    schema = ", ".join(x for x in (schema, _RESULT, "_output string" if with_text else "") if x)
    out = side.mapInArrow(_rows(rules, len(keep), with_text), schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *RESULTS, *(["_output"] if with_text else []))


def restore_texts(rows: DataFrame, rules: FimRules = FimRules(), output_col: str = "_output", form_col: str = "_form") -> DataFrame:
    """All rows and ``_restored``: the text that an output and its form stand for; null outputs stay null."""
    marks = tuple(s.encode() for s in rules.sentinels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if t is None else read_back(t.encode(), f or "plain", marks).joined().decode()
                     for t, f in zip(batch.column("output").to_pylist(), batch.column("form").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(batch.num_columns - 2)] + [pa.array(texts, pa.string())],
                                             [f"c{i}" for i in range(batch.num_columns - 2)] + ["_restored"])

    keep = [c for c in rows.columns if c != "_restored"]
    side = rows.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)],
                       F.col(f"`{output_col}`").alias("output"), F.col(f"`{form_col}`").alias("form"))
    schema = ", ".join([*(f"{n} {t}" for n, t in side.dtypes[: len(keep)]), "_restored string"])
    out = side.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "_restored")


def op11_piece_table(spark, sf_dir: str) -> DataFrame:
    """Line cuts of all documents with seed 7: every text transformed, half of them suffix first."""
    out = fill_in_middle(C.documents_of(spark, sf_dir), with_text=False)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_n_units").alias("n"), F.col("_form").alias("form"),
                      F.col("_prefix_chars").alias("prefix_chars"), F.col("_middle_chars").alias("middle_chars"),
                      F.col("_output_sha256").alias("output_sha256"), F.col("_restored_sha256").alias("restored_sha256"))
