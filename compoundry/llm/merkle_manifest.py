"""Merkle manifest of a dataset with incremental witnesses.

Every row is a leaf; leaves of one group (here: language) form a tree in the order of their
ids, and the group roots form the tree of the dataset. A tree grows by aligned appends: at each
level an open run of at most ``arity`` nodes waits for its siblings. Every appended leaf has a
partial witness; whenever a run completes, the witnesses of all leaves below it are extended by
the siblings just completed, and the run's hash is appended one level up.

Distributed, the positions of a group are cut in blocks of ``arity ** LEVELS`` leaves. A block is
aligned, so its tree can be grown in a task of its own from the first leaf to the last, and its
root is one more append for the level above: the table of block roots goes through the same
function until every group has one node, and so do the group roots. Each round divides the rows
by the block size, so two or three rounds serve any table. Going down again, the witness of a
block's root is appended to those of its leaves by an equi-join on (group, block).

Only digests move: texts are read once, hashed by Spark, and stay where they are. A group of any
size is dealt out by ranges of (group, id, digest), positions are a row number per range plus the
rows before it, so a group with a third of all rows, or a single repeated id, never meets in one
task. All levels are written tables.

Defined cases: a null field is ``-``, an empty text ``0:``; null ids come first, rows with the
same id stand in the order of their digests, and equal rows are leaves of their own; a group of
one leaf has that leaf as its root; a null group is a group of its own, before all others; an
empty table has no root. Columns other than the named fields play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from compoundry.llm import common as C

LEVELS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field_text(value: Column) -> Column:
    """``-`` for null, else byte count, colon and value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: list[Column]) -> Column:
    """Hex digest of a row's fields in their order."""
    return F.sha2(F.concat(*[field_text(f) for f in fields]), 256)


def _node(digests: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(d.hex().encode() for d in digests)).digest()


class Frontier:
    """The open subtrees of an append-only tree of a given height, and the witnesses of its leaves.

    A witness is a sequence of steps: place in the run, number of siblings, their digests.
    """

    def __init__(self, arity: int, height: int):
        self.arity, self.height = arity, height
        self.open: list[list[tuple[bytes, int, int]]] = [[] for _ in range(height + 1)]
        self.witnesses: list[bytearray] = []

    def append(self, digest: bytes) -> None:
        n = len(self.witnesses)
        self.witnesses.append(bytearray())
        self._push(0, (digest, n, n + 1))

    def _push(self, level: int, node: tuple[bytes, int, int]) -> None:
        self.open[level].append(node)
        if len(self.open[level]) == self.arity and level < self.height:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        digests = [d for d, _, _ in run]
        for place, (_, lo, hi) in enumerate(run):
            step = bytes([place, len(run) - 1]) + b"".join(digests[:place] + digests[place + 1 :])
            for witness in self.witnesses[lo:hi]:
                witness += step
        self._push(level + 1, (_node(digests), run[0][1], run[-1][2]))

    def close(self) -> bytes:
        """Complete what is still open and return the root."""
        for level in range(self.height):
            if self.open[level]:
                self._complete(level)
        return self.open[self.height][0][0]


def steps_of(witness: bytes) -> Iterator[tuple[int, list[bytes]]]:
    at = 0
    while at < len(witness):
        place, others = witness[at], witness[at + 1]
        at += 2
        yield place, [witness[at + 32 * i : at + 32 * i + 32] for i in range(others)]
        at += 32 * others


def folded(digest: bytes, witness: bytes) -> bytes:
    """The root that a leaf and its witness lead to."""
    for place, others in steps_of(witness):
        digest = _node([*others[:place], digest, *others[place:]])
    return digest


def _height(n: int, arity: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    height = 0
    while n > 1:
        n, height = -(-n // arity), height + 1
    return height


def _grown(arity: int, levels: int):
    """applyInArrow on one block: rows in order of position, with witnesses and the block's root."""
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("pos")
        total = table.column("n")[0].as_py()
        tree = Frontier(arity, levels if total > arity**levels else _height(total, arity))
        for digest in table.column("digest").to_pylist():
            tree.append(digest)
        root = tree.close()
        table = table.append_column("witness", pa.array([bytes(w) for w in tree.witnesses], pa.binary()))
        yield from table.append_column("root", pa.array([root] * len(table), pa.binary())).combine_chunks().to_batches()
    return run


def _positions(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``pos`` (in the group ``k``, by ``order``) and ``n`` (rows of the group).

    ``nodes`` is a written table, as a range exchange reads its input twice.
    """
    spark = nodes.sparkSession
    dealt = nodes.repartitionByRange(C.groups_for(spark, 1), "k", *order).sortWithinPartitions("k", *order)
    dealt = C.write_once(dealt.withColumn("_seq", F.monotonically_increasing_id()), "ordered").withColumn("_part", F.shiftright("_seq", 33))
    runs = dealt.groupBy("k", "_part").agg(F.min("_seq").alias("_low"), F.count("*").alias("_rows"))
    group = Window.partitionBy("k")
    before = F.sum("_rows").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    # one row per group and range: a group has at most as many as there are ranges
    runs = runs.select("k", "_part", (F.coalesce(before, F.lit(0)) - F.col("_low")).alias("_shift"), F.sum("_rows").over(group).alias("n"))
    return dealt.join(runs, ["k", "_part"]).withColumn("pos", F.col("_seq") + F.col("_shift")).drop("_seq", "_part", "_shift")


def _grow(nodes: DataFrame, arity: int, levels: int) -> list[DataFrame]:
    """Tables of every round, lowest first: the nodes with ``block``, ``witness`` and the ``root`` of their block."""
    size, rounds = arity**levels, []
    most = nodes.agg(F.max("n")).first()[0] or 0
    while True:
        blocks = nodes.withColumn("block", F.floor(F.col("pos") / size))
        schema = ", ".join([*(f"`{n}` {t}" for n, t in blocks.dtypes), "witness binary, root binary"])
        rounds.append(C.write_once(blocks.groupBy("k", "block").applyInArrow(_grown(arity, levels), schema), "round"))
        if most <= size:
            return rounds
        most = -(-most // size)
        nodes = rounds[-1].where(F.col("pos") == F.col("block") * size).select(
            "k", F.col("block").alias("pos"), F.col("root").alias("digest"), F.ceil(F.col("n") / size).alias("n"))


def _descend(rounds: list[DataFrame], top: DataFrame) -> DataFrame:
    """The lowest round's rows with their whole witnesses, from ``top`` (``k``, ``subroot``, ``total``, ``tail``) down."""
    above = rounds[-1].join(top, "k").withColumn("witness", F.concat("witness", "tail")).drop("tail")
    for lower in reversed(rounds[:-1]):
        tails = above.select("k", F.col("pos").alias("block"), "subroot", "total", F.col("witness").alias("tail"))
        above = lower.join(tails, ["k", "block"]).withColumn("witness", F.concat("witness", "tail")).drop("tail")
    return above


@dataclass(frozen=True)
class Manifest:
    """``leaves``: all payload columns, ``k``, ``pos``, ``digest``, ``witness`` (to the dataset's root), ``subroot`` and
    ``total`` (that root); ``groups``: one row per group with its root and number of leaves."""

    leaves: DataFrame
    groups: DataFrame


def build_manifest(leaves: DataFrame, group: str, order: list[str], arity: int = 2, levels: int = LEVELS) -> Manifest:
    """Grow the trees over ``leaves``: any columns, the text column ``group``, and ``digest`` (binary, 32 bytes).

    Leaves stand in the order of the columns ``order`` (nulls first), ties in that of their digests.
    """
    if not 2 <= arity <= 256 or levels < 1:
        raise ValueError("a run has 2 to 256 nodes, a block at least one level")
    key = F.when(F.col(f"`{group}`").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(f"`{group}`")))
    nodes = C.write_once(leaves.withColumn("k", key), "leaves")
    rounds = _grow(_positions(nodes, [*order, "digest"]), arity, levels)
    roots = rounds[-1].where("pos = 0").select("k", F.col("root").alias("subroot"))
    sizes = rounds[0].where("pos = 0").select("k", F.col("n").alias("n_leaves"))
    groups = C.write_once(roots.join(sizes, "k"), "groups")
    top = groups.select(F.lit("").alias("k"), F.col("k").alias("of"), F.col("subroot").alias("digest"))
    top_rounds = _grow(_positions(C.write_once(top, "subroots"), ["of"]), arity, levels)
    whole = top_rounds[-1].select("k", F.col("root").alias("total"), F.col("root").alias("subroot"), F.lit(b"").alias("tail")).where("pos = 0")
    tails = _descend(top_rounds, whole)
    named = tails.select(F.col("of").alias("k"), F.col("digest").alias("subroot"), "total", F.col("witness").alias("tail"))
    named = C.write_once(named, "group-witnesses")
    return Manifest(_descend(rounds, named), groups.join(named.select("k", "total"), "k"))


_CHECKED = "proof_sha256 string, folded_root string"


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: the digest of all siblings on the way up, and the root that ``offered`` leads to."""
    for batch in batches:
        proofs, roots = [], []
        for witness, digest in zip(batch.column("witness").to_pylist(), batch.column("offered").to_pylist(), strict=True):
            seen = hashlib.sha256()
            for _, others in steps_of(witness):
                for other in others:
                    seen.update(other.hex().encode())
            proofs.append(seen.hexdigest())
            roots.append(folded(digest, witness).hex())
        kept = [c for c in batch.schema.names if c not in ("witness", "offered")]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(proofs, pa.string()), pa.array(roots, pa.string())],
                                         [*kept, "proof_sha256", "folded_root"])


def verify(manifest: Manifest, offered: str, keep: list[str]) -> DataFrame:
    """``keep``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified`` for leaves
    whose digest is said to be the column ``offered``."""
    rows = manifest.leaves.select(*keep, F.lower(F.hex("digest")).alias("leaf"), F.lower(F.hex("subroot")).alias("subroot"),
                                  F.lower(F.hex("total")).alias("root"), F.col(offered).alias("offered"), "witness")
    kept = [c for c in rows.columns if c not in ("offered", "witness")]
    types = dict(rows.dtypes)
    out = rows.mapInArrow(_checked, ", ".join([*(f"`{c}` {types[c]}" for c in kept), _CHECKED]))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Proofs of all documents, per language; where 7 divides the id's crc32 a changed length is offered.

    A null id has no decimal form: nothing is changed there.
    """
    docs = C.documents_of(spark, sf_dir).select(*FIELDS)
    fields = [F.col(f) for f in FIELDS]
    changed = [F.col(f) + 1 if f == "n_chars" else F.col(f) for f in FIELDS]
    touched = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    leaves = docs.select("doc_id", "lang", F.unhex(leaf_digest(fields)).alias("digest"),
                         F.when(touched, F.unhex(leaf_digest(changed))).alias("changed"))
    manifest = build_manifest(leaves, "lang", ["doc_id"])
    manifest = Manifest(manifest.leaves.withColumn("offered", F.coalesce("changed", "digest")), manifest.groups)
    out = verify(manifest, "offered", ["doc_id"])
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
