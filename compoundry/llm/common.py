"""Shared helpers: words and window hashes of Arrow text columns, packed rows, written tables.

Words are runs of ``[^\\x20\\x09-\\x0D]`` bytes of the UTF-8 text. They are found and hashed
for many documents at once with numpy, a few megabytes at a time, so that memory does not
follow the Arrow batch. Hashes are polynomials modulo 2**64 over random byte values (words)
and over word hashes (windows), each finished by a mixing step; both are Rabin-Karp sums, so
every window costs the same whatever its length.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from compoundry.session import shared_folder

CHUNK_BYTES = 1_000_000
NULL_ID = -(1 << 63)

_values = np.random.default_rng(20_240_229).integers(0, 1 << 64, 256, dtype=np.uint64)
_lowered = _values.copy()
_lowered[65:91] = _values[97:123]
_space = np.zeros(256, bool)
_space[[9, 10, 11, 12, 13, 32]] = True
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd base and of its inverse modulo 2**64: one table per base, as long as ever asked for."""
    if base not in _powers or len(_powers[base][0]) <= n:
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            row = np.full(1 << max(12, (n + 1).bit_length()), b, np.uint64)
            row[0] = 1
            both.append(np.multiply.accumulate(row, out=row))
        _powers[base] = (both[0], both[1])
    return _powers[base]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finishing step that spreads every input bit over the result."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of ``values[start:end]`` for each pair; equal ranges have equal hashes."""
    up, down = powers(base, len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """Words of consecutive rows: byte range, row (within the slice) and place in the row."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    row: np.ndarray
    per_row: np.ndarray

    def hashes(self, lower: bool) -> np.ndarray:
        return range_hashes((_lowered if lower else _values)[self.data], self.starts, self.ends, BYTE_BASE)

    @property
    def first(self) -> np.ndarray:
        """Index of each row's first word, and the number of words."""
        return np.concatenate([[0], np.cumsum(self.per_row)])


def text_slices(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, bytes and offsets of slices of about ``limit`` bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    inside = np.zeros(len(data) + 1, bool)
    np.logical_not(_space[data], out=inside[:-1])
    begin = inside[:-1].copy()
    begin[1:] &= ~inside[:-2]
    edge = offsets[1:-1]
    edge = edge[edge < len(data)]
    begin[edge] = inside[edge]
    starts = np.flatnonzero(begin)
    # a word ends at a space, at the next row's first byte, or at the end of the data
    closing = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    cut = edge[(edge > 0)]
    cut = cut[inside[cut - 1] & inside[cut]]
    ends = np.sort(np.concatenate([closing, np.unique(cut)])) if len(cut) else closing
    per_row = np.diff(np.searchsorted(starts, offsets))
    return Words(data, offsets, starts, ends, np.repeat(np.arange(len(per_row)), per_row), per_row)


def ids_of(column: pa.Array) -> np.ndarray:
    """Integer ids; null becomes the smallest integer."""
    return pc.fill_null(column.cast(pa.int64()), NULL_ID).to_numpy(zero_copy_only=False)


_press, _open = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray) -> bytes:
    """Small integers as one compressed blob; lengths and types are the caller's."""
    return _press.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


def unpack(blob: bytes) -> bytes:
    return _open.decompress(blob)


def pieces(order_by: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, from, to) of each run of a sorted array."""
    if not len(order_by):
        return
    cuts = np.flatnonzero(np.diff(order_by)) + 1
    for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(order_by)]]), strict=True):
        yield int(order_by[lo]), int(lo), int(hi)


def groups_for(spark: SparkSession, times: int = 2) -> int:
    """Number of groups for packed rows: a multiple of the session's shuffle partitions."""
    return times * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table_path(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/compoundry-llm/{name}-{uuid.uuid4().hex}"


_scopes: list[list[str]] = []


def write_once(df: DataFrame, name: str, outlive: bool = False) -> DataFrame:
    """Write the rows to the shared folder and read them back: lineage ends here.

    Inside a ``scratch`` block the table goes with the block, unless it is to outlive it.
    """
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    if _scopes and not outlive:
        _scopes[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the tables written inside when the block ends; nothing used later may depend on them."""
    _scopes.append([])
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for name in _scopes.pop():
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)
        # shuffle files go once the driver's JVM has let go of their frames
        jvm.System.gc()


def free_name(columns: list[str], name: str) -> str:
    """``name`` with as many underscores before it as it takes to be new, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def documents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_column(name: str):
    """An id as long; texts that are no number, and null, become null."""
    return F.col(f"`{name}`").cast("long")
