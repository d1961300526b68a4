"""Token ids in directly addressable codes: random access to any token without block decoding.

File format (one row per shard of a Parquet table, so writes are atomic, survive lost executors
and can live in any store Spark reads): the ids of consecutive documents in ascending id order,
split into 8-bit chunks. Level 0 holds the low chunk of every id; an id that needs more has
its continuation bit set, and its next chunk stands in level 1 at the rank of that bit. A rank
directory holds the number of set bits before every block of 512, so a rank is one directory
entry and a population count of at most 64 bytes.

    shard, first_token, n_tokens, doc_ids[], doc_starts[] (relative), chunks[] / bits[] / ranks[]
    (one binary per level)

Texts are encoded where they stand after one range exchange by document id; the start of a
shard is the sum of the tokens of those before it (one small row per shard).

Encoding splits a text before spaces where byte-level BPE cuts anyway: a space starts a token when
what stands before or after it is no white space. Equal chunks are encoded once and looked up in a
bounded table after that; texts with white space beyond ASCII or with the text of a special token
are encoded whole.

Defined cases: a null or empty text is the end id alone; a null document id sorts first; rows
that share an id are separate documents in order of their texts' place.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from compoundry.llm import common as C

RANK_BITS = 512
SHARD_TOKENS = 1_000_000
SLOTS, TABLE_IDS = 1 << 20, 8_000_000
_popcount = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_white = np.zeros(256, bool)
_white[[9, 10, 11, 12, 13, 32]] = True
_odd_lead = np.zeros(256, bool)
_odd_lead[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = True


class Encoder:
    """Chunk-wise encoding of slices of texts, with a bounded table of known chunks.

    The table is direct-mapped by the chunk's 64-bit hash; a chunk takes the slot of another.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self._reset()

    def _reset(self) -> None:
        self.keys, self.at, self.size = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int32)
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0

    def _append(self, ids: np.ndarray) -> None:
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(self.ids), len(ids)), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Chunk starts: every row, and spaces where a token starts in any case.

        A space starts a token if what stands before it or after it is no white space. Rows with white
        space beyond ASCII or with a special token's text stay whole.
        """
        n = len(data)
        white = _white[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = white[:-1], white[1:]
        cut = (data == 32) & (~before | ~after)
        odd = np.zeros(n, bool)
        lead = np.flatnonzero(_odd_lead[data])
        if len(lead):
            one, two = data[np.minimum(lead + 1, n - 1)], data[np.minimum(lead + 2, n - 1)]
            code = np.where(data[lead] < 0x80, 1, 0) + ((data[lead] == 0xC2) & ((one == 0x85) | (one == 0xA0))) + ((data[lead] == 0xE1) & (one == 0x9A)) \
                + ((data[lead] == 0xE2) & ((one == 0x80) & ((two <= 0x8A) | (two == 0xA8) | (two == 0xA9) | (two == 0xAF)) | (one == 0x81) & (two == 0x9F))) \
                + ((data[lead] == 0xE3) & (one == 0x80) & (two == 0x80))
            odd[lead[code > 0]] = True
        rows = set((np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1).tolist())
        raw = data.tobytes()
        for mark in self.special:
            at = raw.find(mark)
            while at >= 0:
                rows.add(int(np.searchsorted(offsets, at, "right") - 1))
                at = raw.find(mark, at + 1)
        for r in rows:
            cut[offsets[r] : offsets[r + 1]] = False
        starts = offsets[:-1][np.diff(offsets) > 0]
        cut[starts] = True
        return np.flatnonzero(cut)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and where each row's ids start and end among them."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if self.used > TABLE_IDS:
            self._reset()
        starts = self._cuts(data, offsets)
        ends = np.append(starts[1:], len(data))
        hashes = C.range_hashes(C._values[data], starts, ends, C.BYTE_BASE)
        slot = (hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        known = (self.keys[slot] == hashes) & (self.size[slot] > 0)
        at, size = self.at[slot], self.size[slot]
        # only chunks that the table lacks are sorted and encoded, each once
        missing = np.flatnonzero(~known)
        keys, first, kind = np.unique(hashes[missing], return_index=True, return_inverse=True)
        first = missing[first]
        new_at, new_size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int32)
        raw = data.tobytes()
        for lo in range(0, len(keys), 4096):
            part = slice(lo, lo + 4096)
            got = self.tokenizer.encode_batch_fast([raw[starts[i] : ends[i]].decode() for i in first[part]], add_special_tokens=False)
            ids = [e.ids for e in got]
            new_at[part] = self.used + np.cumsum([0, *map(len, ids[:-1])])
            new_size[part] = list(map(len, ids))
            self._append(np.fromiter(chain.from_iterable(ids), np.uint32))
        at[missing], size[missing] = new_at[kind], new_size[kind]
        spot = slot[first]
        self.keys[spot] = keys  # of two new chunks in one slot the later stays, in all three
        owner = np.flatnonzero(self.keys[spot] == keys)
        self.at[spot[owner]], self.size[spot[owner]] = new_at[owner], new_size[owner]
        total = np.cumsum(size)
        flat = self.ids[np.repeat(at - (total - size), size) + np.arange(int(total[-1]))]
        return flat, np.append(0, total)[np.searchsorted(starts, offsets)]


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    return Encoder(path)


def pack_levels(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Chunks, continuation bits and rank directory of each level."""
    chunks, bits, ranks = [], [], []
    left = ids.astype(np.uint32)
    while True:
        chunks.append((left & 0xFF).astype(np.uint8).tobytes())
        more = left > 0xFF
        packed = np.packbits(more, bitorder="little")
        counts = _popcount[np.pad(packed, (0, -len(packed) % (RANK_BITS // 8)))].reshape(-1, RANK_BITS // 8).sum(1)
        bits.append(packed.tobytes())
        ranks.append((np.cumsum(counts) - counts).astype("<u4").tobytes())
        left = left[more] >> 8
        if not len(left):
            return chunks, bits, ranks


def token_at(chunks: list[bytes], bits: list[bytes], ranks: list[bytes], place: int) -> int:
    """The id at a place: one chunk per level, nothing else is decoded."""
    value = 0
    for level in range(len(chunks)):
        value |= chunks[level][place] << (8 * level)
        byte, bit = divmod(place, 8)
        if not bits[level][byte] >> bit & 1:
            return value
        start = place // RANK_BITS
        before = np.frombuffer(bits[level], np.uint8, byte - start * (RANK_BITS // 8), start * (RANK_BITS // 8))
        rank = int(np.frombuffer(ranks[level], "<u4", 1, 4 * start)[0]) + int(_popcount[before].sum())
        place = rank + int(_popcount[bits[level][byte] & ((1 << bit) - 1)])
    raise ValueError("a last level has no continuation bits")


def unpack_levels(chunks: list[bytes], bits: list[bytes]) -> np.ndarray:
    """All ids of a shard."""
    value = np.zeros(0, np.uint32)
    for level in range(len(chunks) - 1, -1, -1):
        low = np.frombuffer(chunks[level], np.uint8).astype(np.uint32)
        more = np.unpackbits(np.frombuffer(bits[level], np.uint8), count=len(low), bitorder="little").astype(bool)
        low[more] |= value << np.uint32(8)
        value = low
    return value


def _shards(path: str, end_id: int):
    """mapInArrow on texts sorted by id within a partition: one row per shard."""
    names = ["part", "seq", "n_tokens", "doc_ids", "doc_starts", "chunks", "bits", "ranks"]

    def row(part: int, seq: int, ids: list, arrays: list[np.ndarray], sizes: list[np.ndarray]) -> pa.RecordBatch:
        n = np.concatenate(sizes)
        chunks, bits, ranks = pack_levels(np.concatenate(arrays))
        values = [part, seq, int(n.sum()), ids, np.cumsum(n) - n, chunks, bits, ranks]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())] + 3 * [pa.list_(pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq = encoder_of(path), None, 0
        ids: list = []
        arrays: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        for batch in batches:
            if part is None and batch.num_rows:
                part = batch.column("part")[0].as_py()
            names_here = batch.column("id").to_pylist()
            for lo, hi, data, offsets in C.text_slices(batch.column("text")):
                flat, cuts = encoder.encode(data, offsets)
                ids += names_here[lo:hi]
                arrays.append(np.insert(flat, cuts[1:], end_id))
                sizes.append(np.diff(cuts) + 1)
                if sum(map(len, arrays)) >= SHARD_TOKENS:
                    yield row(part, seq, ids, arrays, sizes)
                    ids, arrays, sizes, seq = [], [], [], seq + 1
        if ids:
            yield row(part, seq, ids, arrays, sizes)
    return run


def write_ids(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode all texts and write their ids below ``folder`` (tables ``shards`` and ``starts``)."""
    spark = docs.sparkSession
    groups = C.groups_for(spark, 2)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    ordered = rows.repartitionByRange(groups, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first())
    shards = ordered.withColumn("part", F.spark_partition_id()).mapInArrow(
        _shards(tokenizer_path, end_id), "part int, seq int, n_tokens long, doc_ids array<long>, doc_starts array<long>, "
        "chunks array<binary>, bits array<binary>, ranks array<binary>")
    shards.write.parquet(f"{folder}/shards")
    # one row per partition of the exchange: as many as it has tasks
    sizes = spark.read.parquet(f"{folder}/shards").groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    starts, at = [], 0
    for x in sizes:
        starts.append((x["part"], at))
        at += x["n"]
    spark.createDataFrame(starts, "part int, start long").coalesce(1).write.parquet(f"{folder}/starts")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow on shards: the ids of each document."""
    for batch in batches:
        for r in batch.to_pylist():
            ids = unpack_levels(r["chunks"], r["bits"]).astype("<u4")
            cut = np.append(r["doc_starts"], len(ids))
            yield pa.RecordBatch.from_arrays([
                pa.array(r["doc_ids"], pa.int64()), pa.array([r["at"] + s for s in r["doc_starts"]], pa.int64()), pa.array(np.diff(cut), pa.int64()),
                pa.array([zlib.crc32(ids[lo:hi].tobytes()) for lo, hi in zip(cut[:-1], cut[1:], strict=True)], pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"])


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    """Shards with the number of tokens before them."""
    shards = spark.read.parquet(f"{folder}/shards")
    inner = shards.select("part", "seq", "n_tokens")
    # a partition of the exchange has few shards: its data over SHARD_TOKENS
    before = inner.alias("x").join(inner.alias("y"), (F.col("x.part") == F.col("y.part")) & (F.col("y.seq") < F.col("x.seq")), "left") \
        .groupBy("x.part", "x.seq").agg(F.coalesce(F.sum("y.n_tokens"), F.lit(0)).alias("within"))
    return shards.join(before, ["part", "seq"]).join(spark.read.parquet(f"{folder}/starts"), "part").withColumn("at", F.col("start") + F.col("within"))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of every document in the files."""
    return _placed(spark, folder).select("doc_ids", "doc_starts", "chunks", "bits", "at").mapInArrow(
        _documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_tokens(spark: SparkSession, folder: str, places: DataFrame) -> DataFrame:
    """``place`` and ``token`` for a table of global places: random access, shard by shard."""
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                got = [token_at(r["chunks"], r["bits"], r["ranks"], p - r["at"]) for p in r["places"]]
                yield pa.RecordBatch.from_arrays([pa.array(r["places"], pa.int64()), pa.array(got, pa.int64())], ["place", "token"])

    shards = _placed(spark, folder)
    span = shards.select("part", "seq", "at", (F.col("at") + F.col("n_tokens")).alias("to"))
    # places meet shards by blocks of SHARD_TOKENS, an equi-join; a shard spans few blocks
    blocks = span.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / SHARD_TOKENS), F.floor((F.col("to") - 1) / SHARD_TOKENS))))
    asked = places.select(F.col("place").cast("long").alias("place")).withColumn("block", F.floor(F.col("place") / SHARD_TOKENS))
    found = asked.join(blocks, "block").where((F.col("place") >= F.col("at")) & (F.col("place") < F.col("to")))
    # at most 4,096 places of a shard in one row: many questions about one shard spread
    lists = found.withColumn("salt", F.floor(F.pmod(F.col("place"), F.lit(SHARD_TOKENS)) / 4096)).groupBy("part", "seq", "salt").agg(F.collect_list("place").alias("places"))
    return lists.join(shards.select("part", "seq", "at", "chunks", "bits", "ranks"), ["part", "seq"]).mapInArrow(pick, "place long, token long")


def op8_token_codes(spark, sf_dir: str) -> DataFrame:
    """Encode, write and read back all documents."""
    import public_tokenizers

    folder = C.table_path(spark, "ids")
    write_ids(C.documents_of(spark, sf_dir), str(public_tokenizers.path("byte_bpe_50k.json")), folder)
    return read_documents(spark, folder)
