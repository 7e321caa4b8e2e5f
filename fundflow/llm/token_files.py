"""Token-ID files: fixed-width bit packing with block offsets (operator 1).

Every text is encoded with a public vocabulary, ended with one end id, and the ids of
all documents are stored in ascending ``doc_id`` order, each id in the fewest bits that
hold the largest id of the vocabulary.

File layout. A token file set is a folder of parquet files written by Spark (so a lost
executor's half-written output is never seen); each row is one *shard*, a self-contained
byte string (all numbers little-endian)::

    magic  b"FTOK"   u16 version   u16 bits   u32 ids per block   u32 documents   u64 ids
    i64[documents]   document ids          u8[documents]   1 where the id is null
    u64[documents+1] first id of each document within the shard
    u64[blocks+1]    byte offset of each block in the payload
    payload          blocks of u64 words, ids packed from the low bit upwards

A block holds a multiple of 64 ids, so blocks end on word boundaries and any range of ids
is unpacked with a few vectorised numpy operations from its blocks alone (``read_range``).
A shard is closed at the first document end at or after SHARD_IDS ids.

Cases: a null text is an empty one (only the end id); a null ``doc_id`` sorts first;
repeated rows and ids are all kept, ordered by a hash of their text; an empty table gives
an empty file set; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fundflow.llm.common import bounded_batches, slices
from fundflow.llm.word_bpe import WordEncoder, vocabulary
from fundflow.session import new_location

MAGIC, VERSION = b"FTOK", 1
HEAD = struct.Struct("<4sHHIIQ")
#: Ids per block; a multiple of 64.
BLOCK_IDS = 4096
#: A shard is closed once it has this many ids.
SHARD_IDS = 1 << 20

SHARD_SCHEMA = ("part int, part_start long, first_null boolean, first_doc long, first_key long, "
                "n_ids long, shard binary")


def width(vocabulary_size: int) -> int:
    """Bits that hold the ids 0 .. vocabulary_size - 1."""
    return max(1, int(vocabulary_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """Ids as u64 words, ``bits`` bits each, low bits first."""
    if not len(ids):
        return np.zeros(0, "<u8")
    at = np.arange(len(ids), dtype=np.uint64) * np.uint64(bits)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    ids = ids.astype(np.uint64)
    out = np.zeros(int(at[-1] + np.uint64(bits) + np.uint64(63)) // 64, "<u8")
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[starts]] = np.bitwise_or.reduceat(ids << shift, starts)
    over = np.flatnonzero(shift + np.uint64(bits) > np.uint64(64))
    out[word[over] + 1] |= ids[over] >> (np.uint64(64) - shift[over])
    return out


def unpack(words: np.ndarray, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of packed words."""
    at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    out = words[word] >> shift
    over = np.flatnonzero(shift + np.uint64(bits) > np.uint64(64))
    out[over] |= words[word[over] + 1] << (np.uint64(64) - shift[over])
    return (out & np.uint64((1 << bits) - 1)).astype(np.uint32)


def build_shard(doc_ids: list[int | None], arrays: list[np.ndarray], bits: int) -> bytes:
    ids = np.concatenate(arrays) if arrays else np.zeros(0, np.uint32)
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id does not fit {bits} bits")
    blocks = [pack(ids[i:i + BLOCK_IDS], bits) for i in range(0, len(ids), BLOCK_IDS)]
    starts = np.concatenate([[0], np.cumsum([len(a) for a in arrays], dtype=np.int64)])
    offsets = np.concatenate([[0], np.cumsum([b.nbytes for b in blocks], dtype=np.int64)])
    return b"".join([
        HEAD.pack(MAGIC, VERSION, bits, BLOCK_IDS, len(doc_ids), len(ids)),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], "u1").tobytes(),
        starts.astype("<u8").tobytes(), offsets.astype("<u8").tobytes(), *(b.tobytes() for b in blocks)])


class Shard:
    """Random access to the ids of one shard."""

    def __init__(self, data: bytes):
        magic, version, self.bits, self.block, docs, self.n_ids = HEAD.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token shard of this version")
        blocks, at = -(-self.n_ids // self.block), HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.null = np.frombuffer(data, "u1", docs, at := at + 8 * docs).astype(bool)
        self.starts = np.frombuffer(data, "<u8", docs + 1, at := at + docs).astype(np.int64)
        self.offsets = np.frombuffer(data, "<u8", blocks + 1, at := at + 8 * (docs + 1)).astype(np.int64)
        self.data, self.payload = data, at + 8 * (blocks + 1)

    def read_range(self, start: int, end: int) -> np.ndarray:
        """Ids start .. end - 1, unpacked from the blocks that hold them."""
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        got = []
        for b in range(first, last + 1):
            n = min(self.block, self.n_ids - b * self.block)
            words = np.frombuffer(self.data, "<u8", int(self.offsets[b + 1] - self.offsets[b]) // 8,
                                  self.payload + int(self.offsets[b]))
            got.append(unpack(words, self.bits, n))
        return np.concatenate(got)[start - first * self.block:end - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.read_range(int(self.starts[i]), int(self.starts[i + 1]))


def write(docs: DataFrame, path: str, vocabulary_file: str, end_id: int) -> str:
    """Encode every text of ``docs`` (doc_id, text) and write the token files to ``path``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    data, size = vocabulary(vocabulary_file)
    held, bits = spark.sparkContext.broadcast(data), width(max(size, end_id + 1))
    end = np.array([end_id], np.uint32)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, written = WordEncoder.of(held.value), TaskContext.get().partitionId(), 0
        doc_ids, arrays, keys, n = [], [], [], 0

        def closed() -> pa.RecordBatch:
            row = [part, written, doc_ids[0] is None, doc_ids[0] or 0, keys[0], n, build_shard(doc_ids, arrays, bits)]
            kinds = [pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(row, kinds)],
                ["part", "part_start", "first_null", "first_doc", "first_key", "n_ids", "shard"])

        for batch in batches:
            for piece in slices(batch, "text"):
                every, ends = encoder.encode_all(piece.column("text"))
                rows = zip(piece.column("doc_id").to_pylist(), piece.column("key").to_pylist(), np.split(every, ends[:-1]))
                for doc, key, ids in rows:
                    ids = np.concatenate([ids, end])
                    doc_ids.append(doc)
                    keys.append(key)
                    arrays.append(ids)
                    n += len(ids)
                    if n >= SHARD_IDS:
                        yield closed()
                        written, doc_ids, arrays, keys, n = written + n, [], [], [], 0
        if doc_ids:
            yield closed()

    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
     .withColumn("key", F.xxhash64("text"))
     .repartitionByRange("doc_id", "key").sortWithinPartitions("doc_id", "key")
     .mapInArrow(shards, SHARD_SCHEMA).write.option("compression", "zstd").parquet(path))
    return path


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Per write task: the ids of all tasks before it (one row per task, so its size is bounded)."""
    parts = (spark.read.schema(SHARD_SCHEMA).parquet(path)
             .groupBy("part").agg(F.sum("n_ids").alias("n"), F.min(F.struct(
                 (~F.col("first_null")).alias("a"), "first_doc", "first_key")).alias("first")))
    before = Window.orderBy("first", "part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """The documents of a token file set: doc_id, start, n_tokens, ids_crc32 (and ids)."""
    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, start, data in zip(*(batch.column(c).to_pylist() for c in ("part", "part_start", "shard"))):
                shard = Shard(data)
                ids = shard.read_range(0, shard.n_ids)
                each = [ids[a:b] for a, b in zip(shard.starts[:-1], shard.starts[1:])]
                docs = len(each)
                columns = {
                    "part": pa.array(np.full(docs, part, np.int32)),
                    "doc_id": pa.array(shard.doc_ids.astype(np.int64), mask=shard.null),
                    "at": pa.array(shard.starts[:-1] + start),
                    "n_tokens": pa.array(np.diff(shard.starts)),
                    "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in each], pa.int64())}
                if with_ids:
                    columns["ids"] = pa.array([x.astype(np.int32) for x in each], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    schema = "part int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    rows = spark.read.schema(SHARD_SCHEMA).parquet(path).select("part", "part_start", "shard").mapInArrow(documents, schema)
    joined = rows.join(F.broadcast(read_index(spark, path)), "part")
    return joined.select("doc_id", (F.col("at") + F.col("base")).alias("start"), "n_tokens", "ids_crc32",
                         *["ids"] * with_ids)


def token_files(docs: DataFrame, vocabulary_file: str, end_id: int) -> DataFrame:
    """Write the token files of ``docs`` to the shared folder and return what they hold per document."""
    spark = docs.sparkSession
    return read(spark, write(docs, new_location(spark, "llm-token-files"), vocabulary_file, end_id))
