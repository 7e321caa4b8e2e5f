"""Byte-level BPE encoding and decoding by a rank file (operator 3).

The rank file (base64 token, rank) is turned into a BPE model of the tokenizers library:
bytes are written as the printable characters of the byte table, and every way to join two
tokens into a third becomes a merge, ordered by the rank of what it makes. Where two joins
make the same token from overlapping places ("x yz" / "xy z" readings of one run), the
merge that starts further left comes first, as a leftmost-first merger would choose.
Each match of the pattern is encoded by itself; a worker remembers the matches it has met.
Decoding looks characters up in the reversed byte table, so any cut through a character
still gives its exact bytes; ``TextDecoder`` holds split characters back until complete.

Cases: a null text is an empty one (no ids); texts are encoded whole, whatever their
length; repeated rows are encoded each; an empty table gives an empty result; other
columns, whatever their names, are carried through or ignored.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundflow.llm.common import bounded_batches

#: Matches a worker remembers, and the longest of them in characters.
MEMORY, LONGEST = 1_000_000, 40

_codecs: dict[str, "ByteCodec"] = {}


def byte_table() -> dict[int, str]:
    """Byte -> character: printable Latin-1 bytes are themselves, the others follow from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


def joins(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Places to cut ``token`` into two tokens, in the order in which a merger must prefer them."""
    cuts = [i for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
    # cut i and cut j overlap in a run x y z with xy = yz = token: x = token[:i], y = token[i:]
    after = {i: {j for j in cuts if j != i and j == len(token) - i and token[:j] == token[i:]} for i in cuts}
    order: list[int] = []
    while cuts:
        free = [i for i in cuts if not any(i in after[k] for k in cuts)]
        order.append((free or cuts)[0])
        cuts.remove(order[-1])
    return order


class ByteCodec:
    def __init__(self, data: bytes, pattern: str):
        import regex
        from tokenizers import models

        ranks, table = read_ranks(data), byte_table()
        spell = lambda token: "".join(map(table.__getitem__, token))
        merges = [(spell(t[:i]), spell(t[i:])) for t in sorted(ranks, key=ranks.get) for i in joins(t, ranks)]
        self.table, self.spell = table, spell
        self.model = models.BPE({spell(t): r for t, r in ranks.items()}, merges, ignore_merges=True)
        back = {c: b for b, c in table.items()}
        self.token = {r: bytes(back[c] for c in spell(t)) for t, r in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = _Memory(self.piece)
        self.plain = str.maketrans({chr(b): c for b, c in table.items() if b < 128})

    @classmethod
    def of(cls, data: bytes, pattern: str) -> "ByteCodec":
        key = hashlib.sha256(data + pattern.encode()).hexdigest()
        if key not in _codecs:
            _codecs[key] = cls(data, pattern)
        return _codecs[key]

    def piece(self, piece: str) -> bytes:
        """The ids of one match as little-endian u32 bytes."""
        spelt = piece.translate(self.plain) if piece.isascii() else self.spell(piece.encode())
        ids = [t.id for t in self.model.tokenize(spelt)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.split(text)))

    def offsets(self, ids: bytes) -> list[tuple[int, int]]:
        """Byte range of each token within the UTF-8 text."""
        out, at = [], 0
        for i in ids_of(ids):
            out.append((at, at := at + len(self.token[i])))
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, ids_of(ids)))


class _Memory(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= LONGEST:
            if len(self) >= MEMORY:
                self.clear()
            self[key] = value
        return value


class TextDecoder:
    """Decodes a stream of id chunks to text; a character split between chunks waits for its rest."""

    def __init__(self, codec: ByteCodec):
        self.codec, self.utf8 = codec, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes, last: bool = False) -> str:
        return self.utf8.decode(self.codec.decode(ids), last)


def ids_of(data: bytes) -> tuple[int, ...]:
    return struct.unpack(f"<{len(data) // 4}I", data)


def _load(spark: SparkSession, rank_file: str):
    with open(rank_file, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def digest_column(spark: SparkSession, rank_file: str, pattern: str, with_ids: bool = False):
    """Column function: text -> struct(n_tokens, ids_sha256, decoded_sha256, and ids if asked); the ids are decoded again."""
    bounded_batches(spark)
    held = _load(spark, rank_file)

    @F.arrow_udf("struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string" + ", ids: array<int>" * with_ids + ">")
    def digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = ByteCodec.of(held.value, pattern)
        for texts in batches:
            counts, ids_sha, text_sha, lists = [], [], [], []
            for text in texts:
                ids = codec.encode(text.as_py() or "")
                lists.append(ids_of(ids) if with_ids else None)
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            columns = {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()),
                       "decoded_sha256": pa.array(text_sha, pa.string())}
            if with_ids:
                columns["ids"] = pa.array(lists, pa.list_(pa.int32()))
            yield pa.StructArray.from_arrays(list(columns.values()), list(columns))

    return digests


def encode_column(spark: SparkSession, rank_file: str, pattern: str, offsets: bool = False):
    """Column function: text -> struct(ids, and with ``offsets`` the byte range of each token)."""
    bounded_batches(spark)
    held = _load(spark, rank_file)
    kind = "struct<ids: array<int>" + ", starts: array<int>, ends: array<int>" * offsets + ">"

    @F.arrow_udf(kind)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = ByteCodec.of(held.value, pattern)
        for texts in batches:
            ids = [codec.encode(t.as_py() or "") for t in texts]
            columns = {"ids": [ids_of(x) for x in ids]}
            if offsets:
                ranges = [codec.offsets(x) for x in ids]
                columns |= {"starts": [[a for a, _ in r] for r in ranges], "ends": [[b for _, b in r] for r in ranges]}
            yield pa.StructArray.from_arrays([pa.array(v, pa.list_(pa.int32())) for v in columns.values()], list(columns))

    return encode


def decode_column(spark: SparkSession, rank_file: str, pattern: str):
    """Column function: array of ids -> text (bytes that are no UTF-8 become U+FFFD); null stays null."""
    held = _load(spark, rank_file)

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = ByteCodec.of(held.value, pattern)
        for lists in batches:
            yield pa.array([None if x is None else b"".join(map(codec.token.__getitem__, x)).decode("utf-8", "replace")
                            for x in lists.to_pylist()], pa.string())

    return decode


def round_trip(docs: DataFrame, rank_file: str, pattern: str, text: str | Column = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    digests = digest_column(docs.sparkSession, rank_file, pattern)
    text = F.col(text) if isinstance(text, str) else text
    return docs.select("doc_id", digests(text.cast("string")).alias("d")).select("doc_id", "d.*")
