"""SimHash near-duplicates by anchor-point covering (operator 6).

Fingerprints: a bit is set if it is set in over half of the XXH64 hashes of a text's word
shingles. Two fingerprints are linked if at most ``max_bits`` bits differ.

Covering: the 64 bits are cut into ``max_bits // 2 + 1`` segments, so that linked
fingerprints differ by at most one bit in some segment. Over each segment the anchors are
the words of a Hamming code, a perfect covering code of radius 1. Each distinct fingerprint
is copied to every anchor within the covering radius plus that threshold (1 + 1) of its
segment: 1 anchor if it is a code word, 1 + (n - 1) / 2 otherwise. If y is within one bit of
x, the anchor nearest to x is within two bits of y, so linked fingerprints meet there.

Per anchor all fingerprints are compared exactly. Anchors with more than BLOCK rows are cut
into blocks by a hash and compared block against block, in as many tasks as there are pairs
of blocks. What a task finds is contracted to one link per fingerprint before it leaves.

Cases: a null text is an empty one; texts without words have fingerprint zero, linked like
any other; texts are read whole; a null ``doc_id`` has a fingerprint but links with nothing
(component null); repeated rows get the same answer each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundflow.llm.common import bounded_batches, fresh, staged
from fundflow.llm.components import components, contracted

SEED = 42
#: Rows of one anchor that are compared in one block.
BLOCK = 2048
#: Groups up to this size are compared together, by offset; larger ones on their own.
SMALL = 32
#: Shingles hashed at a time.
PIECE = 1 << 17
BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, words: int) -> int:
    """The fingerprint as an unsigned integer."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    tokens = (text or "").encode().lower().split()  # A-Z only; bytes split at \x20 and \x09-\x0D
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    starts, width = ends - lengths, min(words, len(tokens))
    starts, ends = starts[:len(tokens) - width + 1], ends[width - 1:]
    ones = np.zeros((8, 8), np.int64)
    for at in range(0, len(starts), PIECE):
        spans = zip(starts[at:at + PIECE].tolist(), ends[at:at + PIECE].tolist())
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8").view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            ones[byte] += np.bincount(hashes[:, byte], minlength=256) @ BITS_OF_BYTE
    return int.from_bytes(np.packbits(2 * ones.reshape(64) > len(starts), bitorder="little").tobytes(), "little")


def fingerprint_column(docs: DataFrame, words: int) -> Column:
    """The fingerprint of ``text`` as a signed long."""
    bounded_batches(docs.sparkSession)

    def column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array([fingerprint(t.as_py(), words) for t in texts], np.uint64).view(np.int64))

    return F.arrow_udf("bigint")(column)(F.col("text").cast("string"))


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint_column(docs, words).alias("fp"))


class Covering:
    """Anchors of 64-bit fingerprints for links of at most ``max_bits`` bits."""

    def __init__(self, max_bits: int):
        if not 0 <= max_bits < 32:
            raise ValueError("max_bits must be from 0 to 31")
        self.segments = max_bits // 2 + 1
        self.checks = (64 // self.segments + 1).bit_length() - 1
        self.length = 2 ** self.checks - 1
        near = max_bits // self.segments  # 0 or 1
        # by syndrome: what to flip to reach each anchor within 1 + near bits
        self.flips: list[np.ndarray] = []
        for s in range(2 ** self.checks):
            masks = [1 << (s - 1) if s else 0]
            if near and s:
                masks += [(1 << (i - 1)) | (1 << ((i ^ s) - 1)) for i in range(1, self.length + 1) if i < i ^ s]
            self.flips.append(np.array(masks, np.uint64))

    def anchors(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, key) of every anchor of every fingerprint."""
        rows, keys = [], []
        for segment in range(self.segments):
            part = (fps >> np.uint64(segment * (64 // self.segments))) & np.uint64((1 << self.length) - 1)
            syndrome = np.zeros(len(fps), np.int64)
            for position in range(1, self.length + 1):
                syndrome ^= np.where(part >> np.uint64(position - 1) & np.uint64(1), position, 0)
            for s in np.unique(syndrome):
                at = np.flatnonzero(syndrome == s)
                words = part[at][:, None] ^ self.flips[s][None, :]
                rows.append(np.repeat(at, words.shape[1]))
                keys.append(words.ravel() * np.uint64(self.segments) + np.uint64(segment))
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *rows]), np.concatenate([none.view(np.uint64), *keys]).view(np.int64)


def close_pairs(group: np.ndarray, fps: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of the same group with at most ``max_bits`` differing bits; rows are sorted by group."""
    if not len(group):
        return
    starts = np.flatnonzero(np.diff(group, prepend=group[0] - 1))
    sizes = np.diff(np.append(starts, len(group)))
    size = np.repeat(sizes, sizes)
    for offset in range(1, min(SMALL, int(sizes.max()))):
        i = np.flatnonzero((size[:-offset] <= SMALL) & (group[offset:] == group[:-offset]))
        i = i[np.bitwise_count(fps[i] ^ fps[i + offset]) <= max_bits]
        if len(i):
            yield i, i + offset
    for start, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        own = fps[start:start + n]
        for at in range(0, n, 128):
            i, j = np.nonzero(np.bitwise_count(own[at:at + 128, None] ^ own[None, at:]) <= max_bits)
            i, j = i[i < j] + at + start, j[i < j] + at + start
            if len(i):
                yield i, j


def links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links (a, b) between representatives of distinct fingerprints that connect all linked ones; fps: (rep, fp)."""
    bounded_batches(fps.sparkSession)
    covering = Covering(max_bits)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "fp"))
            row, key = covering.anchors(fp.view(np.uint64))
            yield pa.RecordBatch.from_pydict({"anchor": pa.array(key), "rep": pa.array(rep[row]), "fp": pa.array(fp[row])})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        columns = ("anchor", "i", "j", "rep", "fp")

        def found(table: pa.Table) -> Iterator[pa.RecordBatch]:
            anchor, i, j, rep, fp = (table.column(c).to_numpy() for c in columns)
            group = np.cumsum((np.diff(anchor, prepend=anchor[:1]) != 0) | (np.diff(i, prepend=i[:1]) != 0)
                              | (np.diff(j, prepend=j[:1]) != 0))
            none = np.zeros(0, np.int64)
            a, b = none, none
            for x, y in close_pairs(group, fp.view(np.uint64), max_bits):
                a, b = contracted(np.concatenate([a, rep[x]]), np.concatenate([b, rep[y]]))
            if len(a):
                yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b)})

        for batch in batches:
            new = pa.Table.from_batches([batch.select(columns)])
            held = new if held is None else pa.concat_tables([held, new])
            last = [held.column(c)[-1].as_py() for c in columns[:3]]
            same = np.ones(held.num_rows, bool)
            for c, v in zip(columns, last):
                same &= held.column(c).to_numpy() == v
            cut = held.num_rows - int(same.sum())  # the last group may go on
            if cut:
                yield from found(held.slice(0, cut))
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from found(held)

    spread_out = fps.mapInArrow(spread, "anchor long, rep long, fp long")
    large = staged(spread_out.groupBy("anchor").count().where(F.col("count") > BLOCK)
                   .select("anchor", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "large-anchors")
    block = F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    return (spread_out.join(large, "anchor", "left")
            .select("anchor", block.alias("own"), other.alias("other"), "rep", "fp")
            .select("anchor", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "fp")
            .repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j")
            .mapInArrow(compare, "a long, b long"))


def groups(docs: DataFrame, words: int = 3, max_bits: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row."""
    rows = staged(fingerprints(docs, words), "fingerprints")
    distinct = staged(rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    joined = components(links(distinct, max_bits))
    of = staged(distinct.join(joined, distinct.rep == joined.node, "left")
                .select("fp", F.coalesce("component", "rep").alias("component_id")), "fingerprint-components")
    return rows.join(of, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, words: int = 3, max_bits: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns, one of each group: that with the smallest id (then fingerprint).

    Rows without an id all stay. Where ids repeat, rows are told apart by id and fingerprint, so rows
    of one id stay as long as they belong to different groups.
    """
    found = staged(groups(docs, words, max_bits), "simhash-groups")
    repeated = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        gone = found.where("doc_id <> component_id").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    f, i = fresh("fp"), fresh("id")
    told = staged(docs.withColumns({f: fingerprint_column(docs, words), i: F.col("doc_id").cast("long")}), "simhash-rows")
    distinct = staged(told.where(F.col(i).isNotNull()).groupBy(F.col(f).alias("fp")).agg(F.min(i).alias("first")), "fingerprint-ids")
    # ids can't stand for fingerprints here, so these are the nodes themselves
    joined = components(links(distinct.select(F.col("fp").alias("rep"), "fp"), max_bits))
    least = (distinct.join(joined, distinct.fp == joined.node, "left")
             .groupBy(F.coalesce("component", "fp")).agg(F.min(F.struct("first", "fp")).alias("k"))
             .select(F.col("k.first").alias(i), F.col("k.fp").alias(f)))
    single = told.join(least, [i, f], "left_semi").dropDuplicates([i, f])
    return single.unionByName(told.where(F.col(i).isNull())).select(docs.columns)
