"""Substring dedup over prefix-partitioned suffixes (operator 2); windows compared by digest instead of a tree.

A text is a sequence of words (runs without \\x20 and \\x09-\\x0D). Every word that starts a
window of ``words`` consecutive words of its document starts a suffix. A word is removed if
a window that covers it also starts in a document with a smaller ``doc_id``.

Suffixes are split by their leading words into groups that fit a task: by the first word,
by the first two where too many suffixes share the first word's cell, and so on up to
LONGEST_PREFIX words (prefixes of variable length, chosen from counts over the whole corpus; a group that
is still crowded there is not split further). Within a group no tree is built: suffixes cut at
depth ``words`` are sorted by the 64-bit digest of their words, and equal digests are taken for equal
words. Sending the words themselves, 13 for each suffix, would shuffle some twenty times the input. Overlapping
repeats of a document are merged to the stretches that are removed.

Documents are dealt to blocks of about BLOCK_BYTES by ranges of ``doc_id``, so a group only
needs to know in which block a suffix occurs: it tells all blocks but the first, and within
a block the documents settle it themselves, in order of ``doc_id``, by the digests of the block and of all
that its groups told it. What moves is about seven bytes a word and the texts once, to their blocks.

Two different windows are confused where their digests agree. With N suffixes in groups of about GROUP_SUFFIXES
and blocks of S suffixes, about N * (GROUP_SUFFIXES + S) / 2**65 pairs are: 1e-5 at 0.5 GB, a few at 100 TB.

Cases: a null text has no words; a document with a null ``doc_id`` neither loses words nor
takes any away; rows with equal ``doc_id`` don't take words from each other; documents with
fewer words than a window stay as they are; texts are read whole; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundflow.llm.common import bounded_batches, slices, staged

WORDS = 13
#: Text of a block, most blocks (beyond that blocks grow), suffixes of a group.
BLOCK_BYTES, MOST_BLOCKS, GROUP_SUFFIXES = 8 << 20, 1 << 20, 1 << 21
#: Most cells of the prefix table for one prefix length, and the longest prefix that is tried.
MOST_CELLS, LONGEST_PREFIX = 1 << 20, 6
#: Bytes that are hashed at once, and text that is gathered before its suffixes are sent.
PIECE, GATHERED = 2 << 20, 12 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BASE = 0x9E3779B97F4A7C15
_random = np.random.default_rng(13)
LETTER = _random.integers(0, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE = _random.integers(0, 2 ** 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64 for i < n."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.cumprod(np.array([1] + [b] * (n - 1), np.uint64)) for b in (BASE, pow(BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_piece(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of a byte string."""
    letters = np.frombuffer(data, np.uint8)
    space = SPACE[letters]
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = powers(max(len(data) + 1, PIECE + 1))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(LETTER[letters] * up[:len(data)])])
    size = (end - start).astype(np.uint64)
    return mix((total[end] - total[start]) * down[start] + size * np.uint64(0xD6E8FEB86659FD93)), start


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word of the texts, in order."""
    hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    at = 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (end == at or size + len(texts[end]) <= PIECE):
            size += len(texts[end])
            end += 1
        if end - at == 1 and size > PIECE:  # a very long text, cut at white space
            rest, cut = texts[at], 0
            while cut < len(rest):
                stop = min(len(rest), cut + PIECE)
                while stop < len(rest) and not SPACE[rest[stop]]:
                    stop += 1
                h, _ = hash_piece(rest[cut:stop])
                hashes.append(h)
                owners.append(np.full(len(h), at))
                cut = stop
        else:
            h, start = hash_piece(b"\n".join(texts[at:end]))
            offsets = np.cumsum([len(t) + 1 for t in texts[at:end]])
            hashes.append(h)
            owners.append(at + np.searchsorted(offsets, start, "right"))
        at = end
    return np.concatenate(hashes), np.concatenate(owners)


def suffixes(texts: list[bytes], words: int, prefix: Callable[[int, np.ndarray], None] | None = None
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digest, first word and text of every suffix with ``words`` words.

    ``prefix`` is called with 0, 1, ... and the digests of the suffixes' first 1, 2, ... words.
    """
    h, owner = hash_words(texts)
    n = max(0, len(h) - words + 1)
    at = np.flatnonzero(owner[:n] == owner[words - 1:]) if n else np.zeros(0, np.int64)
    owner = owner[at]
    total = np.zeros(n, np.uint64)
    for i in range(words):
        total += h[i:i + n] * PLACE[i % len(PLACE)]
        if prefix and i < min(words - 1, LONGEST_PREFIX):
            prefix(i, mix(total[at]))
    return mix(total[at]), at, owner


class Groups:
    """Which group a suffix belongs to: its shortest prefix whose cell isn't crowded."""

    def __init__(self, bits: int, crowded: list[np.ndarray]):
        self.bits, self.crowded = bits, crowded

    def cells(self, prefix: np.ndarray) -> np.ndarray:
        return (prefix >> np.uint64(64 - self.bits)).astype(np.int64)

    def suffixes(self, texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Digest, text and group of every suffix."""
        group, still = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def prefix(depth: int, digests: np.ndarray) -> None:
            nonlocal group, still
            if depth == 0:
                group, still = np.zeros(len(digests), np.int64), np.arange(len(digests))
            cell = self.cells(digests[still])
            group[still] = cell + (depth << self.bits)
            still = still[self.crowded[depth][cell]]

        digest, _, owner = suffixes(texts, words, prefix)
        return digest, owner, group if words > 1 else np.zeros(len(digest), np.int64)


def packed(sorted_digests: np.ndarray) -> bytes:
    """Sorted digests as differences, their bytes by significance (the shuffle compresses what is left)."""
    return np.diff(sorted_digests, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def block_bounds(docs: DataFrame, blocks: int) -> np.ndarray:
    """First doc_id of each block, from a range partitioning of the ids alone."""
    if blocks <= 1:
        return np.zeros(0, np.int64)
    ids = docs.where("doc_id is not null").select("doc_id").repartitionByRange(blocks, "doc_id")
    firsts = ids.groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("first")).collect()  # one row a block
    return np.array(sorted(r["first"] for r in firsts)[1:], np.int64)


def prefix_groups(docs: DataFrame, words: int, estimate: int) -> Groups:
    """Count the suffixes by prefix cell over the whole corpus and mark the crowded cells."""
    bits = max(4, min(MOST_CELLS.bit_length() - 1, (2 * estimate // GROUP_SUFFIXES).bit_length()))
    crowded = [np.zeros(1 << bits, bool) for _ in range(LONGEST_PREFIX)]
    table = Groups(bits, crowded)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((LONGEST_PREFIX, 1 << bits), np.int64)

        def add(depth: int, digests: np.ndarray) -> None:
            total[depth] += np.bincount(table.cells(digests), minlength=1 << bits)

        for batch in batches:
            for piece in slices(batch, "text"):
                suffixes(texts_of(piece.column("text")), words, add)
        depth, cell = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"depth": pa.array(depth, pa.int64()), "cell": pa.array(cell, pa.int64()),
                                          "n": pa.array(total[depth, cell], pa.int64())})

    counts = (docs.select("text").mapInArrow(count, "depth long, cell long, n long").groupBy("depth", "cell")
              .agg(F.sum("n").alias("n")).where(F.col("n") > GROUP_SUFFIXES))
    for r in counts.toLocalIterator():  # at most LONGEST_PREFIX x MOST_CELLS rows
        crowded[r["depth"]][r["cell"]] = True
    return table


def remove_repeats(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_words, removed (stretches of removed words: start, end) and kept (what is left) of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, min(MOST_BLOCKS, -(-size // BLOCK_BYTES)))
    with_id = docs.where("doc_id is not null")
    held = spark.sparkContext.broadcast((block_bounds(docs, blocks), prefix_groups(with_id, words, size // 6)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, groups = held.value
        texts, ids, size = [], [], 0

        def flushed() -> pa.RecordBatch:
            digest, owner, key = groups.suffixes(texts, words)
            key *= len(bounds) + 1
            key += np.searchsorted(bounds, np.array(ids, np.int64), "right")[owner]
            del owner
            order = np.argsort(digest)
            order = order[np.argsort(key[order], kind="stable")]
            key, digest = key[order], digest[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])
            key, digest = key[new], digest[new]
            cut = np.flatnonzero(np.diff(key, prepend=-1))
            lists = [packed(digest[a:b]) for a, b in zip(cut, np.append(cut[1:], len(key)))]
            return pa.RecordBatch.from_pydict({
                "part": pa.array(key[cut] // (len(bounds) + 1), pa.int64()),
                "block": pa.array(key[cut] % (len(bounds) + 1), pa.int64()), "digests": pa.array(lists, pa.binary())})

        for batch in batches:
            for piece in slices(batch, "text"):
                more = texts_of(piece.column("text"))
                texts += more
                ids += piece.column("doc_id").to_pylist()
                size += sum(map(len, more))
                if size >= GATHERED:
                    yield flushed()
                    texts, ids, size = [], [], 0
        if texts:
            yield flushed()

    def subtree(group: pa.Table) -> pa.Table:
        """For each block the suffixes that also start in an earlier block."""
        lists = [unpacked(d) for d in group.column("digests").to_pylist()]
        block = np.repeat(group.column("block").to_numpy(), [len(x) for x in lists])
        digest = np.concatenate(lists)
        order = np.argsort(digest, kind="stable")
        digest, block = digest[order], block[order]
        node = np.flatnonzero(np.concatenate([[True], digest[1:] != digest[:-1]]))
        first = np.repeat(np.minimum.reduceat(block, node), np.diff(np.append(node, len(digest))))
        later = np.flatnonzero(block > first)
        later = later[np.argsort(block[later], kind="stable")]
        block, digest = block[later], digest[later]
        cut = np.flatnonzero(np.diff(block, prepend=-1))
        return pa.table({"block": pa.array(block[cut], pa.int64()), "digests": pa.array(
            [packed(np.unique(digest[a:b])) for a, b in zip(cut, np.append(cut[1:], len(block)))], pa.binary())})

    def settle(documents: pa.Table, lists: pa.Table) -> pa.Table:
        """Remove the repeats of the documents of one block."""
        documents = documents.sort_by([("doc_id", "ascending")])
        texts, ids = texts_of(documents.column("text")), documents.column("doc_id").to_pylist()
        known = [i is not None for i in ids]
        digest, start, owner = suffixes([t if k else b"" for t, k in zip(texts, known)], words)
        number = np.array([i if k else 0 for i, k in zip(ids, known)], np.int64)[owner]
        order = np.argsort(digest, kind="stable")  # documents are in order, so the first of a node has the smallest id
        node = np.flatnonzero(np.concatenate([np.ones(min(1, len(digest)), bool), digest[order][1:] != digest[order][:-1]]))
        repeated = np.zeros(len(digest), bool)
        if len(node):
            least = np.repeat(number[order][node], np.diff(np.append(node, len(order))))
            repeated[order] = number[order] > least
        earlier = [unpacked(d) for d in lists.column("digests").to_pylist()]
        if earlier:
            repeated |= np.isin(digest, np.concatenate(earlier))
        split = [t.split() for t in texts]
        first = np.concatenate([[0], np.cumsum([len(w) if k else 0 for w, k in zip(split, known)])])
        change = np.zeros(int(first[-1]) + words + 1, np.int64)
        np.add.at(change, start[repeated], 1)
        np.add.at(change, start[repeated] + words, -1)
        gone = np.cumsum(change)[:int(first[-1])] > 0
        kept, removed = [], []
        for w, a, k in zip(split, first, known):
            own = gone[a:a + len(w)] if k else np.zeros(len(w), bool)
            kept.append((b" ".join(compress(w, ~own)) if own.any() else b" ".join(w)).decode())
            edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
            removed.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])])
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"doc_id": documents.column("doc_id"), "n_words": pa.array([len(w) for w in split], pa.int64()),
                         "removed": pa.array(removed, spans), "kept": pa.array(kept, pa.string())})

    def block_of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        bounds = held.value[0]
        for ids, spread in batches:
            at = np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False), "right")
            yield pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), spread.to_numpy(zero_copy_only=False), at), pa.int64())

    told = staged(with_id.mapInArrow(send, "part long, block long, digests binary").groupBy("part")
                  .applyInArrow(subtree, "block long, digests binary"), "suffix-repeats")
    spread = F.pmod(F.xxhash64("text"), F.lit(blocks)).cast("long")
    blocked = docs.withColumn("block", F.arrow_udf("bigint")(block_of)(F.col("doc_id"), spread))
    return (blocked.groupBy("block").cogroup(told.groupBy("block"))
            .applyInArrow(settle, "doc_id long, n_words long, removed array<struct<start: bigint, end: bigint>>, kept string"))
