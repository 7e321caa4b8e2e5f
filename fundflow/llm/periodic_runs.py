"""Periodic run detection by descending-LCP Kruskal (operator 12).

A text is its sequence of words (runs without \\x20 and \\x09-\\x0D). A run is a stretch of words with
smallest period q (words q apart are identical) that no neighbouring word extends keeping q, here with
at least ``times`` periods and ``least`` words. For each text:

1. Suffixes are sorted by prefix doubling: classes of equal windows of 1, 2, 4, ... words are refined,
   and a suffix that is alone in its class is not looked at again. The classes of each width give
   the length of the common prefix (LCP) of neighbours in the order.
2. Neighbours are united by decreasing LCP. Each class is an ordered set of positions; the smaller set is
   put into the larger one, and where two positions x < y become adjacent, the LCP of their suffixes is
   the value at hand. At a distance within the LCP they seed a run: the words from x to y + LCP have
   period y - x. Nothing nearer to x has so long a common prefix with it, so that period is the smallest; if the
   words before x and y differ, the stretch can't grow on the left, as it can't on the right.

A run has a seed at its first word and its distance is the period, so none is missed. A seed needs an LCP of
``least`` - q and of (times - 1) q, whichever is more: suffixes are united only down to the least LCP that
can occur, and classes whose positions lie too far apart for their longest LCP are left out before.

Texts are independent rows; a task works on a few megabytes of them at a time (one text at least). Memory
is about 150 bytes a word of that, the time n log n in the words of repeats and linear in the others.

Cases: a null text has no words and no runs; repeated rows are judged each; a text is read whole;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundflow.llm.common import bounded_batches, slices

#: Least words of a run, and its least length in periods.
LEAST, TIMES = 24, 3
#: Bytes of text that are worked on at once.
PIECE = 2 << 20
#: Positions in one bucket of an ordered set.
BUCKET = 1024

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def least_lcp(least: int, times: int) -> int:
    """The least LCP of a run's first suffix with the one a period later, over all periods."""
    return min(max(least - q, (times - 1) * q) for q in range(1, least + 1))


class Places:
    """An ordered set of positions, in buckets."""

    def __init__(self, first: int):
        self.buckets, self.tops, self.size = [[first]], [first], 1

    def add(self, x: int) -> tuple[int, int]:
        """Put ``x`` in; the positions before and after it (-1: none)."""
        i = bisect_left(self.tops, x)
        self.size += 1
        if i == len(self.tops):
            i -= 1
            bucket = self.buckets[i]
            before, after = bucket[-1], -1
            bucket.append(x)
            self.tops[i] = x
        else:
            bucket = self.buckets[i]
            j = bisect_left(bucket, x)
            before = bucket[j - 1] if j else self.buckets[i - 1][-1] if i else -1
            after = bucket[j]
            bucket.insert(j, x)
        if len(bucket) > BUCKET:
            half = len(bucket) // 2
            self.buckets[i:i + 1] = [bucket[:half], bucket[half:]]
            self.tops.insert(i, bucket[half - 1])
        return before, after


def classes(words: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Width and class of every position for windows of 1, 2, 4, ... words, while windows repeat.

    A class is the number of windows before its first one in the suffix order; classes of one text
    only (``owner``) are ever equal.
    """
    n, base = len(words), int(words.max(initial=0)) + 1
    key = owner.astype(np.int64) * base + words
    rank, active, width = np.zeros(n, np.int64), np.arange(n), 1
    start = np.zeros(n, np.int64)  # of each active position's class
    while len(active):
        order = np.lexsort((key, start)) if width > 1 else np.argsort(key, kind="stable")
        key, start, active = key[order], start[order], active[order]
        new = np.ones(len(active), bool)
        new[1:] = (key[1:] != key[:-1]) | (start[1:] != start[:-1])
        head = np.flatnonzero(new)
        outer = np.ones(len(active), bool)  # first of its old class
        outer[1:] = start[1:] != start[:-1]
        within = np.arange(len(active)) - np.maximum.accumulate(np.where(outer, np.arange(len(active)), 0))
        sizes = np.diff(np.append(head, len(active)))
        start = np.repeat((start + within)[head], sizes)
        rank = rank.copy()
        rank[active] = start
        yield width, rank
        many = np.repeat(sizes > 1, sizes)
        active, start = active[many], start[many]
        beyond = active + width
        key = np.where(beyond < n, rank[np.minimum(beyond, n - 1)], -beyond)
        width *= 2


def common_prefix(levels: list[tuple[int, np.ndarray]], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Words that the suffixes at ``p`` and ``q`` have in common."""
    n, lcp = len(levels[0][1]), np.zeros(len(p), np.int64)
    for width, rank in reversed(levels):
        a, b = p + lcp, q + lcp
        inside = (a < n) & (b < n)
        lcp += width * (inside & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)]))
    return lcp


def neighbours(words: np.ndarray, owner: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours in the suffix order with at least ``floor`` words in common, and their LCP."""
    levels = list(classes(words, owner))
    if not levels:
        return (np.zeros(0, np.int64),) * 3
    at = max(i for i, (width, _) in enumerate(levels) if width <= floor)
    coarse, finest = levels[at][1], levels[-1][1]
    order = np.argsort(finest, kind="stable")
    p, q = order[:-1], order[1:]
    alike = coarse[p] == coarse[q]
    p, q = p[alike], q[alike]
    lcp = common_prefix(levels, p, q)
    enough = lcp >= floor
    return p[enough], q[enough], lcp[enough]


def near_enough(p: np.ndarray, q: np.ndarray, lcp: np.ndarray, times: int) -> np.ndarray:
    """Which neighbours belong to classes with two positions near enough for their longest LCP."""
    chained = np.concatenate([np.zeros(min(1, len(p)), bool), p[1:] != q[:-1]])
    group = np.cumsum(chained)
    every = np.concatenate([p, q])
    of = np.concatenate([group, group])
    order = np.lexsort((every, of))
    every, of = every[order], of[order]
    gap = np.diff(every)
    gap[(of[1:] != of[:-1]) | (gap == 0)] = np.iinfo(np.int64).max // times
    least = np.full(int(group[-1]) + 1 if len(group) else 0, np.iinfo(np.int64).max // times)
    np.minimum.at(least, of[1:], gap)
    longest = np.zeros(len(least), np.int64)
    np.maximum.at(longest, group, lcp)
    return ((times - 1) * least <= longest)[group]


def runs(words: np.ndarray, owner: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """First position, length and period of every run of the texts, in order; ``owner`` is each word's text."""
    p, q, lcp = neighbours(words, owner, least_lcp(least, times))
    use = near_enough(p, q, lcp, times)
    order = np.argsort(-lcp[use], kind="stable")
    edges = zip(*(x[use][order].tolist() for x in (p, q, lcp)))
    sets: dict[int, Places] = {}
    root: dict[int, int] = {}
    found: set[tuple[int, int, int]] = set()

    def find(x: int) -> int:
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    def seed(x: int, y: int, common: int) -> None:
        d = y - x
        if (times - 1) * d <= common and common + d >= least and (x == 0 or owner[x - 1] != owner[x] or words[x - 1] != words[y - 1]):
            found.add((x, common + d, d))

    for a, b, common in edges:
        a, b = find(a), find(b)
        one, two = sets.get(a) or Places(a), sets.get(b) or Places(b)
        if one.size < two.size:
            a, b, one, two = b, a, two, one
        root[b] = a
        sets.pop(b, None)
        sets[a] = one
        small = list(chain.from_iterable(two.buckets))
        for last, x, following in zip([-1, *small], small, [*small[1:], -1]):
            before, after = one.add(x)
            if before >= 0 and before != last:  # neighbours within the smaller set have met before
                seed(before, x, common)
            if after >= 0 and not 0 <= following < after:
                seed(x, after, common)
    return sorted(found)


def judged(texts: list[bytes], least: int, times: int) -> Iterator[tuple[int, list[dict], bytes]]:
    """Words, runs and the text that is left of each text."""
    split = [t.split() for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    words = pc.dictionary_encode(pa.array(list(chain.from_iterable(split)), pa.large_binary())).indices.to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), counts)
    found: dict[int, list[tuple[int, int, int]]] = {}
    for start, length, period in runs(words, owner, least, times):
        text = int(owner[start])
        found.setdefault(text, []).append((start - int(first[text]), length, period))
    for i, w in enumerate(split):
        own = found.get(i, [])
        if own:
            gone = np.zeros(len(w) + 1, np.int64)
            for start, length, period in own:
                gone[start + period] += 1
                gone[start + length] -= 1
            w = [x for x, g in zip(w, np.cumsum(gone).tolist()) if not g]
        yield len(split[i]), [{"start": s, "length": n, "period": q} for s, n, q in own], b" ".join(w)


def collapse(docs: DataFrame, text: str | Column = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (start, length, period, in order) and kept of every row: the text without the words
    that a run holds after its first period, joined by one space."""
    bounded_batches(docs.sparkSession)
    run = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text", PIECE):
                texts = [t or b"" for t in piece.column("text").cast(pa.binary()).to_pylist()]
                n, found, kept = zip(*judged(texts, least, times))
                yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id"), "n_words": pa.array(n, pa.int64()),
                                                  "runs": pa.array(found, pa.list_(run)), "kept": pa.array([k.decode() for k in kept], pa.string())})

    text = F.col(text) if isinstance(text, str) else text
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.cast("string").alias("text")).mapInArrow(
        apply, f"doc_id long, n_words long, runs {RUNS}, kept string")
