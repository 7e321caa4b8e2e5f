"""Benchmark decontamination: CGK embedding, bit-sampling LSH, edit verification (operator 7).

Texts are sequences of words (lower-cased runs of letters, digits and underscores). An item
is found where some stretch of a document is within ``k = floor((1 - SIMILARITY) * n)`` word
edits of its n words.

1. CGK walks fall out of step more the longer a text is, so items of more than PART words are
   looked for by parts of about equal length, at most PART words. One of m parts holds at most
   k // m of the edits, which is within that part's own k. A shorter item is one part.
2. Windows of the part's length start at every word where they can hold a match at all: a
   part of n words keeps at least n - 2 - 3k of its three-word runs under k edits (a lower
   bound of 1 means any; short parts use single words), so a window with fewer runs of any
   part is out. This loses nothing.
3. Parts are put in classes by length; a window of a class is embedded by REPEATS CGK random
   walks over the first words that every part of the class has. A walk emits the word it
   stands on and steps on by a random bit of that word, which turns word edits into few
   differing places.
4. Each walk is sampled at SAMPLED places; a window meets the parts with the same sample.
   SAMPLED and REPEATS are set for a recall of 0.95 at the similarity itself, where least
   agrees, for parts of PART words (measured in the tests, up to items of 500 words); closer
   copies agree far more often, and an item of several parts need only be met by one of them.
5. Each meeting is verified by the exact edit distance of the whole item to the best stretch
   around the place where the part puts it.

The benchmark goes to the workers in chunks of at most CHUNK_WORDS words, one pass over the
documents for each, so what is broadcast has a bound whatever the benchmark's size; the
documents are never shuffled.

Cases: null texts and texts without words match nothing; null items, and items without
words, are left out; repeated items and documents give a row each; documents are read
whole; an empty table on either side gives an empty result; other columns are ignored or
(in ``drop_contaminated``) kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundflow.llm.common import bounded_batches, fresh

SIMILARITY = 0.8
REPEATS, SAMPLED = 16, 3
#: Longest text that is embedded in one piece; REPEATS and SAMPLED are set for it.
PART = 60
#: Parts of one class are up to this much longer than its window.
CLASS_RATIO = 1.25
#: Words of the benchmark that are broadcast at once.
CHUNK_WORDS = 1_000_000
#: Indexes of chunks that a worker process keeps.
INDEXES = 2
#: Windows embedded at a time.
WINDOWS = 4096
WORD = re.compile(r"\w+")


def edits(n: int) -> int:
    return int((1 - SIMILARITY) * n + 1e-9)


def least_runs(n: int) -> tuple[int, int]:
    """Length of the runs that are counted for items of n words, and how many a match keeps at least."""
    return (3, n - 2 - 3 * edits(n)) if n >= 6 else (1, n - edits(n))


def cuts(n: int) -> list[tuple[int, int]]:
    """(start, end) of the parts of an item of n words."""
    at = [n * i // -(-n // PART) for i in range(-(-n // PART) + 1)]
    return list(zip(at, at[1:]))


class Part(NamedTuple):
    """The words of an item from ``offset`` on; all of them if it has no more than PART."""

    item: int
    offset: int
    ids: np.ndarray


class Class(NamedTuple):
    """Parts whose length is from ``words`` up to CLASS_RATIO times that."""

    words: int
    longest: int
    run: int
    least: int
    odd: np.ndarray
    places: np.ndarray
    keys: list[np.ndarray]
    owners: list[np.ndarray]


def signature(ids: np.ndarray, starts: np.ndarray, words: int, bits: np.ndarray, odd: np.ndarray, places: np.ndarray) -> np.ndarray:
    """(windows, repeats) LSH keys: CGK walks over ``words`` words from each start, sampled at ``places``."""
    at = np.zeros((len(starts), REPEATS), np.int64)
    key = np.zeros((len(starts), REPEATS), np.uint64)
    for step in range(int(places.max()) + 1):
        place = starts[:, None] + np.minimum(at, words - 1)
        symbol = np.where(at < words, ids[np.minimum(place, len(ids) - 1)], 0)
        taken = (places == step).any(axis=1)
        if taken.any():
            key[:, taken] = key[:, taken] * np.uint64(0x9E3779B97F4A7C15) + symbol[:, taken].astype(np.uint64) + np.uint64(1)
        at += (bits[symbol] * odd[step] >> np.uint64(63)).astype(np.int64)
    return key


def best_stretch(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end) of the stretch of ``region`` with the least edit distance to ``item`` (leftmost end)."""
    def last_row(a: np.ndarray, b: np.ndarray, free: bool) -> np.ndarray:
        steps = np.arange(len(b) + 1)
        row = np.zeros(len(b) + 1, np.int64) if free else steps.copy()
        for i, word in enumerate(a):
            new = np.empty_like(row)
            new[0] = i + 1
            new[1:] = np.minimum(row[:-1] + (b != word), row[1:] + 1)
            row = np.minimum.accumulate(new - steps) + steps
        return row

    ends = last_row(item, region, True)
    end = int(ends.argmin())
    back = last_row(item[::-1], region[:end][::-1], False)
    return int(ends[end]), end - int(back.argmin()), end


class Benchmark:
    """The items of one chunk, indexed."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.names = [name for name, _ in items]
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for _, words in items for w in words}))}
        self.items = [np.array([self.vocabulary[w] for w in words], np.int64) for _, words in items]
        self.base = len(self.vocabulary) + 1
        self.bits = np.random.default_rng(7).integers(0, 2 ** 63, self.base, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.item_runs = {run: [np.unique(self.runs(x, run)) for x in self.items] for run in (1, 3)}
        self.parts = [Part(i, a, x[a:b]) for i, x in enumerate(self.items) for a, b in cuts(len(x))]
        self.used = {run: np.unique(np.concatenate([np.zeros(0, np.int64),
                                                    *(self.runs(p.ids, run) for p in self.parts
                                                      if least_runs(len(p.ids))[0] == run)])) for run in (1, 3)}
        self.classes, lengths = [], np.array([len(p.ids) for p in self.parts], np.int64)
        left = sorted(set(lengths.tolist()))
        while left:
            words = left[0]
            fits = [n for n in left if n <= max(words, int(words * CLASS_RATIO)) and least_runs(n)[0] == least_runs(words)[0]]
            left = left[len(fits):]
            self.classes.append(self.build(words, fits, np.flatnonzero(np.isin(lengths, fits))))

    def build(self, words: int, fits: list[int], parts: np.ndarray) -> Class:
        random = np.random.default_rng(words)
        steps = max(2 * words, 1)
        odd = random.integers(0, 2 ** 63, (steps, REPEATS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        places = random.integers(0, steps, (REPEATS, SAMPLED))
        texts = np.concatenate([self.parts[i].ids for i in parts])
        starts = np.cumsum([0, *(len(self.parts[i].ids) for i in parts[:-1])])
        keys = signature(texts, starts, words, self.bits, odd, places)
        order = [np.argsort(keys[:, r], kind="stable") for r in range(REPEATS)]
        return Class(words, max(fits), least_runs(words)[0], max(1, min(least_runs(n)[1] for n in fits)), odd, places,
                     [keys[o, r] for r, o in enumerate(order)], [parts[o] for o in order])

    def runs(self, ids: np.ndarray, run: int) -> np.ndarray:
        """Codes of the runs of known words (0 where a word is unknown)."""
        if len(ids) < run:
            return np.zeros(0, np.int64)
        if run == 1:
            return ids
        code = (ids[:-2] * self.base + ids[1:-1]) * self.base + ids[2:]
        return np.where((ids[:-2] > 0) & (ids[1:-1] > 0) & (ids[2:] > 0), code, 0)

    def windows(self, ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(class, starts) of the windows of a text that can hold a part of the class."""
        hits = {run: np.concatenate([[0], np.cumsum(among(self.runs(ids, run), used))]) for run, used in self.used.items()}
        for c, k in enumerate(self.classes):
            total = hits[k.run]
            if total[-1] < k.least:
                continue
            start = np.arange(len(total) - 1)
            end = np.minimum(start + k.longest + edits(k.longest) - k.run + 1, len(total) - 1)
            starts = np.flatnonzero(total[end] - total[start] >= k.least)
            # a match may begin with up to k changed words, never before them
            if len(starts):
                yield c, starts

    def candidates(self, texts: list[np.ndarray]) -> dict[tuple[int, int], list[int]]:
        """(text, item) -> where the windows that meet a part of the item put the item's start, for a list of texts."""
        found: dict[tuple[int, int], list[int]] = {}
        if not self.classes:
            return found
        per_class: list[list[tuple[int, np.ndarray]]] = [[] for _ in self.classes]
        for t, ids in enumerate(texts):
            if len(ids):
                for c, starts in self.windows(ids):
                    per_class[c].append((t, starts))
        for k, windows in zip(self.classes, per_class):
            if not windows:
                continue
            # the texts that have windows, each followed by unknown words up to the window's length
            joined, offsets, at = [], {}, 0
            for t, _ in windows:
                offsets[t] = at
                joined += [texts[t], np.zeros(k.words, np.int64)]
                at += len(texts[t]) + k.words
            ids = np.concatenate(joined)
            owner = np.concatenate([np.full(len(s), t) for t, s in windows])
            start = np.concatenate([s for _, s in windows])
            shift = np.concatenate([np.full(len(s), offsets[t]) for t, s in windows])
            for at in range(0, len(start), WINDOWS):
                part = slice(at, at + WINDOWS)
                keys = signature(ids, start[part] + shift[part], k.words, self.bits, k.odd, k.places)
                for r in range(REPEATS):
                    low = np.searchsorted(k.keys[r], keys[:, r], "left")
                    high = np.searchsorted(k.keys[r], keys[:, r], "right")
                    for w in np.flatnonzero(high > low):
                        for p in k.owners[r][low[w]:high[w]]:
                            item, offset, _ = self.parts[p]
                            found.setdefault((int(owner[part][w]), item), []).append(int(start[part][w]) - offset)
        return found

    def verified(self, ids: np.ndarray, item: int, starts: list[int]) -> Iterator[tuple[int, int, int]]:
        """(start, end, distance) in words of the matches of an item near the given starts."""
        words = self.items[item]
        n, k = len(words), edits(len(words))
        run, least = least_runs(n)
        # up to k words more or less may lie between the item's start and a part that isn't the first
        drift = k if n > PART else 0
        starts = sorted(set(starts))
        at = 0
        while at < len(starts):
            last = at
            while last + 1 < len(starts) and starts[last + 1] - starts[last] <= n + 2 * drift:
                last += 1
            low, high = max(0, starts[at] - k - drift), min(len(ids), starts[last] + n + 2 * k + drift)
            at = last + 1
            left = [(low, high)]
            while left:
                low, high = left.pop()
                region = ids[low:high]
                if not len(region) or among(self.runs(region, run), self.item_runs[run][item]).sum() < least:
                    continue
                distance, start, end = best_stretch(words, region)
                if distance <= k:
                    yield low + start, low + end, distance
                    left += [(low, low + start), (low + end, high)]

    def matches(self, texts: list[str]) -> Iterator[list[tuple[int, int, int, int, float]]]:
        """For each text (item, start, end, distance, similarity) of its matches; offsets in code points."""
        ids = [np.fromiter(map(self.vocabulary.get, words, [0] * len(words)), np.int64, len(words))
               for words in (WORD.findall(t.lower()) for t in texts)]
        by_text: dict[int, list[tuple[int, int, int, int]]] = {}
        for (t, item), starts in sorted(self.candidates(ids).items()):
            by_text.setdefault(t, []).extend((item, *m) for m in self.verified(ids[t], item, starts))
        for t, text in enumerate(texts):
            out = []
            if by_text.get(t):
                # lower-casing may change lengths, so places are looked up word by word
                places = [(m.start(), m.end()) for m in WORD.finditer(text)]
                if len(places) != len(ids[t]):
                    places = [(m.start(), m.end()) for m in WORD.finditer(text.lower())]
                for item, start, end, distance in sorted(by_text[t]):
                    n = len(self.items[item])
                    out.append((self.names[item], places[start][0], places[end - 1][1], distance, 1 - distance / n))
            yield out


def among(codes: np.ndarray, used: np.ndarray) -> np.ndarray:
    """Whether each code is in a sorted array (0 never is)."""
    if not len(used) or not len(codes):
        return np.zeros(len(codes), bool)
    return (codes > 0) & (used[np.minimum(np.searchsorted(used, codes), len(used) - 1)] == codes)


MATCH = pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("distance", pa.int32()),
                   ("similarity", pa.float64())])
MATCHES = "array<struct<item_id: bigint, start: bigint, end: bigint, distance: int, similarity: double>>"


_indexes: dict[str, Benchmark] = {}


def index_of(key: str, items) -> Benchmark:
    """The index of a broadcast chunk, made once by each worker process; a worker keeps INDEXES of them."""
    if key not in _indexes:
        while len(_indexes) >= INDEXES:
            del _indexes[next(iter(_indexes))]
        _indexes[key] = Benchmark(items.value)
    return _indexes[key]


def matcher(items, key: str):
    """Column function text -> matches with a broadcast list of (item_id, words); ``key`` is a digest of it."""
    fields = [f.name for f in MATCH]

    def column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = index_of(key, items)
        for texts in batches:
            found = index.matches([t.as_py() or "" for t in texts])
            yield pa.array([[dict(zip(fields, m)) for m in of] for of in found], pa.list_(MATCH))

    return F.arrow_udf(MATCHES)(column)


def match_columns(spark, benchmark: DataFrame, least_words: int = 1) -> list:
    """Column functions text -> matches, one for each chunk of the benchmark's items of at least ``least_words``."""
    bounded_batches(spark)
    items = (benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
             .where("item_id is not null and text is not null"))
    words = F.size(F.split("text", r"\W+"))
    total = items.agg(F.sum(words)).first()[0] or 0
    chunks = int(-(-total // CHUNK_WORDS))
    made = []
    for chunk in range(chunks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)) == chunk).collect()  # about CHUNK_WORDS words
        listed = sorted((r.item_id, words) for r in rows if len(words := WORD.findall(r.text.lower())) >= max(1, least_words))
        key = hashlib.sha256(repr(listed).encode()).hexdigest()
        made.append(matcher(spark.sparkContext.broadcast(listed), key))
    return made


def matches_of(spark, benchmark: DataFrame, least_words: int = 1):
    """Column: all matches of ``text`` with the benchmark."""
    made = [c(F.col("text").cast("string")) for c in match_columns(spark, benchmark, least_words)]
    return F.concat(*made) if made else F.lit(None).cast(MATCHES)


def contaminated(docs: DataFrame, benchmark: DataFrame, least_words: int = 1) -> DataFrame:
    """One row for each match: doc_id, item_id, start, end (code points), distance (words), similarity.

    ``least_words``: shorter items are not looked for (one of a word or two is found wherever they are said)."""
    m = fresh("match")
    found = docs.select("doc_id", matches_of(docs.sparkSession, benchmark, least_words).alias(m))
    return found.select("doc_id", F.explode(m).alias(m)).select("doc_id", f"{m}.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least_words: int = 1) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item of at least ``least_words`` words."""
    m = fresh("match")
    found = docs.withColumn(m, matches_of(docs.sparkSession, benchmark, least_words))
    return found.where(F.coalesce(F.size(m), F.lit(0)) <= 0).drop(m)
