"""Quality classifier: a generalised additive model with pairwise interactions (operator 9).

Each text becomes the numbers of FEATURES; each number falls into one of at most BINS bins
cut at quantiles of the training sample. Shallow trees on one feature at a time are boosted
in turn, over and over; their sum per feature is a lookup table. Then the PAIRS pairs whose
joint cut explains most of what is left get tables of two dimensions in the same way. The
score is the logistic function of the sum of the looked-up values, so a batch is scored
with a few vectorised additions.

The tables are fitted to a bounded sample, about LABELLED_ROWS labelled rows chosen by a
hash of the id. Nothing but the text enters a score.

Cases: a null or empty text has the numbers of an empty text and is scored like any other;
labels that are null, without a document or with a null id are left out; repeated labels
of a document count once for each value; if the labels have one value only (or none) every
score is near that value (or 0.5); texts are read whole; repeated rows are scored each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundflow.llm.common import bounded_batches, fresh, id_remainder, slices

FEATURES = ("log_words", "word_length", "upper", "digits", "marks", "letters", "marked_words", "distinct_words",
            "top_word", "distinct_lines", "words_a_line", "top_mark", "long_words", "repeated_next")
#: Labelled rows that are fitted (on average, by hash); bins of a feature and of each side of a pair.
LABELLED_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
#: Rounds over the features and over the pairs, step, leaves' L2 penalty, least weight of a leaf, cuts of a tree.
ROUNDS, PAIR_ROUNDS, RATE, PENALTY, LEAST, CUTS = 150, 50, 0.1, 1.0, 2.0, 2

UPPER, LOWER, DIGIT, SPACE, MARK = range(5)
_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """The kind of every code point."""
    if not _kinds:
        def kind(c: str) -> int:
            if c.isalpha():
                return UPPER if c.isupper() else LOWER
            return DIGIT if c.isdigit() else SPACE if c.isspace() else MARK

        _kinds.append(np.fromiter(map(kind, map(chr, range(0x110000))), np.uint8, 0x110000))
    return _kinds[0]


def features(text: str | None) -> list[float]:
    text = text or ""
    words = text.split()
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    of = kinds()[points]
    count = np.bincount(of, minlength=5)
    shown = max(1, len(text) - int(count[SPACE]))
    letters = int(count[UPPER] + count[LOWER])
    marks = points[of == MARK]
    n = max(1, len(words))
    often = Counter(words)
    lines = [line for line in text.split("\n") if line.strip()]
    last = np.array([ord(w[-1]) for w in words], np.int64)
    return [
        float(np.log1p(len(words))), shown / n, float(count[UPPER]) / max(1, letters), float(count[DIGIT]) / shown,
        float(count[MARK]) / shown, letters / shown, float((kinds()[last] == MARK).sum()) / n, len(often) / n,
        max(often.values(), default=0) / n, len(set(lines)) / max(1, len(lines)), len(words) / max(1, len(lines)),
        float(np.unique(marks, return_counts=True)[1].max()) / shown if len(marks) else 0.0,
        sum(len(w) > 20 for w in words) / n, sum(a == b for a, b in zip(words, words[1:])) / n]


class Model(NamedTuple):
    cuts: list[np.ndarray]
    bias: float
    tables: list[np.ndarray]
    pair_cuts: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Scores of a matrix of features by adding up looked-up values."""
        total = np.full(len(x), self.bias)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[j], x[:, j], "right")]
        for (j, k), table in zip(self.pairs, self.pair_tables):
            total += table[np.searchsorted(self.pair_cuts[j], x[:, j], "right"), np.searchsorted(self.pair_cuts[k], x[:, k], "right")]
        return 1 / (1 + np.exp(-total))


def quantile_cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins)) if len(x) else np.zeros(0)


def leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return -g / (h + PENALTY)


def gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + PENALTY)


def tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf value of each bin for a tree of at most CUTS + 1 leaves on gradient sums by bin."""
    parts = [(0, len(g))]
    for _ in range(CUTS):
        best, at = 1e-9, None
        for p, (a, b) in enumerate(parts):
            gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            gr, hr = g[a:b].sum() - gl, h[a:b].sum() - hl
            more = np.where((hl >= LEAST) & (hr >= LEAST), gain(gl, hl) + gain(gr, hr) - gain(g[a:b].sum(), h[a:b].sum()), -1)
            if len(more) and more.max() > best:
                best, at = more.max(), (p, a + 1 + int(more.argmax()))
        if at is None:
            break
        a, b = parts[at[0]]
        parts[at[0]:at[0] + 1] = [(a, at[1]), (at[1], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = leaf(g[a:b].sum(), h[a:b].sum())
    return out


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best cross cut of a two-dimensional table of gradient sums."""
    def corners(m: np.ndarray) -> list[np.ndarray]:
        c = m.cumsum(0).cumsum(1)
        low, left, top, every = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1], c[-1, -1]
        return [low, left - low, top - low, every - left - top + low]

    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    gs, hs = corners(g), corners(h)
    total = sum(gain(a, b) for a, b in zip(gs, hs)) - gain(g.sum(), h.sum())
    i, j = np.unravel_index(int(total.argmax()), total.shape)
    out = np.empty_like(g)
    for (rows, columns), a, b in zip(((slice(0, i + 1), slice(0, j + 1)), (slice(0, i + 1), slice(j + 1, None)),
                                      (slice(i + 1, None), slice(0, j + 1)), (slice(i + 1, None), slice(j + 1, None))), gs, hs):
        out[rows, columns] = leaf(a[i, j], b[i, j])
    return float(total[i, j]), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting of one-feature trees, then of two-feature trees."""
    f = len(FEATURES)
    share = (y.sum() + 0.5) / (len(y) + 1)
    cuts = [quantile_cuts(x[:, j], BINS) for j in range(f)]
    pair_cuts = [quantile_cuts(x[:, j], PAIR_BINS) for j in range(f)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    bias = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Model(cuts, bias, tables, pair_cuts, [], [])
    total = np.full(len(y), bias)
    at = [np.searchsorted(cuts[j], x[:, j], "right") for j in range(f)]

    def sums(where: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return np.bincount(where, p - y, size), np.bincount(where, p * (1 - p), size)

    for _ in range(ROUNDS):
        for j in range(f):
            step = RATE * tree(*sums(at[j], len(tables[j])))
            tables[j] += step
            total += step[at[j]]
    two = [np.searchsorted(pair_cuts[j], x[:, j], "right") for j in range(f)]
    shape = lambda j, k: (len(pair_cuts[j]) + 1, len(pair_cuts[k]) + 1)

    def cross(j: int, k: int) -> tuple[float, np.ndarray]:
        a, b = shape(j, k)
        g, h = sums(two[j] * b + two[k], a * b)
        return quadrants(g.reshape(a, b), h.reshape(a, b))

    ranked = sorted(((cross(j, k)[0], j, k) for j in range(f) for k in range(j)), reverse=True)[:PAIRS]
    pairs = [(j, k) for more, j, k in ranked if more > 0]
    pair_tables = [np.zeros(shape(j, k)) for j, k in pairs]
    for _ in range(PAIR_ROUNDS):
        for i, (j, k) in enumerate(pairs):
            step = RATE * cross(j, k)[1]
            pair_tables[i] += step
            total += step[two[j], two[k]]
    return Model(cuts, bias, tables, pair_cuts, pairs, pair_tables)


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality") -> Model:
    """Fit to the rows of ``labels`` where ``learn`` (an expression on doc_id) holds."""
    spark = docs.sparkSession
    bounded_batches(spark)
    usable = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
              .where(learn & F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)))
    rows = usable.count()
    share = min(1.0, LABELLED_ROWS / rows) if rows else 0.0
    sample = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(2 ** 32)) < int(share * 2 ** 32)).distinct()

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, "text"):
                got = [features(t.as_py()) for t in piece.column("text")]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("y"), pa.array(got, pa.list_(pa.float64()))],
                                                 ["doc_id", "y", "x"])

    # the sample has about LABELLED_ROWS rows of 12 bytes, so it may be broadcast
    joined = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
              .join(F.broadcast(sample), "doc_id").mapInArrow(numbers, "doc_id long, y int, x array<double>"))
    got = sorted(joined.distinct().collect(), key=lambda r: (r.doc_id, r.y, r.x))  # repeated documents count once
    x = np.array([r.x for r in got]).reshape(len(got), len(FEATURES))
    return fit(x, np.array([float(r.y) for r in got]))


#: Rows whose id's crc32 leaves this remainder are held out of training.
FOLDS, HELD_OUT = 3, 1


def held_out() -> Column:
    return F.coalesce(id_remainder(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))


def scorer(spark, model: Model):
    """Column function: text -> score."""
    held = spark.sparkContext.broadcast(model)

    def column(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            x = np.array([features(t.as_py()) for t in texts]).reshape(len(texts), len(FEATURES))
            yield pa.array(held.value.scores(x), pa.float64())

    return F.arrow_udf("double")(column)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model, s = train(docs, labels, ~held_out()), fresh("score")
    return (docs.select("doc_id", scorer(docs.sparkSession, model)(F.col("text").cast("string")).alias(s))
            .select("doc_id", held_out().alias("held_out"), F.col(s).alias("score"), (F.col(s) >= 0.5).cast("int").alias("predicted")))
