"""Language identification (operator 10).

Sparse multinomial logistic regression on TF-IDF character n-grams: lower-cased letters,
everything else one space, n-grams of NGRAMS code points hashed to FEATURES slots, weight
log(1 + count) x idf, unit length. Document frequencies are counted over every training
document in Spark. The weights are fitted by follow-the-regularised-leader (proximal, with
L1 and L2 penalties) on a bounded sample, SAMPLE_PER_LANGUAGE documents of each language (SAMPLE over
all languages, if that is less) on average, chosen by a hash of the id; a fifth of the sample is kept back to
fit the temperature that calibrates the scores.

``keep_identified`` rejects a text of which training has met less than half of the n-grams (LEAST_KNOWN, counted
as often as they occur), whatever the languages are and however many: letters of other scripts, codes.

Cases: null or letterless texts are ``und`` with score 0 (as is everything when nothing
can be learned); training rows with a null language, text or id are left out; a long text
is read whole, in pieces; repeated rows are predicted each and count in training as often
as they occur; an empty table gives an empty result; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundflow.llm.common import bounded_batches, fresh, id_remainder, staged

UND = "und"
NGRAMS = (1, 2, 3)
BITS = 16
FEATURES = 1 << BITS
#: Characters that are hashed at a time.
PIECE = 1 << 20
#: Training documents of each language (on average, by hash); the bound of the fitted sample.
SAMPLE_PER_LANGUAGE = 800
#: Training documents over all languages: what the driver gathers, at most about 64 KB a document of any length.
SAMPLE = 12_000
EPOCHS, ALPHA, BETA, L1, L2 = 4, 0.5, 1.0, 0.02, 0.05

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def slots(points: np.ndarray) -> np.ndarray:
    """Hash slots of all n-grams of a code point array."""
    out = []
    for n in NGRAMS:
        if len(points) < n:
            break
        h = np.full(len(points) - n + 1, n, np.uint32)
        for i in range(n):
            h = h * np.uint32(0x9E3779B1) + points[i:len(points) - n + 1 + i]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        out.append(h >> np.uint32(32 - BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Used slots and their counts; None if the text is null or has no letter."""
    total, seen, tail = np.zeros(FEATURES, np.int64), False, np.array([32], np.uint32)
    lowered = (text or "").lower()
    for at in range(0, len(lowered), PIECE):
        points = np.frombuffer(lowered[at:at + PIECE].encode("utf-32-le"), "<u4").astype(np.uint32)
        letter = letters()[points]
        seen = seen or bool(letter.any())
        points = np.where(letter, points, np.uint32(32))
        points = np.concatenate([tail, points])
        keep = np.ones(len(points), bool)
        keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
        points = points[keep]
        total += np.bincount(slots(points), minlength=FEATURES)
        tail = points[-2:]
        if len(tail) and at + PIECE < len(lowered):  # n-grams within the carried tail are counted once
            total -= np.bincount(slots(tail), minlength=FEATURES)
    if not seen:
        return None
    used = np.flatnonzero(total)
    return used, total[used]


class Model(NamedTuple):
    languages: list[str]
    idf: np.ndarray
    met: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def features(self, used: np.ndarray, count: np.ndarray) -> np.ndarray:
        x = np.log1p(count) * self.idf[used]
        norm = np.sqrt(x @ x)
        return x / norm if norm > 0 else x

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score, and the share of the text's n-grams that training has met."""
        found = counts(text) if self.languages else None
        if found is None:
            return UND, 0.0, 0.0
        used, count = found
        logits = (self.features(used, count) @ self.weights[used] + self.bias) / self.temperature
        p = np.exp(logits - logits.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum()), float(count[self.met[used]].sum() / count.sum())


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by FTRL-proximal; examples are (slots, values, class)."""
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))
    l1 = np.full((FEATURES + 1, 1), L1)
    l1[FEATURES] = 0  # the bias is not penalised

    def solved(zs, ns, l1s):
        return np.where(np.abs(zs) <= l1s, 0.0, (np.sign(zs) * l1s - zs) / ((BETA + np.sqrt(ns)) / ALPHA + L2 * (l1s > 0)))

    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(examples)):
            used, x, label = examples[k]
            at, value = np.append(used, FEATURES), np.append(x, 1.0)
            zs, ns = z[at], n[at]
            w = solved(zs, ns, l1[at])
            error = softmax(value @ w)
            error[label] -= 1
            g = value[:, None] * error
            grown = ns + g * g
            z[at] = zs + g - (np.sqrt(grown) - np.sqrt(ns)) / ALPHA * w
            n[at] = grown
    w = solved(z, n, l1)
    return w[:FEATURES], w[FEATURES]


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the logits with the least negative log-likelihood (golden section on its logarithm)."""
    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))[np.arange(len(labels)), labels]
        return float(-np.log(np.maximum(p, 1e-300)).mean())

    low, high, ratio = -4.0, 4.0, (np.sqrt(5) - 1) / 2
    while high - low > 1e-3:
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def train(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> Model:
    """Fit on the rows of ``docs`` where ``learn`` holds."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(doc_id).cast("string").alias("key"), F.col(text).cast("string").alias("text"),
                       F.col(lang).cast("string").alias("lang"),
                       (learn & F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(doc_id).isNotNull()).alias("use"))
    rows = rows.where("use")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    each = min(SAMPLE_PER_LANGUAGE, SAMPLE / max(1, len(sizes)))
    share = {k: min(1.0, each / v) for k, v in sizes.items()}

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sampled documents with their counts, then this task's document frequencies (lang null)."""
        names = ["lang", "order", "used", "count", "packed"]
        kinds = [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.binary()]
        seen, documents = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for body, language, order in zip(*(batch.column(c) for c in ("text", "lang", "order"))):
                found = counts(body.as_py())
                if found is None:
                    continue
                seen[found[0]] += 1
                documents += 1
                if order.as_py() < share[language.as_py()] * 2 ** 32:
                    packed = found[0].astype("<u2").tobytes() + found[1].astype("<u4").tobytes()
                    row = [language.as_py(), order.as_py(), None, None, packed]
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)
        used = np.flatnonzero(seen)
        row = [None, documents, used.astype(np.int32), seen[used], None]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

    order = F.pmod(F.xxhash64("key"), F.lit(2 ** 32))
    got = staged(rows.select("text", "lang", order.alias("order"))
                 .mapInArrow(gathered, "lang string, order long, used array<int>, count array<long>, packed binary"), "language-sample")
    tasks = got.where("lang is null")
    documents = tasks.agg(F.sum("order")).first()[0] or 0
    idf = np.full(FEATURES, np.log(1 + documents) + 1)  # of n-grams never seen: they weigh in a text's length, and speak for no language
    met = np.zeros(FEATURES, bool)
    if documents:  # at most one row per slot
        slot = tasks.select(F.explode(F.arrays_zip("used", "count")).alias("s")).groupBy("s.used").agg(F.sum("s.count").alias("df"))
        for r in slot.toLocalIterator():
            idf[r.used] = np.log((1 + documents) / (1 + r.df)) + 1
            met[r.used] = True
    sample = got.where("lang is not null").select("lang", "order", "packed").collect()  # about SAMPLE rows at most
    sample = sorted(sample, key=lambda r: (r.order, r.lang))
    languages = sorted({r.lang for r in sample})
    if not languages:
        return Model([], idf, met, np.zeros((FEATURES, 0)), np.zeros(0), 1.0)
    model = Model(languages, idf, met, np.zeros((FEATURES, len(languages))), np.zeros(len(languages)), 1.0)
    examples = []
    for r in sample:
        n = len(r.packed) // 6
        used, count = np.frombuffer(r.packed, "<u2", n).astype(np.int64), np.frombuffer(r.packed, "<u4", n, 2 * n)
        examples.append((used, model.features(used, count).astype(np.float32), languages.index(r.lang)))
    del sample
    back = examples[::5] if len(examples) >= 50 else []
    weights, bias = ftrl([e for i, e in enumerate(examples) if not back or i % 5], len(languages))
    model = model._replace(weights=weights.astype(np.float32), bias=bias)
    if back:
        logits = np.array([x @ model.weights[used] + bias for used, x, _ in back])
        model = model._replace(temperature=temperature(logits, np.array([k for *_, k in back])))
    return model


def predictor(docs: DataFrame, model: Model):
    """Column function: text -> struct(lang_pred, score, known)."""
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x languages floats

    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            got = [held.value.predict(t.as_py()) for t in texts]
            kinds = (pa.string(), pa.float64(), pa.float64())
            yield pa.StructArray.from_arrays([pa.array([g[i] for g in got], k) for i, k in enumerate(kinds)], ["lang_pred", "score", "known"])

    return F.arrow_udf("struct<lang_pred: string, score: double, known: double>")(predict)


#: Documents whose id's crc32 leaves this remainder are held out of training.
FOLDS, HELD_OUT = 4, 2


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(id_remainder(F.col(doc_id), FOLDS) == HELD_OUT, F.lit(False))


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learned from the rows that aren't held out."""
    model = train(docs, ~held_out())
    p = fresh("language")
    return (docs.select("doc_id", held_out().alias("held_out"), predictor(docs, model)(F.col("text").cast("string")).alias(p))
            .select("doc_id", "held_out", f"{p}.lang_pred", f"{p}.score"))


#: Share of a text's n-grams that training must have met.
LEAST_KNOWN = 0.5


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is identified: they have letters, and training has met their n-grams."""
    predict, p = predictor(docs, train(docs, ~held_out())), fresh("language")
    return (docs.withColumn(p, predict(F.col("text").cast("string")))
            .where((F.col(f"{p}.lang_pred") != UND) & (F.col(f"{p}.known") >= LEAST_KNOWN)).drop(p))
